"""Token ids in directly addressable codes: random access to any id without decoding a block.

A segment holds the ids of some documents. An id is split into chunks of eight bits, lowest first. Level 0
has the first chunk of every id, level 1 the second chunk of the ids that need one, and so on; a bitmap for
each level says whether an id goes on to the next, and a rank directory has the ones before each 512 bits of
it. Id i is then chunk i of level 0 and, while its bit is set, chunk rank(i) of the next level.

Layout (little-endian): magic TMDAC1, then as unsigned 32-bit integers the numbers of documents and levels,
then as 64-bit integers the documents' ids and the ends of their id runs; for each level its length (64 bits),
its chunks, its bitmap (lowest bit first, padded to 64 bytes) and its rank directory (32 bits each).

Each task writes its segments one after the other into files of its own, under names that no other attempt uses. A
Parquet index in the same folder, which Spark commits, says where each segment lies and how many ids stand before
it, so files of lost attempts are never read. `TokenFiles` reads id i, or a run of ids, by seeking: a few bytes for
each level, whatever the size of a segment. Folders may be anywhere that pyarrow's file systems reach.

Edge cases: a null or empty text has its end id alone; rows come in ascending doc_id, then text, nulls first;
rows that repeat a doc_id are written each; a text longer than a segment has one of its own; an empty table
gives an empty index; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, text_chunks
from tidemark.llm.tokens import encoder
from tidemark.llm.warc import _open

MAGIC, BLOCK = b"TMDAC1", 512
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id


def write_segment(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    levels = []
    left = ids.astype(np.uint64)
    while True:
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(len(left).to_bytes(8, "little") + left.astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            break
        left = left[more] >> np.uint64(8)
    head = MAGIC + np.array([len(doc_ids), len(levels)], "<u4").tobytes()
    return head + doc_ids.astype("<i8").tobytes() + ends.astype("<i8").tobytes() + b"".join(levels)


class Segment:
    """Reads a segment: id(i) and slice(a, b) by position, document(k) by place."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token segment")
        at = len(MAGIC)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        docs, levels = take("<u4", 2).tolist()
        self.doc_ids, self.ends = take("<i8", docs), take("<i8", docs)
        self.levels = []
        for _ in range(levels):
            n = int(take("<i8", 1)[0])
            blocks = -(-n // BLOCK)
            self.levels.append((take("u1", n), take("u1", blocks * BLOCK // 8), take("<u4", blocks)))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        block, width = i // BLOCK, BLOCK // 8
        part = bits[block * width : i // 8]
        return int(ranks[block]) + int(np.bitwise_count(part).sum()) + (int(bits[i // 8]) & ((1 << i % 8) - 1)).bit_count()

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def id(self, i: int) -> int:
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b: each level's run begins at the rank of the run before it."""
        out = np.zeros(max(b - a, 0), np.uint32)
        spots = np.arange(len(out))
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            if not len(spots):
                break
            out[spots] |= chunks[a : a + len(spots)].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[a // 8 : -(-(a + len(spots)) // 8)], bitorder="little")[a % 8 :][: len(spots)]
            a, spots = self._rank(bits, ranks, a), spots[more > 0]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def with_ends(ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids with end_id after them."""
    return np.insert(ids, starts[1:], end_id), starts + np.arange(len(starts))


#: Where segments lie: file, first byte and size, ids before it and in it, documents in it.
INDEX = "file string, at long, size long, start long, n_ids long, n_docs long"
_PLACED = "part int, number int, before long, file string, at long, size long, n_ids long, n_docs long"


def _encode(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, size: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    part, before, out, name, at = TaskContext.get().partitionId(), 0, None, "", 0
    store, place = _open(folder)
    try:
        for k, t in enumerate(text_chunks(batches, "text", size)):
            ids, starts = with_ends(*encoder(tokenizer).encode(t.column("text")), end_id)
            data = write_segment(t.column("doc_id").fill_null(int(NO_ID)).to_numpy(), starts[1:], ids)
            if out is None or at >= file_bytes:
                if out:
                    out.close()
                name, at = f"ids-{uuid.uuid4().hex}.dac", 0
                out = store.open_output_stream(f"{place}/{name}", compression=None)
            out.write(data)
            row = (part, k, before, name, at, len(data), len(ids), len(t))
            yield pa.RecordBatch.from_pylist([dict(zip((x.split()[0] for x in _PLACED.split(", ")), row))], pa.schema([(n, {"int": pa.int32(), "long": pa.int64()}.get(kind, pa.string())) for n, kind in (x.split() for x in _PLACED.split(", "))]))
            before, at = before + len(ids), at + len(data)
    finally:
        if out:
            out.close()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_bytes: int = 8 << 20, file_bytes: int = 256 << 20) -> None:
    """Write all texts' ids, each text's followed by end_id, in ascending doc_id order."""
    spark = docs.sparkSession
    store, folder = _open(path)
    store.create_dir(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    arrow_map(ordered, lambda b: _encode(b, path, tokenizer, end_id, segment_bytes, file_bytes), _PLACED).write.parquet(f"{path}/placed")
    placed = spark.read.schema(_PLACED).parquet(f"{path}/placed")
    sums = sorted(placed.groupBy("part").agg(F.sum("n_ids")).collect())  # a row for each part written
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(sums, np.cumsum([0, *(n for _, n in sums)]).tolist())], "part int, base long")
    index = placed.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before"))
    index.select(*(x.split()[0] for x in INDEX.split(", "))).repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{path}/index")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


class TokenFiles:
    """Any id of the whole set by its number, or a run of them, by seeking in the files.

    Looking up the segments is a pruned read of the index; the rest are reads of a few bytes each.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.index, (self.store, self.folder) = token_index(spark, path), _open(path)
        self.bytes_read = 0

    def __len__(self) -> int:
        return self.index.agg(F.sum("n_ids")).first()[0] or 0

    def _segments(self, a: int, b: int) -> list:
        return self.index.where((F.col("start") < b) & (F.col("start") + F.col("n_ids") > a)).orderBy("start").collect()

    def _bytes(self, f, at: int, n: int) -> bytes:
        f.seek(at)
        data = f.read(n)
        self.bytes_read += len(data)
        return data

    def token(self, i: int) -> int:
        found = self._segments(i, i + 1)
        if i < 0 or not found:
            raise IndexError(i)
        with self.store.open_input_file(f"{self.folder}/{found[0].file}") as f:
            return self._token(f, found[0].at, i - found[0].start)

    def _token(self, f, at: int, i: int) -> int:
        docs, levels = np.frombuffer(self._bytes(f, at + len(MAGIC), 8), "<u4").tolist()
        at += len(MAGIC) + 8 + 16 * docs
        value, width = 0, BLOCK // 8
        for level in range(levels):
            n = int.from_bytes(self._bytes(f, at, 8), "little")
            blocks = -(-n // BLOCK)
            chunks, bits, ranks = at + 8, at + 8 + n, at + 8 + n + blocks * width
            value |= self._bytes(f, chunks + i, 1)[0] << 8 * level
            block = int.from_bytes(self._bytes(f, bits + i // BLOCK * width, width), "little")
            if not block >> i % BLOCK & 1:
                break
            before = int.from_bytes(self._bytes(f, ranks + i // BLOCK * 4, 4), "little")
            i, at = before + (block & ((1 << i % BLOCK) - 1)).bit_count(), ranks + blocks * 4
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b, which may lie in several segments and files."""
        out = [np.empty(0, np.uint32)]
        for s in self._segments(a, b):
            with self.store.open_input_file(f"{self.folder}/{s.file}") as f:
                out.append(Segment(self._bytes(f, s.at, s.size)).slice(max(a - s.start, 0), min(b - s.start, s.n_ids)))
        return np.concatenate(out)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document; start counts the ids of all before it.

    with_ids=False reads and sums the ids all the same, but leaves their column out of the result.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(path)
        for b in batches:
            for row in b.to_pylist():
                with store.open_input_file(f"{folder}/{row['file']}") as f:
                    f.seek(row["at"])
                    s = Segment(f.read(row["size"]))
                runs = [s.document(k).astype("<u4") for k in range(len(s.ends))]
                sizes = np.diff(np.r_[0, s.ends])
                crc = [zlib.crc32(x.tobytes()) for x in runs]
                cols = [pa.array(s.doc_ids, mask=s.doc_ids == NO_ID), pa.array(row["start"] + s.ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, s.ends].astype(np.int32)), pa.array(np.concatenate(runs).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(token_index(spark, path).repartition(parts, "file", "at"), run, schema)
