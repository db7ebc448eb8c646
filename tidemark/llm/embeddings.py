"""Near-duplicate vectors by cosine, through randomised-rotation binary codes.

Equal vectors are one class with a weight. A random rotation turns a class's unit vector q into its code, which is
stored: the d sign bits, the correction factor f = <code, q>, and q rounded at random to 16 levels. For two classes
<code, q'>/f is an unbiased estimate of the inner product. Its error is at most `confidence` times
sqrt((1-f*f)/(f*f*(d-1))) times the part of q' across q, which is sqrt(1-t*t) or less where the cosine is t or more;
the rounding adds half a level. Pairs whose bound stays under the threshold t end there, by codes alone.

Further rotations give each class a run of bits in a number of tables, and classes with a common run meet. The
number of bits grows with the logarithm of the rows, and that of tables so that a pair at the threshold meets in
one of them at least with probability `recall` (pairs above it, more surely). Only codes travel to the tables. The
classes that have an undecided pair there fetch their vectors, and their undecided pairs are computed exactly, in
double precision; only these make links. A pair counts in the first table in which its runs agree, so each link
counts once. Runs that many classes share are dealt by salt over pairs of blocks, each a task's share of bounded
size. Each share gives a row for each linked class: its number of links there, and one link of a spanning forest.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do
vectors of different length with each other; rows that repeat a vec_id are vectors each; a null vec_id links
like others but names no component; an empty table gives an empty result; other columns are ignored. Vectors are
told apart by 128 bits.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, connected_components, drop, find_roots, key_chunks, materialise
from tidemark.llm.words import mix

BLOCK = 2048  # classes of one run that meet in one share
HEAD = 16  # bytes of a stored code before its bits: d, f, and least value and step of the levels


def table_plan(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a run, tables): about 256 classes meet, as comparing codes costs less than moving them."""
    bits = max(4, math.ceil(math.log2(max(rows, 2) / 256)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


@functools.lru_cache(8)
def rotations(d: int, columns: int, seed: int = 42) -> np.ndarray:
    """d x columns: random orthogonal matrices side by side."""
    rng = np.random.default_rng([seed, d])
    parts = [np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-columns // d))]
    return np.ascontiguousarray(np.concatenate(parts, 1)[:, :columns])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def encode(unit: np.ndarray, seed: int = 43) -> np.ndarray:
    """The stored code of each unit vector, as rows of bytes."""
    n, d = unit.shape
    q = unit @ rotations(d, d, seed)
    low = q.min(1, keepdims=True)
    step = np.maximum((q.max(1, keepdims=True) - low) / 15, 1e-30)
    level = np.clip(np.floor((q - low) / step + np.random.default_rng([seed, n]).random(q.shape)), 0, 15).astype(np.uint8)
    level = np.pad(level, ((0, 0), (0, d % 2)))
    f = np.abs(q).sum(1, keepdims=True) / math.sqrt(d)
    head = np.concatenate([f, f, low, step], 1).astype(np.float32)
    head[:, 0] = np.full(n, d, np.int32).view(np.float32)
    return np.concatenate([head.view(np.uint8), np.packbits(q > 0, axis=1), level[:, ::2] << 4 | level[:, 1::2]], 1)


class Codes:
    """Stored codes of vectors of one length, unpacked: a slice is one side of a comparison."""

    def __init__(self, data: np.ndarray):
        head = np.ascontiguousarray(data[:, :HEAD])
        self.d = d = int(head.view(np.int32)[0, 0])
        _, self.f, low, self.step = head.view(np.float32).T
        bits = np.unpackbits(data[:, HEAD : HEAD + -(-d // 8)], axis=1, count=d)
        self.signs = (bits * np.float32(2) - np.float32(1)) / np.float32(math.sqrt(d))
        packed = data[:, HEAD + -(-d // 8) :]
        level = np.stack([packed >> 4, packed & 15], 2).reshape(len(data), -1)[:, :d]
        self.q = level * self.step[:, None] + low[:, None]

    def estimate(self, i: slice, j: slice) -> np.ndarray:
        """Unbiased estimates of the inner products of rows i with rows j."""
        return self.signs[i] @ self.q[j].T / self.f[i, None]

    def undecided(self, i: slice, j: slice, threshold: float, confidence: float) -> np.ndarray:
        """Which pairs of a row of i and a row of j the codes don't rule out; for i = j, each pair once."""
        f = self.f[i]
        across = math.sqrt(1 - max(threshold, 0.0) ** 2)
        error = across * np.sqrt(np.maximum(1 - f * f, 0)) * min(confidence / math.sqrt(max(self.d - 1, 1)), 1.0)
        left = f * np.float32(threshold) - error - 1e-5
        maybe = self.signs[i] @ self.q[j].T + confidence / 2 * self.step[None, j] >= left[:, None]
        return np.triu(maybe, 1) if i == j else maybe


def exactly_close(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows of x have a cosine of at least threshold, in double precision."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), max(1, (1 << 22) // x.shape[1])):
        part = slice(at, at + max(1, (1 << 22) // x.shape[1]))
        a, b = x[i[part]], x[j[part]]
        scale = np.abs(a).max(1) * np.abs(b).max(1)
        if ((scale < 1e-140) | (scale > 1e140)).any():
            a, b = _unit(a), _unit(b)
        out[part] = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)) >= threshold
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a column."""
    n, width = rows.shape
    ends = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """A column of binaries of one width as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _store(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """Each class with its code and its runs of bits."""
    for batch in batches:
        sizes = batch.column("d").to_numpy()
        for d in np.unique(sizes):
            part = batch.filter(pa.array(sizes == d))
            step = max(1, min(1000, (1 << 21) // int(d)))
            for at in range(0, part.num_rows, step):
                b = part.slice(at, step)
                x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, d)
                unit = _unit(x)
                signs = (unit @ rotations(int(d), bits * tables)) > 0
                runs = (signs.reshape(-1, tables, bits) << np.arange(bits)).sum(2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, _binary(encode(unit)), _binary(runs.view(np.uint8))], [*b.schema.names, "code", "runs"])


def _spread(batches: Iterator[pa.RecordBatch], tables: int) -> Iterator[pa.RecordBatch]:
    """A row for each class and table: the key of its run there, and the other columns but the runs."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            b = batch.slice(at, 2000)
            runs = _bytes(b.column("runs")).view(np.int32).astype(np.uint64)
            table = np.tile(np.arange(tables), b.num_rows)
            d = np.repeat(b.column("d").to_numpy(), tables).astype(np.uint64)
            key = mix(mix(runs.ravel() + (d << np.uint64(32))) + table.astype(np.uint64)).view(np.int64)
            row = pa.array(np.repeat(np.arange(b.num_rows), tables))
            names = [c for c in b.schema.names if c not in ("runs", "d")]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(table.astype(np.int32)), *(b.column(c).take(row) for c in names)], ["key", "tab", *names])


def _groups(t: pa.Table, vector_bytes: int) -> Iterator[tuple[pa.Table, list[tuple[slice, slice]]]]:
    """Pieces of a chunk whose codes have one width, and the pairs of row ranges that meet in each.

    `place` says table, side, and whether a share spans two blocks, whose rows meet those of the other block alone.
    """
    share, place = t.column("share").to_numpy(), t.column("place").to_numpy()
    width = pa.compute.binary_length(t.column("code")).to_numpy() if t.num_rows else np.empty(0, int)
    first = [int.from_bytes(c[:4], "little") for c in t.column("code").to_pylist()]
    order = np.lexsort((place & 2, share, np.array(first), width))
    d = np.array(first)[order]
    share, place, t = share[order], place[order], t.take(pa.array(order))
    cut = np.r_[0, np.flatnonzero((share[1:] != share[:-1]) | (d[1:] != d[:-1])) + 1, len(share)]
    at, pairs = 0, []
    for lo, hi in zip(cut[:-1], cut[1:]):
        if lo > at and (d[lo] != d[at] or (hi - at) * int(d[lo]) * vector_bytes > 1 << 25):
            if pairs:
                yield t.slice(at, lo - at), pairs
            at, pairs = lo, []
        if hi - lo < 2:
            continue
        if place[lo] & 1:
            mid = lo + int(np.searchsorted(place[lo:hi] & 2, 1))
            if lo < mid < hi:
                pairs.append((slice(lo - at, mid - at), slice(mid - at, hi - at)))
        else:
            pairs.append((slice(lo - at, hi - at), slice(lo - at, hi - at)))
    if pairs:
        yield t.slice(at), pairs


def _rule_out(batches: Iterator[pa.RecordBatch], threshold: float, confidence: float) -> Iterator[pa.RecordBatch]:
    """The rows of each share that have a pair which the codes don't rule out."""
    for chunk in key_chunks(batches, "share", 20_000):
        for t, pairs in _groups(chunk, 8):
            codes = Codes(_bytes(t.column("code")))
            keep = np.zeros(t.num_rows, bool)
            for i, j in pairs:
                maybe = codes.undecided(i, j, threshold, confidence)
                keep[i] |= maybe.any(1)
                keep[j] |= maybe.any(0)
            yield from t.filter(pa.array(keep)).select(["share", "place", "cls"]).combine_chunks().to_batches()


def _meet(batches: Iterator[pa.RecordBatch], threshold: float, confidence: float) -> Iterator[pa.RecordBatch]:
    """Links and a spanning forest of the classes of each share, from the exact cosines of undecided pairs."""
    for chunk in key_chunks(batches, "share", 4 * BLOCK):
        for t, pairs in _groups(chunk, 16):
            codes = Codes(_bytes(t.column("code")))
            x = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
            runs = _bytes(t.column("runs")).view(np.int32)
            table = t.column("place").to_numpy() >> 2
            cls, weight = t.column("cls").to_numpy(), t.column("weight").to_numpy()
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for one, two in pairs:
                i, j = np.nonzero(codes.undecided(one, two, threshold, confidence))
                i, j = i + one.start, j + two.start
                close = exactly_close(x, i, j, threshold)
                i, j = i[close], j[close]
                mine = np.ones(len(i), bool)
                for k in range(int(table[one.start])):  # met in a table before
                    mine &= runs[i, k] != runs[j, k]
                a.append(i[mine])
                b.append(j[mine])
            i, j = np.concatenate(a), np.concatenate(b)
            ids, back = np.unique(np.r_[cls[i], cls[j]], return_inverse=True)
            low, high = back[: len(i)], back[len(i) :]
            links = np.bincount(low, weight[j], len(ids)) + np.bincount(high, weight[i], len(ids))
            root = find_roots(len(ids), low, high)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(ids[root])], ["cls", "links", "root"])


def embedding_groups(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.9995, confidence: float = 5.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    marked = rows.where("usable").select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    bits, tables = table_plan(rows.count(), threshold, recall)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    kind = rows.schema["embedding"].dataType.simpleString()
    classes = marked.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    classes = classes.select(F.monotonically_increasing_id().alias("cls"), "h1", "h2", "first", "weight", F.size("embedding").alias("d"), "embedding")
    stored = arrow_map(classes, lambda b: _store(b, bits, tables), f"cls long, h1 long, h2 long, first long, weight long, d int, embedding {kind}, code binary, runs binary")
    stored, _ = materialise(stored, "vector-codes")

    keys = arrow_map(stored.select("d", "runs"), lambda b: _spread(b, tables), "key long, tab int")
    crowded, busy = materialise(keys.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "crowded")
    met = arrow_map(stored.select("d", "runs", "cls", "code"), lambda b: _spread(b, tables), "key long, tab int, cls long, code binary")
    dealt = met.join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    place = F.col("tab") * 4 + (F.col("own") != low).cast("int") * 2 + (low != high).cast("int")
    dealt = dealt.select(F.xxhash64("key", low, high).alias("share"), place.alias("place"), "cls", "code")
    dealt = dealt.repartition(parts, "share").sortWithinPartitions("share")
    open_rows, opened = materialise(arrow_map(dealt, lambda b: _rule_out(b, threshold, confidence), "share long, place int, cls long"), "undecided")

    fetched = open_rows.join(stored.select("cls", "weight", "code", "runs", "embedding"), "cls").repartition(parts, "share").sortWithinPartitions("share")
    linked, _ = materialise(arrow_map(fetched, lambda b: _meet(b, threshold, confidence), "cls long, links long, root long"), "vector-links")
    for path in (busy, opened):
        drop(spark, path)

    counted = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = connected_components(linked.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    named = stored.select("cls", "h1", "h2", "first", "weight").join(counted, "cls", "left").join(joined, "cls", "left").withColumn("group", F.coalesce("component", "cls"))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    known = named.join(least, "group").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = marked.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
