"""Questions that chunks of a corpus ask about keys of the whole corpus, answered by ranges of keys.

A chunk is a bounded piece of the corpus, packed as bytes. It asks about sorted distinct 64-bit keys with a value
each; its keys are cut into ranges that are the same for all chunks, and each cut travels as one row of packed
differences. The task of a range merges what all chunks ask about it and answers each chunk in its own order, so a
key that a third of all texts hold costs one entry in each chunk, and no answer names a key again.

There are as many ranges as shuffle partitions, and more only where a range would hold more than `most` keys, which
bounds a task's memory. A chunk sends a row for each range in which it has keys, and finds the ranges from its keys
alone: rows number chunks times ranges at most, and never more than the keys that are asked about, so they grow with
the input however many ranges there are. Where cuts become small, raise the chunks' size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, give_back, key_chunks
from tidemark.llm.words import pack, unpack


def ranges_for(df: DataFrame, keys: int, most: int = 1_000_000) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys // most))


def narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers, none of them negative, in four bytes where they fit."""
    return a.astype(np.uint32) if not len(a) or (a.min() >= 0 and a.max() < 1 << 32) else a


def cut(keys: np.ndarray, ranges: int, bits: int = 64) -> tuple[list[int], list[int]]:
    """Numbers of the ranges that hold some of the sorted keys, and where the keys of each begin and the last ones end.
    Ranges part the upper 32 bits evenly. Without keys the first range is named with none, so that each chunk is
    answered."""
    if not len(keys):
        return [0], [0, 0]
    number = ((keys >> np.uint64(bits - 32)) * np.uint64(ranges)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    return number[first].tolist(), [*first.tolist(), len(keys)]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def ask(chunks: DataFrame, question: Callable[[dict], tuple[np.ndarray, np.ndarray]], ranges: int, bits: int = 64) -> DataFrame:
    """(range, chunk, asked) of what each chunk's question gives: sorted distinct keys of so many bits, and a value for
    each."""
    if ranges >= 1 << 31:
        raise ValueError(f"{ranges} ranges are too many")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                keys, values = question(row)
                number, cuts = cut(keys, ranges, bits)
                blobs = [pack(k=np.diff(keys[i:j], prepend=np.uint64(0)), v=narrow(values[i:j])) for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array([row["chunk"]] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["range", "chunk", "asked"])
                give_back()

    return arrow_map(chunks, run, "range int, chunk long, asked binary")


def answer(asked: DataFrame, merge: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list[int]]], facts: tuple[str, ...] = ()) -> DataFrame:
    """(chunk, range, answer, facts): merge gets a range's keys and values in order of the keys and where each key
    begins; it gives an answer for each entry, and sums of the range."""
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_chunks(batches, "range", 1):
            number = t.column("range").to_numpy()
            for k in np.unique(number):
                part = t.filter(pa.array(number == k))
                told = [unpack(x.as_py()) for x in part.column("asked")]
                keys = np.concatenate([np.cumsum(x["k"], dtype=np.uint64) for x in told])
                values = np.concatenate([x["v"].astype(np.int64) for x in told])
                sizes = [len(x["k"]) for x in told]
                del told
                order = np.argsort(keys, kind="stable")
                keys, values = keys[order], values[order]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
                out, sums = merge(keys, values, first)
                back = np.empty(len(out), out.dtype)
                back[order] = out
                blobs = [pack(a=np.packbits(x) if x.dtype == bool else narrow(x)) for x in np.split(back, np.cumsum(sizes)[:-1])]
                rest = [0] * (len(blobs) - 1)
                cols = [part.column("chunk").combine_chunks(), pa.array([int(k)] * len(blobs), pa.int32()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary()), *[pa.array([int(x), *rest], pa.int64()) for x in sums]]
                yield pa.RecordBatch.from_arrays(cols, ["chunk", "range", "size", "answer", *facts])
            give_back()

    schema = "chunk long, range int, size int, answer binary" + "".join(f", {x} long" for x in facts)
    return arrow_map(asked.repartition(parts, "range").sortWithinPartitions("range"), run, schema)


def with_answers(chunks: DataFrame, *answered: DataFrame) -> DataFrame:
    """chunks with answers: those of each round, in order of rounds and ranges (see unpacked)."""
    parts = [a.select("chunk", F.struct(F.lit(k).alias("round"), "range", "size", "answer").alias("told")) for k, a in enumerate(answered)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return chunks.join(both.groupBy("chunk").agg(F.array_sort(F.collect_list("told")).alias("answers")), "chunk")


def unpacked(answers: list[dict]) -> list[np.ndarray]:
    """For each round the answers in the order of the chunk's keys; packed bits are numbers 0 and 1."""
    rounds: dict[int, list[np.ndarray]] = {}
    for x in answers:
        a = unpack(x["answer"])["a"]
        rounds.setdefault(x["round"], []).append(np.unpackbits(a, count=x["size"]) if a.dtype == np.uint8 else a)
    return [np.concatenate(rounds[k]) for k in sorted(rounds)]
