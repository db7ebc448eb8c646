"""Packing of token pieces into as few sequences as possible by a configuration linear program.

A document's ids are cut into pieces of at most `size` (a shorter piece comes first). Only the histogram of
piece lengths matters for the plan, and it has `size` entries however many documents there are. A
configuration is a multiset of lengths that fits in one sequence; the program asks for the fewest sequences
whose configurations cover the histogram. Multiplicative weights solve it: each length carries a weight that
falls as it gets covered; the next configuration is the most valuable one at the present weights, priced by a
knapsack dynamic program over the places of a sequence; it is used as often as the lengths left of its rarest
part call for. The shares found are rounded down; what they leave is packed best-fit into the gaps and into
new sequences, again length by length on the histogram.

The plan gives, for each length and each rank among the pieces of that length, a sequence and an offset as
runs, so pieces are placed by their rank alone, in parallel. A task ranks its pieces as it cuts them; a small table
says how many pieces of a length the tasks before it have, so pieces are neither sorted nor gathered by length.
`lower_bound` tells how few sequences any packing needs.

Edge cases: a null or empty text is its end id alone; rows that repeat a doc_id are packed each; a null doc_id
stays null; a very long text is read whole and cut like others; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, materialise, text_chunks
from tidemark.llm.token_files import with_ends
from tidemark.llm.tokens import encoder

def price(value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity the best worth of a multiset that fits (value[l] for each length l), and the length to
    take first (none: 0)."""
    best, take = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    lengths = np.flatnonzero(value > 0)
    worth_of = value[lengths]
    for c, k in enumerate(np.searchsorted(lengths, np.arange(size + 1), side="right").tolist()):
        best[c] = best[c - 1] if c else 0
        if k:
            worth = best[c - lengths[:k]] + worth_of[:k]
            top = worth.argmax()
            if worth[top] > best[c]:
                best[c], take[c] = worth[top], lengths[top]
    return best, take


def solve_configurations(histogram: np.ndarray, size: int, rounds: int, rate: float, bend: float) -> dict[tuple[int, ...], float]:
    """Shares of configurations that cover the histogram, by multiplicative weights on the lengths.

    A length's price is its room (bent a little, as short lengths fill gaps that long ones leave) times a weight
    that falls with the part of its need that is covered. Each round prices all capacities in one knapsack program, and each length that lags behind the
    round, longest first, gets the best configuration around it at these prices, as often as brings it up.
    """
    need = histogram.astype(float)
    cover = np.zeros(len(need))
    used: dict[tuple[int, ...], float] = {}
    lengths = np.flatnonzero(need)
    for t in range(1, rounds + 1):
        done = np.divide(cover, need, out=np.ones(len(need)), where=need > 0)
        value = np.where(need > 0, np.arange(len(need)) ** bend * np.exp(-rate * (done - (t - 1) / rounds)), 0)
        _, take = price(value, size)
        for k in lengths[::-1].tolist():
            lag = need[k] * t / rounds - cover[k]
            if lag <= 1e-9:
                continue
            config, c = [k], size - k
            while c > 0:
                c = int(c - 1 if not take[c] else c - (config.append(int(take[c])) or take[c]))
            times = Counter(config)
            share = lag / times[k]
            key = tuple(sorted(config, reverse=True))
            used[key] = used.get(key, 0) + share
            for x, m in times.items():
                cover[x] += share * m
    return used


def lower_bound(histogram: np.ndarray, size: int, rounds: int = 400, rate: float = 0.5) -> float:
    """A bound from below on the sequences of any packing: prices of lengths, divided by what the dearest sequence
    is worth at them, best over the rounds. Multiplicative weights lower the prices that the dearest sequence holds."""
    need = histogram.astype(float)
    some = need > 0
    value = np.divide(1.0, need, out=np.zeros(len(need)), where=some)
    best = float((need * np.arange(len(need))).sum() / size)  # by the room they take
    for t in range(rounds if some.any() else 0):
        worth, take = price(value, size)
        best = max(best, float(need @ value / worth[size]))
        held, c = np.zeros(len(need)), size
        while c > 0:
            held[take[c]] += take[c] > 0
            c -= int(take[c]) or 1
        part = np.divide(held, need, out=np.zeros(len(need)), where=some)
        value *= 1 - rate / (1 + t / 5) * part / part.max()
    return best


#: Rounds, rate and bend of the solutions that a plan is chosen from; broad and narrow histograms favour different ones.
SETTINGS = ((12, 0.1, 1.05), (12, 2.0, 1.05), (24, 4.0, 1.0))


def plan(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences have each; they hold the histogram exactly."""
    return min((_rounded(histogram, size, *x) for x in SETTINGS), key=lambda p: sum(n for _, n in p))


def _rounded(histogram: np.ndarray, size: int, rounds: int, rate: float, bend: float, passes: int = 3) -> list[tuple[tuple[int, ...], int]]:
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    for _ in range(passes):  # what rounding down leaves is solved again
        shares, whole = solve_configurations(left, size, rounds, rate, bend), False
        for config in sorted(shares, key=lambda x: (-sum(x), -shares[x], x)):  # the fullest first
            times = Counter(config)
            n = min(int(shares[config] + 1e-9), *(int(left[k] // m) for k, m in times.items()))
            if n > 0:
                whole = True
                out.append((config, n))
                for k, m in times.items():
                    left[k] -= n * m
        if not whole:
            break
    # best fit, longest first, into the gaps of the sequences so far and then into new ones
    gaps: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    for config, n in out:
        gaps[size - sum(config)].append((config, n))
    for k in range(size, 0, -1):
        while left[k]:
            room = next((g for g in range(k, size + 1) if gaps[g]), None)
            config, n = gaps[room].pop() if room is not None else ((), int(-(-left[k] // (size // k))))
            each = min((size - sum(config)) // k, int(left[k]))
            many = min(n, int(left[k]) // each)
            if n > many and config:
                gaps[size - sum(config)].append((config, n - many))
            config = config + (k,) * each
            left[k] -= many * each
            gaps[size - sum(config)].append((config, many))
    return [x for g in gaps for x in g]


class Places:
    """Sequence and offset of the r-th piece of a length."""

    def __init__(self, configs: list[tuple[tuple[int, ...], int]], size: int):
        runs: list[tuple[int, ...]] = []
        seen = np.zeros(size + 1, np.int64)
        first = 0
        for config, n in configs:
            at = 0
            for k, m in sorted(Counter(config).items(), reverse=True):
                runs.append((k, int(seen[k]), first, m, at))
                seen[k] += n * m
                at += k * m
            first += n
        runs.sort()
        a = np.array(runs, np.int64).reshape(-1, 5)
        self.length, self.rank, self.first, self.each, self.at = a.T.copy()
        self.begin = np.searchsorted(self.length, np.arange(size + 2))
        self.sequences = first

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.length * (1 << 42) + self.rank, length * (1 << 42) + rank, side="right") - 1
        r, each = rank - self.rank[run], self.each[run]
        return self.first[run] + r // each, self.at[run] + r % each * length


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, chunk_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank) of each piece: part is its task, rank its number
    among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for t in text_chunks(batches, "text", chunk_bytes):
            ids, starts = with_ends(*encoder(tokenizer).encode(t.column("text")), end_id)
            n = np.diff(starts)
            count = -(-n // size)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = n - (count - 1) * size  # the first piece takes what the others leave
            start = np.where(piece > 0, head[row] + (piece - 1) * size, 0)
            length = np.where(piece > 0, size, head[row])
            order = np.argsort(length, kind="stable")
            many = np.bincount(length, minlength=size + 1)
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) + np.repeat(seen - np.cumsum(many) + many, many)
            seen += many
            raw = memoryview(ids.astype("<u4").tobytes())
            at = (starts[row] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
            cols = [t.column("doc_id").combine_chunks().take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset."""
    spark = docs.sparkSession
    cut, _ = materialise(pieces(docs, tokenizer, end_id, size), "pieces")
    counts, _ = materialise(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most size rows
        histogram[r["length"]] = r["n"]
    places = spark.sparkContext.broadcast(Places(plan(histogram, size), size))  # at most a few runs for each length and configuration
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.value.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            cols = [b.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], [*("doc_id", "piece", "start", "length", "ids_crc32"), "sequence_id", "offset"])

    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    return arrow_map(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
