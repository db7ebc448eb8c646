"""Shards by a Feistel permutation of global row numbers, in DataFrame functions only.

Rows get numbers from 0 in the order of doc_id and text. A permutation of the numbers below n, fixed by the seed, deals
them: the row at permuted place p lies in shard p % shards at slot p // shards, so shards differ by a row at most and
slots have no gap. Both ways are expressions of a number (`permuted`, `original`, `placed`, `row_at`): where a row lies,
and which row lies somewhere, is computed and not looked up.

Permutation: a number is a pair (x, y) with x below a = ceil(sqrt(n)) and y below b = ceil(n / a). A round replaces
(x, y) by (y, x + f(y) mod the size of x), which can be undone; f squares modulo a prime. The pairs number a * b, fewer
than a more than n. A number that leaves [0, n) is permuted again until it is back (cycle walking): as it can meet each
of the a * b - n numbers outside once at most, so many further steps always suffice. About one row in sqrt(n) walks.

Numbering: rows are dealt by ranges of (doc_id, size, checksum of the text, place in the files) and written with their
partition and place in it; a partition's first number is the count of rows in those before it. One row a partition
reaches the driver. The last part of the order splits any number of equal rows over tasks.

Edge cases: a null text has size 1, as the empty one, and checksum 0; null doc_ids come first; rows that repeat a doc_id
are rows of their own; rows equal in doc_id and text are told apart by their place in the files, which matters only to
further columns; very long texts are only measured; an empty table gives an empty result; further columns, whatever
their names, are ignored by shard_documents and kept apart, in a struct, by write_shards.
"""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

PRIME = (1 << 31) - 1
ROUNDS = 6


def radices(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[tuple[int, int, int, int]]:
    rng = random.Random(seed)
    return [tuple(rng.randrange(1, PRIME) for _ in range(4)) for _ in range(ROUNDS)]


def _mixed(y: Column, k: Column) -> Column:
    """f: a number below the prime; all products stay below 2**62."""
    line = (y * k["p"] + k["q"]) % PRIME
    return ((line * line + y) % PRIME * k["r"] + k["s"]) % PRIME


def _once(number: Column, n: int, seed: int, back: bool) -> Column:
    """The permutation of all pairs, or its inverse."""
    a, b = radices(n)
    keys = [F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip("pqrsm", (*key, b if k % 2 else a)))) for k, key in enumerate(round_keys(seed))]

    def ahead(s: Column, k: Column) -> Column:
        return F.struct(s["y"].alias("x"), F.pmod(s["x"] + _mixed(s["y"], k), k["m"]).alias("y"))

    def undo(s: Column, k: Column) -> Column:
        return F.struct(F.pmod(s["y"] - _mixed(s["x"], k), k["m"]).alias("x"), s["x"].alias("y"))

    pair = F.struct(F.call_function("div", number, F.lit(b)).alias("x"), (number % b).alias("y"))
    return F.aggregate(F.array(*(keys[::-1] if back else keys)), pair, undo if back else ahead, lambda s: s["x"] * b + s["y"])


def _walked(number: Column, n: int, seed: int, back: bool) -> Column:
    a, b = radices(n)
    first = _once(number.cast("long"), n, seed, back)
    if a * b == n:
        return first

    def home(v: Column) -> Column:
        step = lambda w, _: F.when(w < n, w).otherwise(_once(w, n, seed, back))
        return F.when(v < n, v).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), v, step))

    return F.element_at(F.transform(F.array(first), home), 1)


def permuted(row: Column, n: int, seed: int) -> Column:
    """Where the permutation puts a row's number, both from 0 to n - 1."""
    return _walked(row, n, seed, False)


def original(place: Column, n: int, seed: int) -> Column:
    """The row's number that the permutation puts there."""
    return _walked(place, n, seed, True)


def placed(row: Column, n: int, shards: int, seed: int) -> tuple[Column, Column]:
    """(shard, slot) of a row's number."""
    p = permuted(row, n, seed)
    return (p % shards).cast("int"), F.call_function("div", p, F.lit(shards).cast("long"))


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int) -> Column:
    """The row's number at a slot of a shard."""
    return original(slot * shards + shard, n, seed)


def numbered(rows: DataFrame, order: list[str], name: str = "row") -> tuple[DataFrame, int]:
    """Rows with their place in the order, from 0, as a column of that name; and how many there are."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("data"), F.monotonically_increasing_id().alias("at"))
    by = [F.col(f"data.`{c}`") for c in order]
    dealt = data.repartitionByRange(parts, *by, "at").sortWithinPartitions(*by, "at")
    number = F.monotonically_increasing_id()  # the partition's number in the upper bits, the row's place in it in the lower 33
    stored, _ = materialise(dealt.select("data", F.shiftrightunsigned(number, 33).alias("part"), number.bitwiseAND((1 << 33) - 1).alias("place")), "numbered")
    counts = sorted(tuple(r) for r in stored.groupBy("part").count().collect())  # a row a partition
    before = [0, *itertools.accumulate(c for _, c in counts)]
    offsets = spark.createDataFrame([(p, at) for (p, _), at in zip(counts, before)], "part long, before long")
    return stored.join(F.broadcast(offsets), "part").select("data.*", (F.col("before") + F.col("place")).alias(name)), before[-1]


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 11) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row. The law is `rows`: counts of shards are at
    most one apart, whatever texts and ids are. Only ids, sizes and checksums are moved."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    told, n = numbered(rows, ["doc_id", "size", "text_crc32"])
    shard, slot = placed(F.col("row"), n, shards, seed)
    return told.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 11) -> int:
    """Write whole rows into folders shard=0 and so on, each in the order of its slots over as many files as it needs;
    how many rows there are."""
    key = ["doc_id", "size", "text_crc32"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    told, n = numbered(rows, key)
    shard, slot = placed(F.col("row"), n, shards, seed)
    out = told.select(shard.alias("shard"), slot.alias("slot"), "doc")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return n


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """The rows of a shard in the order of its slots."""
    return spark.read.parquet(f"{path}/shard={shard}").orderBy("slot").select("doc.*")
