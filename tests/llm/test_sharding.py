import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding as S


def brute_place(row, n, seed):
    """The permutation in plain integers."""
    a, b = S.radices(n)
    while True:
        x, y = divmod(row, b)
        for k, (p, q, r, s) in enumerate(S.round_keys(seed)):
            line = (y * p + q) % S.PRIME
            f = ((line * line + y) % S.PRIME * r + s) % S.PRIME
            x, y = y, (x + f) % (b if k % 2 else a)
        row = x * b + y
        if row < n:
            return row


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 210, 997, 4096])
def test_a_permutation_that_can_be_undone(spark, n):
    rows = spark.range(n).select("id", S.permuted(F.col("id"), n, 5).alias("p"))
    got = rows.select("id", "p", S.original(F.col("p"), n, 5).alias("back")).collect()
    assert sorted(r.p for r in got) == list(range(n))
    assert all(r.back == r.id for r in got)
    assert {r.id: r.p for r in got} == {k: brute_place(k, n, 5) for k in range(n)}


def test_walks_are_long_enough_where_many_numbers_lie_outside(spark):
    for n in (2, 3, 5, 7, 13, 31, 57, 111):  # a * b exceeds n by nearly a
        for seed in range(20):
            p = [brute_place(k, n, seed) for k in range(n)]
            assert sorted(p) == list(range(n))
        got = [r.p for r in spark.range(n).orderBy("id").select(S.permuted(F.col("id"), n, 3).alias("p")).collect()]
        assert got == [brute_place(k, n, 3) for k in range(n)]


def test_large_numbers_do_not_overflow(spark):
    n = 10**13 + 7
    rows = [0, 1, n // 2, n - 1]
    df = spark.createDataFrame([(r,) for r in rows], "id long").select("id", S.permuted(F.col("id"), n, 1).alias("p"))
    got = df.select("id", "p", S.original(F.col("p"), n, 1).alias("back")).collect()
    assert [(r.p, r.back) for r in got] == [(brute_place(r, n, 1), r) for r in rows]


def law_holds(rows, shards=16):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_documents_whatever_their_partitions(spark):
    rng = random.Random(2)
    rows = [(k, None if k % 50 == 0 else "é" * rng.randrange(30), "x", 1) for k in range(700)] + [(None, "same", "y", 2)] * 300 + [(5, "again", "z", 3)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, part int")  # clashing names
    seen = []
    for parts in (1, 7):
        got = S.shard_documents(df.repartition(parts)).collect()
        law_holds(got)
        seen.append(sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got))
    assert seen[0] == seen[1]
    assert sorted((r[0], r[1], r[2]) for r in seen[0]) == sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)


def test_place_and_row_are_computed(spark):
    df = spark.createDataFrame([(k * 3, f"t{k}") for k in range(103)], "doc_id long, text string")
    by = {(r.shard, r.slot): r.doc_id for r in S.shard_documents(df, 5, 9).collect()}
    ask = spark.createDataFrame([(s, t) for s, t in by], "shard int, slot long")
    found = ask.select("shard", "slot", S.row_at(F.col("shard"), F.col("slot"), 103, 5, 9).alias("row")).collect()
    assert all(by[r.shard, r.slot] == r.row * 3 for r in found)


def test_edges(spark):
    assert S.shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = S.shard_documents(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert (one.size, one.text_crc32, one.shard, one.slot, one.grown_shard, one.law) == (1, 0, 0, 0, None, "rows")
    long = "ä b " * 300_000
    got = S.shard_documents(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert got.size == len(long.encode()) + 1 and got.text_crc32 == zlib.crc32(long.encode())


def test_written_shards_hold_whole_rows(spark, tmp_path):
    df = spark.createDataFrame([(k % 40, f"text {k}", k, f"v{k}") for k in range(200)], "doc_id long, text string, slot long, doc string")
    path = f"file://{tmp_path}/shards"
    assert S.write_shards(df, path, 4, 1) == 200
    shards = [S.read_shard(spark, path, k) for k in range(4)]
    assert all(s.columns == df.columns for s in shards)
    rows = [r for s in shards for r in s.collect()]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, df.collect())) and [s.count() for s in shards] == [50] * 4
    told = {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in S.shard_documents(df, 4, 1).collect()}
    for k, s in enumerate(shards):
        for at, r in enumerate(s.collect()):
            assert told[r.doc_id, zlib.crc32(r.text.encode())] == (k, at)


def test_no_python_on_the_main_path(spark):
    plan = S.shard_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
