import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cells as C
from tidemark.functions.geo import RADIUS
from tidemark.session import new_path


def metres(a, b):
    (lon1, lat1), (lon2, lat2) = (map(math.radians, p) for p in (a, b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(h)))


def places(seed, n):
    rng = random.Random(seed)
    out = [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(n // 3)]
    out += [(rng.choice([-180, 179.9]) + rng.uniform(0, 0.1), rng.uniform(-1, 1)) for _ in range(n // 3)]  # the date line
    out += [(rng.uniform(-180, 180), rng.choice([-1, 1]) * rng.uniform(89, 90)) for _ in range(n // 3)]  # the poles
    return [*out, (180.0, 0.0), (-180.0, 0.0), (0.0, 90.0), (77.0, 90.0), (0.0, -90.0)]


def table(spark, at, key, lon="lon", lat="lat"):
    rows = [(k, *p) for k, p in enumerate(at)] + [(9000, None, 1.0), (9001, 1.0, None), (9002, 500.0, 0.0), (9003, 0.0, math.nan)]
    return spark.createDataFrame(rows, f"{key} int, {lon} double, {lat} double").repartition(3)


@pytest.mark.parametrize("far", [0.0, 1_500.0, 40_000.0, 900_000.0, 12_000_000.0])
def test_distance_join_equals_brute_force(spark, far):
    a, b = places(1, 90), places(2, 90) + places(1, 9)
    got = C.distance_join(table(spark, a, "i"), table(spark, b, "j", "x", "y"), ("lon", "lat"), ("x", "y"), far).collect()
    want = {(i, j): metres(p, q) for i, p in enumerate(a) for j, q in enumerate(b) if metres(p, q) <= far}
    assert len(got) == len(want) and all(math.isclose(want[r.i, r.j], r.metres, abs_tol=1e-3) for r in got)


def test_nearest_by_growing_circles(spark):
    rng = random.Random(6)
    crowd = [(10 + rng.gauss(0, 0.01), 50 + rng.gauss(0, 0.01)) for _ in range(150)]
    a, b = places(3, 60) + crowd[:20], places(4, 60) + crowd
    left, right = table(spark, a, "i").where("i < 9000"), table(spark, b, "j", "x", "y")
    got, rounds = C.nearest_join(left, right, "i", "j", ("lon", "lat"), ("x", "y"), 4)
    want = {(i, rank): (j, d) for i, p in enumerate(a) for rank, (d, j) in enumerate(sorted((metres(p, q), j) for j, q in enumerate(b))[:4], 1)}
    rows = got.collect()
    assert len(rows) == len(want)
    assert all(math.isclose(want[r.i, r.rank][1], r.metres, abs_tol=1e-3) for r in rows)
    assert rounds[0] == len(a) and len(rounds) > 1 and rounds == sorted(rounds, reverse=True) and sum(rounds) < 6 * len(a)
    few = right.where("j < 2")
    assert sorted((r.i, r.rank) for r in C.nearest_join(left.where("i < 3"), few, "i", "j", ("lon", "lat"), ("x", "y"), 4)[0].collect()) == [(i, r) for i in range(3) for r in (1, 2)]
    assert C.nearest_join(left.limit(0), right, "i", "j", ("lon", "lat"), ("x", "y"), 4)[0].collect() == []
    assert C.nearest_join(left.where("i < 3"), right.limit(0), "i", "j", ("lon", "lat"), ("x", "y"), 4)[0].collect() == []


def test_cells_and_covers(spark):
    rng = random.Random(5)
    at = places(7, 60)
    got = [r.c for r in spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "k int, lon double, lat double").orderBy("k").select(C.cell(F.col("lon"), F.col("lat")).alias("c")).collect()]
    n = 1 << C.BITS
    assert got == [C._interleave(min(int((x + 180) / 360 * n), n - 1), min(int((y + 90) / 180 * n), n - 1)) for x, y in at]
    for _ in range(20):
        p, far = rng.choice(at), rng.choice([10.0, 3_000.0, 200_000.0])
        ranges = [r for box in C.boxes(*p, far) for r in C.cover(*box)]
        assert len(ranges) <= 64
        assert all(any(s <= c <= e for s, e in ranges) for c, q in zip(got, at) if metres(p, q) <= far)


def test_a_radius_reads_ranges_of_cells(spark):
    rng = random.Random(2)
    at = [(rng.uniform(-110, -90), rng.uniform(25, 45)) for _ in range(4_000)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "k int, lon double, lat double")
    path = new_path(spark, "cells")
    C.write_by_cells(df, path, F.col("lon"), F.col("lat"), files=16)
    stored = spark.read.parquet(path)
    near = C.within_by_cells(stored, "cell", F.col("lon"), F.col("lat"), -102.0, 31.0, 60_000.0)
    assert sorted(r.k for r in near.collect()) == [k for k, p in enumerate(at) if metres(p, (-102.0, 31.0)) <= 60_000]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(cell," in plan
    spans = [(r.low, r.high) for r in stored.groupBy(F.input_file_name()).agg(F.min("cell").alias("low"), F.max("cell").alias("high")).collect()]
    ranges = [r for box in C.boxes(-102.0, 31.0, 60_000.0) for r in C.cover(*box)]
    assert sum(any(s <= high and e >= low for s, e in ranges) for low, high in spans) <= 4  # of 16 files


def test_rows_at_one_place_meet_by_blocks_and_distances_are_of_places(spark, monkeypatch):
    monkeypatch.setattr(C, "_BLOCK", 50)
    left = spark.range(400).select(F.col("id").alias("i"), (F.col("id") % 2).cast("double").alias("lon"), F.lit(10.0).alias("lat"))
    right = spark.range(600).select(F.col("id").alias("j"), (F.col("id") % 3).cast("double").alias("x"), F.lit(10.0).alias("y"))
    got = C.distance_join(left, right, ("lon", "lat"), ("x", "y"), 1_000.0)
    assert sorted((r.i, r.j, r.metres) for r in got.collect()) == [(i, j, 0.0) for i in range(400) for j in range(600) if i % 2 == j % 3]
    tasks = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) > 6 and max(tasks) < 0.4 * 80_000
    near, rounds = C.nearest_join(left, right, "i", "j", ("lon", "lat"), ("x", "y"), 4)
    assert sorted((r.i, r["rank"], r.j) for r in near.collect()) == [(i, k + 1, i % 2 + 3 * k) for i in range(400) for k in range(4)]
    assert rounds[0] == 2  # places, not rows
