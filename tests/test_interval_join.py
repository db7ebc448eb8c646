import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.interval_join import interval_join


def brute(a, b, keyed):
    return sorted((x[0], y[0]) for x in a for y in b if None not in (*x[2:], *y[2:]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3] and (not keyed or x[1] is not None and x[1] == y[1]))


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("salts", [1, 3])
def test_equals_brute_force(spark, keyed, salts):
    rng = random.Random(3)

    def side(n):
        out = []
        for k in range(n):
            low = rng.choice([rng.randrange(-5_000, 5_000), 0, 4**5, -(4**4)])
            out.append((k, rng.choice([1, 1, 1, 2, None]), low, low + rng.choice([0, 0, 1, 3, 17, 300, 20_000, -1])))
        return [*out, (n, 1, None, 5), (n + 1, 1, 5, None)]

    a, b = side(150), side(120)
    left = spark.createDataFrame(a, "i int, key int, low long, high long")
    right = spark.createDataFrame(b, "j int, key int, start long, stop long")
    if not keyed:
        right = right.withColumnRenamed("key", "other")
    got = interval_join(left, right, ("low", "high"), ("start", "stop"), ["key"] if keyed else [], salts)
    assert sorted((r.i, r.j) for r in got.collect()) == brute(a, b, keyed)
    assert got.columns == (["i", "key", "low", "high", "j", "start", "stop"] if keyed else ["i", "key", "low", "high", "j", "other", "start", "stop"])


def test_moments_of_time_in_spans_share_edges(spark):
    t = lambda h: datetime(1969, 12, 31) + timedelta(hours=h)
    at = spark.createDataFrame([(k, t(k)) for k in range(48)], "k int, at timestamp_ntz")
    spans = spark.createDataFrame([("a", t(3), t(10)), ("b", t(10), t(30)), ("c", t(47), t(90))], "name string, low timestamp_ntz, high timestamp_ntz")
    got = interval_join(at, spans, ("at", "at"), ("low", "high")).collect()
    assert sorted((r.k, r.name) for r in got) == sorted([(k, "a") for k in range(3, 11)] + [(k, "b") for k in range(10, 31)] + [(47, "c")])
    assert interval_join(at.limit(0), spans, ("at", "at"), ("low", "high")).collect() == []
    with pytest.raises(ValueError):
        interval_join(at, at, ("at", "at"), ("at", "at"))
    with pytest.raises(TypeError):
        interval_join(at.withColumn("x", F.lit("a")), spans, ("x", "x"), ("low", "high"))


def test_a_stage_with_half_of_all_readings_runs_in_several_tasks(spark):
    n = 20_000
    facts = spark.range(n).select(F.when(F.col("id") < n // 2, 0).otherwise(F.col("id") % 50 + 1).alias("stage"), (F.col("id") * 7919 % 1_000_000).alias("at"))
    spans = spark.range(51 * 200).select((F.col("id") % 51).cast("int").alias("stage"), F.expr("id div 51 * 5000").alias("low"), F.expr("id div 51 * 5000 + 4999").alias("high"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = interval_join(facts, spans, ("at", "at"), ("low", "high"), ["stage"])
        tasks = [r.n for r in got.where("stage = 0").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(tasks) == n // 2 and len(tasks) >= 6 and max(tasks) < n // 4
