import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.session import new_path
from tidemark.sources.clustered import interleaved, rows_scanned, time_range, write_clustered


def test_bits_are_taken_in_turn(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1 << 9), rng.randrange(1 << 9), rng.randrange(1 << 9)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    got = df.select("a", "b", "c", interleaved([F.col("a"), F.col("b"), F.col("c")], 9).alias("z")).collect()
    assert all(r.z == sum((x >> k & 1) << 3 * k + 2 - i for i, x in enumerate(r[:3]) for k in range(9)) for r in got)
    with pytest.raises(ValueError):
        interleaved([F.col("a")] * 7, 9)


def test_filters_on_either_column_read_few_rows(spark):
    n, start = 100_000, datetime(2024, 1, 1)
    at = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 26)
    df = spark.range(n).select(F.when(F.col("id") % 1000 > 0, at).alias("ts"), (F.col("id") * 7919 % 97).alias("user"), F.concat(F.lit("tag"), F.col("id") * 31 % 5000).alias("tag"))
    path = new_path(spark, "clustered")
    write_clustered(df, path, ["ts", "user"], files=256, bloom=["tag"])
    stored = spark.read.parquet(path)
    low, high = start + timedelta(days=9), start + timedelta(days=10)
    day = (F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.lit(high).cast("timestamp_ntz"))
    for picked, same in ((stored.where("user = 7"), df.where("user = 7")), (stored.where(time_range("ts", low, high)), df.where(day))):
        assert rows_scanned(picked) <= n / 5
        assert sorted(map(str, picked.drop("ts_micros").collect())) == sorted(map(str, same.collect()))
    assert rows_scanned(stored.where("tag = 'nowhere'")) < n / 5  # in the range of every group; the bloom filters know
    plain = new_path(spark, "plain")
    df.orderBy("ts").write.parquet(plain)
    assert rows_scanned(spark.read.parquet(plain).where("user = 7")) == n
    assert stored.count() == n
    with pytest.raises(TypeError):
        write_clustered(df, new_path(spark, "x"), ["tag"])
    empty = new_path(spark, "empty")
    write_clustered(df.limit(0), empty, ["ts", "user"])
