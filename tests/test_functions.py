import math
import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.numeric import pretty_bytes, rint_int, round_num, safe_div
from tidemark.functions.timeseries import first_by, last_by, order_key, time_bucket
from tidemark.functions.vector import cosine_distance, nearest, parse_vector
from tidemark.operators.joins import range_join, validate
from tidemark.sources.files import each_of, pg_array, read_csv, time_series, write_csv


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_buckets_count_from_a_monday(spark):
    at = F.lit(datetime(2026, 1, 7, 13, 44, 59)).cast("timestamp_ntz")
    r = one(spark, time_bucket(timedelta(days=7), at).alias("w"), time_bucket(timedelta(minutes=30), at).alias("m"), time_bucket(timedelta(hours=4), at).alias("h"), time_bucket(timedelta(days=1), F.lit(None).cast("timestamp_ntz")).alias("n"), time_bucket(timedelta(days=7), F.lit(datetime(1999, 12, 30)).cast("timestamp_ntz")).alias("b"))
    assert tuple(r) == (datetime(2026, 1, 5), datetime(2026, 1, 7, 13, 30), datetime(2026, 1, 7, 12), None, datetime(1999, 12, 27))


def test_first_and_last_break_ties_and_skip_rows_without_time(spark):
    rows = [(1, 5.0, 1), (1, 6.0, 2), (9, None, 3), (None, 7.0, 4)]
    df = spark.createDataFrame(rows, "t int, v double, k int")
    assert tuple(df.agg(first_by("v", "t", "k"), last_by("v", "t", "k")).first()) == (5.0, None)
    assert tuple(df.where("t is null").agg(first_by("v", "t", "k"), last_by("v", "t", "k")).first()) == (None, None)


def test_one_number_orders_as_time_and_tie_do(spark):
    at = [datetime(1, 1, 1), datetime(1969, 12, 31, 23, 59, 59, 999_999), datetime(1970, 1, 1), datetime(2024, 1, 1), datetime(9999, 12, 31, 23, 59, 59, 999_999), None]
    ties = [None, -(1 << 63), -1, 0, 1, (1 << 63) - 1]
    rows = [(t, k, f"{t} {k}") for t in at for k in ties]
    df = spark.createDataFrame(rows, "t timestamp_ntz, k long, v string")
    key = order_key(F.col("t"), F.col("k"), whole=True)
    got = [r.v for r in df.where("t is not null").orderBy(key).collect()]
    assert got == [v for _, _, v in rows if not v.startswith("None")]
    assert df.where("t is null").where(key.isNotNull()).count() == 0
    for edge in (first_by, last_by):
        assert df.agg(edge("v", "t", "k")).first() == df.agg(edge("v", "t", "k", whole=True)).first()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
@pytest.mark.parametrize("name", ["fin_ohlc", "iot_30m"])
def test_candles_and_last_values_sort_no_rows(spark, name):
    from tidemark.plans import catalogue

    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan


def test_numbers(spark):
    r = one(spark, round_num(F.lit(0.125), 2).cast("string").alias("a"), round_num(F.lit(2.5), 0).cast("int").alias("b"), rint_int(F.lit(0.6)).alias("c"), safe_div(F.lit(1.0), F.lit(0.0)).alias("d"), pretty_bytes(F.lit(32 * 1024**2)).alias("e"))
    assert tuple(r) == ("0.13", 3, 1, None, "32 MB")


@pytest.mark.parametrize("text,want", [("{a,b}", ["a", "b"]), ('{"a,b",NULL,c}', ["a,b", None, "c"]), ("{}", []), (None, None)])
def test_arrays_in_text(spark, text, want):
    assert one(spark, pg_array(F.lit(text).cast("string")).alias("a"))["a"] == want


def test_distances():
    miles = geo.vincenty_metres(np.array([-73.79]), np.array([40.641]), np.array([-73.79]), np.array([40.641]))
    assert miles[0] == 0
    equator = geo.vincenty_metres([0.0], [0.0], [1.0], [0.0])[0]
    assert math.isclose(equator, 111319.491, abs_tol=0.01)
    meridian = geo.vincenty_metres([0.0], [0.0], [0.0], [1.0])[0]
    assert math.isclose(meridian, 110574.389, abs_tol=0.01)
    assert np.isnan(geo.vincenty_metres([0.0], [0.0], [179.9], [0.1])[0])


def test_places_within_a_radius_near_the_date_line_and_the_pole(spark):
    rows = [(1, 179.95, 0.0), (2, -179.95, 0.0), (3, 0.0, 0.0), (4, 90.0, 89.9), (5, -90.0, 89.9)]
    df = spark.createDataFrame(rows, "id int, lon double, lat double")
    near = df.where(geo.within(F.col("lon"), F.col("lat"), 179.99, 0.0, 20_000)).select("id").collect()
    assert {r.id for r in near} == {1, 2}
    assert {r.id for r in df.where(geo.within(F.col("lon"), F.col("lat"), 0.0, 90.0, 20_000)).collect()} == {4, 5}


def test_zero_vectors_rank_last(spark):
    df = spark.createDataFrame([(1, "[0.0, 0.0]"), (2, "[1.0, 0.0]"), (3, "[0.0, 2.0]"), (4, None)], "id int, v string").select("id", parse_vector(F.col("v")).alias("v"))
    assert [r.id for r in nearest(df, "v", parse_vector(F.lit("[1.0, 0.0]")), 4, "id").collect()] == [2, 3, 1, 4]
    assert math.isnan(one(spark, cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("d"))["d"])


def test_a_reading_on_a_shared_edge_counts_twice(spark):
    facts = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "k int, at int")
    spans = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, 20, "b")], "k int, low int, high int, name string")
    got = range_join(facts, spans, ["k"], "at", "low", "high").collect()
    assert sorted((r.k, r["at"], r.name) for r in got) == [(1, 10, "a"), (1, 10, "b"), (1, 11, "b")]


def test_constraints_are_counted(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "z", 9)], "id int, kind string, ref int")
    other = spark.createDataFrame([(1,), (2,)], "key int")
    got = {r.rule: r.violations for r in validate(df, ["id"], ["id"], {"kind": ["x", "y"]}, {"ref": (other, "key")}).collect()}
    assert got == {"id is not null": 1, "kind is one of 2 values": 1, "id is unique": 1, "ref refers to key": 1}


def test_csv_plain_and_gzip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 2.5), (2, None, None)], "id int, name string, v double")
    write_csv(df, f"{tmp_path}/plain")
    df.write.option("header", True).option("compression", "gzip").csv(f"{tmp_path}/gz")
    for kind in ("plain", "gz"):
        got = read_csv(spark, f"{tmp_path}/{kind}", "id int, name string, v double", ["v", "id"])
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(2.5, 1), (None, 2)], key=str)


def test_series(spark):
    got = time_series(spark, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 1), timedelta(seconds=5)).collect()
    assert len(got) == 13 and got[-1].ts == datetime(2024, 1, 1, 0, 1)
    assert time_series(spark, datetime(2024, 1, 2), datetime(2024, 1, 1), timedelta(seconds=5)).count() == 0
    df = spark.createDataFrame([(1, 2), (2, 0)], "id int, n int")
    assert [(r.id, r.k) for r in each_of(df, F.lit(1), F.col("n"), "k").collect()] == [(1, 1), (1, 2)]
