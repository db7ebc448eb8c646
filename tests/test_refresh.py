import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_lifecycle import DAY, START, aggregate, same, table
from tidemark.operators.ranges import inside, merged, outside, widened
from tidemark.operators.rollup import Rollup, RollupSpec
from tidemark.operators.states import Measure, States
from tidemark.session import new_path
from tidemark.sources.hypertable import Hypertable, HypertableSpec

HOUR = timedelta(hours=1)
SCHEMA = "ts timestamp_ntz, device int, v double"


def day(k):
    return int((START - datetime(1970, 1, 1) + k * DAY) / timedelta(microseconds=1))


def test_range_sets_equal_sets_of_points():
    rng = random.Random(1)
    points = lambda rs: {p for s, e in rs for p in range(s, e)}
    for _ in range(300):
        ranges = [[s, s + rng.randrange(6)] for s in (rng.randrange(60) for _ in range(rng.randrange(9)))]
        low, high = sorted(rng.choices(range(60), k=2))
        one = merged(ranges)
        assert points(one) == points(ranges) and all(a[1] < b[0] for a, b in zip(one, one[1:]))
        assert points(inside(one, low, high)) == points(one) & set(range(low, high))
        assert points(outside(one, low, high)) == points(one) - set(range(low, high))
        assert points(widened(one, 7, 3)) == {p for x in points(one) for p in range(x - (x - 3) % 7, x - (x - 3) % 7 + 7)}
        few = merged(ranges, 2)
        assert len(few) <= 2 and points(few) >= points(one)


def test_appends_say_what_they_touched(spark):
    t = table(spark)
    ranges, version = t.changes(0)
    assert all(any(s <= day(k / 4) < e for s, e in ranges) for k in range(28 * 4)) and version == 1
    t.append(spark.createDataFrame([(START + timedelta(days=2, hours=3), 1, 1.0), (START + timedelta(days=40), 1, 1.0), (datetime(1969, 12, 31, 23), 1, 1.0)], SCHEMA))
    ranges, version = t.changes(1)
    assert version == 2 and len(ranges) == 3 and all(0 < e - s < 60_000_000 for s, e in ranges)
    assert all(any(s <= p < e for s, e in ranges) for p in (day(2.125), day(40), -3_600_000_000))
    t.compress_chunks(t.chunk_starts())
    t.drop_chunks(START)
    assert t.changes(2)[0] == []


def counted(spark, t):
    """A rollup that tells which raw files each aggregation reads."""
    read = []

    def one(df):
        read.append(df.inputFiles())
        return aggregate(df)

    r = Rollup(spark, new_path(spark, "r"), RollupSpec("r", "day", DAY, one, True, ["device"]), t)
    read.clear()
    return r, read


def test_only_what_changed_is_read_again(spark):
    t = table(spark)
    r, read = counted(spark, t)
    assert r.refresh(None, START + 20 * DAY) == [[day(0), day(20)]] and len(read) == 1
    read.clear()
    before = r.table.manifest()["version"]
    assert r.refresh(None, START + 20 * DAY) == [] and read == [] and r.table.manifest()["version"] == before
    t.append(spark.createDataFrame([(START + timedelta(days=2, hours=3), 7, 5.0)], SCHEMA))
    assert r.pending()[0] == [[day(2), day(3)], [day(20), day(28)]]
    assert r.refresh(None, START + 10 * DAY) == [[day(2), day(3)]]
    assert {f.rsplit("/", 2)[-2] for f in read[0]} == {f"chunk_start={day(0) // 10**6}"}
    assert same(r.read(), aggregate(t.scan())) and r.watermark() == START + 20 * DAY
    assert r.refresh(START + 22 * DAY, START + 25 * DAY) == [[day(22), day(25)]]
    assert r.pending()[0] == [[day(20), day(22)], [day(25), day(28)]]


def test_random_appends_and_windows_end_like_the_plain_aggregate(spark):
    rng = random.Random(5)
    t = table(spark)
    r, _ = counted(spark, t)
    for _ in range(6):
        rows = [(START + timedelta(hours=rng.randrange(28 * 24)), rng.randrange(4), float(rng.randrange(9))) for _ in range(rng.randrange(1, 5))]
        t.append(spark.createDataFrame(rows, SCHEMA))
        s = rng.randrange(25)
        r.refresh(START + timedelta(days=s, hours=rng.randrange(24)), START + timedelta(days=s + rng.randrange(1, 8)))
    r.refresh(None, START + 28 * DAY)
    assert r.pending()[0] == [] and same(r.read(real_time=False), aggregate(t.scan())) and same(r.read(), aggregate(t.scan()))


def test_buckets_whose_rows_are_gone_stay_and_do_not_pend_for_ever(spark):
    t = table(spark)
    r, read = counted(spark, t)
    want = aggregate(t.scan()).collect()
    r.refresh(None, START + 28 * DAY)
    t.drop_chunks(START + 14 * DAY)
    read.clear()
    assert r.refresh(None, START + 28 * DAY) == [] and read == []
    assert sorted(map(tuple, r.read().collect())) == sorted(map(tuple, want))


MEASURES = [Measure(k, k, "v", ("ts", "k") if k in ("first", "last") else (), k == "last") for k in ("sum", "count", "avg", "min", "max", "first", "last", "stddev")]


def levels(spark, rows):
    spec = HypertableSpec("raw", "ts", timedelta(days=7))
    t = Hypertable(spark, new_path(spark, "raw"), spec, rows.schema)
    t.append(rows)
    states = States(["device"], MEASURES)
    hours = Rollup(spark, new_path(spark, "h"), RollupSpec("h", "bucket", HOUR, states.partial(HOUR, "ts"), True, ["device"]), t)
    days = Rollup(spark, new_path(spark, "d"), RollupSpec("d", "bucket", DAY, states.merged(DAY), True, ["device"]), hours)
    return t, states, hours, days


def close(got, want):
    key = lambda r: (r.bucket, r.device)
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-9, abs=1e-9)), (a, b)


def test_days_from_hours_equal_days_from_rows(spark):
    rng = random.Random(8)
    data = [(START + timedelta(seconds=rng.randrange(9 * 86400)), k % 3, rng.choice([None, rng.gauss(1e6, 1.0)]), k) for k in range(900)]
    data += [(data[k][0], data[k][1], 5.0, 2000 + k) for k in range(20)]  # equal times
    rows = spark.createDataFrame(data, "ts timestamp_ntz, device int, v double, k int")
    t, states, hours, days = levels(spark, rows)
    plain = lambda: states.final(states.partial(DAY, "ts")(t.scan()))
    close(states.final(days.read()), plain())  # nothing is stored yet
    hours.refresh(None, START + timedelta(days=6, hours=5))
    days.refresh(None, START + 9 * DAY)
    assert days.watermark() == START + 6 * DAY  # a day is stored once all its hours are
    close(states.final(days.read()), plain())
    t.append(spark.createDataFrame([(START + timedelta(days=1, hours=2), 2, 77.0, 5000)], rows.schema))
    hours.refresh(None, START + timedelta(days=6, hours=5))
    t.drop_chunks(START + 7 * DAY)  # the days are made of hours alone
    assert days.refresh(None, START + 9 * DAY) == [[day(1), day(2)]]
    want = states.partial(DAY, "ts")(rows.unionByName(spark.createDataFrame([(START + timedelta(days=1, hours=2), 2, 77.0, 5000)], rows.schema)))
    close(states.final(days.read(None, START + 6 * DAY)), states.final(want).where(F.col("bucket") < F.lit(START + 6 * DAY)))


def test_buckets_must_nest(spark):
    _, states, hours, _ = levels(spark, spark.createDataFrame([(START, 1, 1.0, 1)], "ts timestamp_ntz, device int, v double, k int"))
    with pytest.raises(ValueError):
        Rollup(spark, new_path(spark, "x"), RollupSpec("x", "bucket", timedelta(minutes=90), states.merged(timedelta(minutes=90))), hours)
    with pytest.raises(ValueError):
        Measure("x", "median", "v")
    with pytest.raises(ValueError):
        Measure("x", "last", "v")


def test_updates_rewrite_only_chunks_with_such_rows(spark):
    from tests.test_lifecycle import rows
    from tidemark.operators.tables import convert, update_rows

    t = convert(rows(spark), new_path(spark, "t"), HypertableSpec("t", "ts", timedelta(days=7), ["device"]))
    r, read = counted(spark, t)
    r.refresh(None, START + 28 * DAY)
    before = t.manifest()["chunks"]
    picked = (F.col("device") == 1) & (F.col("ts") < F.lit(START + 6 * DAY))
    assert update_rows(t, picked, v=F.col("v") + 1000) == 1 and update_rows(t, F.lit(False), v=F.lit(0)) == 0
    after = t.manifest()["chunks"]
    assert sum(before[k] != after[k] for k in before) == 1
    want = rows(spark).withColumn("v", F.when(picked, F.col("v") + 1000).otherwise(F.col("v")))
    assert same(t.scan(), want)
    assert r.refresh(None, START + 28 * DAY) == [[day(0), day(7)]] and same(r.read(), aggregate(want))
    with pytest.raises(ValueError):
        update_rows(t, picked, ts=F.lit(None))
