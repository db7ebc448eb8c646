from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.timeseries import time_bucket
from tidemark.operators.policies import Policies
from tidemark.operators.rollup import Rollup, RollupSpec
from tidemark.session import new_path
from tidemark.sources.hypertable import Hypertable, HypertableSpec

DAY = timedelta(days=1)
START = datetime(2024, 1, 4)  # chunks of seven days count from 1970-01-01, a Thursday


def rows(spark, days=28, per_day=4):
    data = [(START + timedelta(hours=24 * k / per_day), k % 3, float(k)) for k in range(days * per_day)]
    return spark.createDataFrame(data, "ts timestamp_ntz, device int, v double")


def table(spark, **options):
    t = Hypertable(spark, new_path(spark, "t"), HypertableSpec("t", "ts", timedelta(days=7), ["device"], bloom=["device"], **options), rows(spark).schema)
    t.append(rows(spark))
    return t


def aggregate(df):
    return df.groupBy(time_bucket(DAY, "ts").alias("day"), "device").agg(F.sum("v").alias("s"), F.count("*").alias("n"))


def same(a, b):
    key = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)
    return key(a) == key(b)


def test_scans_read_only_the_chunks_of_their_range(spark):
    t = table(spark)
    assert len(t.chunk_starts()) == 4
    part = t.scan(START + timedelta(days=8), START + timedelta(days=9))
    assert len({f.rsplit("/", 1)[0] for f in part.inputFiles()}) == 1
    assert same(part, rows(spark).where((F.col("ts") >= START + timedelta(days=8)) & (F.col("ts") < START + timedelta(days=9))))
    assert same(t.scan(), rows(spark))
    assert same(Hypertable(spark, t.path, t.spec).scan(), rows(spark))


def test_compacting_tiering_and_dropping_keep_what_they_should(spark):
    t = table(spark)
    first, second, *_ = t.chunk_starts()
    t.compress_chunk(first)
    t.compress_chunk(first)
    t.tier_chunk(second)
    assert same(t.scan(), rows(spark))
    assert t.scan(tiered=False).count() == rows(spark).count() - 28
    chunks = {r.chunk_name: r for r in t.chunks().collect()}
    assert chunks[f"t_{first}"].is_compressed and chunks[f"t_{second}"].is_tiered and chunks[f"t_{first}"].after_bytes > 0
    assert t.compression_stats().first().compressed_chunks == 2
    assert t.drop_chunks(START + timedelta(days=13)) == [first]  # the second chunk ends a day later
    assert t.scan().agg(F.min("ts")).first()[0] == START + timedelta(days=7)


def test_of_two_writers_one_fails(spark):
    a = table(spark)
    b = Hypertable(spark, a.path, a.spec)
    m = b.manifest()
    a.append(rows(spark).limit(1))
    with pytest.raises(Exception, match="already exists"):
        b._publish(m)


def rollup(spark, real_time=True):
    t = table(spark)
    return t, Rollup(spark, new_path(spark, "r"), RollupSpec("r", "day", DAY, aggregate, real_time, ["device"]), t)


def test_a_real_time_read_equals_the_plain_aggregate(spark):
    t, r = rollup(spark)
    assert same(r.read(), aggregate(t.scan()))  # nothing is stored yet
    r.refresh(START + timedelta(hours=5), START + timedelta(days=9, hours=7))
    assert r.watermark() == START + timedelta(days=9)
    assert same(r.read(START + DAY), aggregate(t.scan(START + DAY)))
    assert r.read(real_time=False).agg(F.max("day")).first()[0] == START + timedelta(days=8)
    assert same(r.read(START + timedelta(days=3), START + timedelta(days=12)), aggregate(t.scan(START + timedelta(days=3), START + timedelta(days=12))))


def test_new_rows_show_at_once_and_late_rows_after_a_refresh(spark):
    t, r = rollup(spark)
    r.refresh(None, START + timedelta(days=20))
    late = [(START + timedelta(days=2), 7, 1.0), (START + timedelta(days=29), 7, 1.0)]
    t.append(spark.createDataFrame(late, t.schema))
    assert [x.day for x in r.read().where("device = 7").collect()] == [START + timedelta(days=29)]
    r.refresh(START, START + timedelta(days=5))
    assert same(r.read(), aggregate(t.scan()))
    assert r.watermark() == START + timedelta(days=20)


def test_policies_run_when_due_and_rollups_outlive_raw_chunks(spark):
    t, r = rollup(spark)
    want = aggregate(t.scan()).collect()
    p = Policies()
    p.add("drop", t, timedelta(days=14))
    p.add("refresh", r, timedelta(days=60), DAY)
    p.add("compress", t, timedelta(days=7), if_not_exists=True)
    assert p.add("compress", t, timedelta(days=3), if_not_exists=True) == 1002
    with pytest.raises(ValueError):
        p.add("drop", t, timedelta(days=1))
    now = START + timedelta(days=28)
    assert p.run_due(now) == [1001, 1002, 1000] and p.run_due(now) == []
    assert len(t.chunk_starts()) == 2
    assert sorted(map(tuple, r.read().collect())) == sorted(map(tuple, want))
    p.run(1001, now + DAY)
    assert sorted(map(tuple, r.read().collect())) == sorted(map(tuple, want))
    assert p.catalog(spark).where("kind = 'drop'").first().after_seconds == 14 * 86400


def test_a_large_chunk_is_written_by_several_tasks(spark):
    many = spark.range(200_000).select((F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("ts"), (F.col("id") % 3).cast("int").alias("device"), F.rand(1).alias("v"))
    t = Hypertable(spark, new_path(spark, "t"), HypertableSpec("t", "ts", timedelta(days=7), ["device"]), many.schema)
    with_small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "400k", "spark.sql.files.maxPartitionBytes": "1m"}
    before = {k: spark.conf.get(k) for k in with_small}
    try:
        for k, v in with_small.items():
            spark.conf.set(k, v)
        t.append(many)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(t.chunk_starts()) == 1 and len(t.scan().inputFiles()) > 1 and t.scan().count() == 200_000


def test_rows_without_a_time_are_refused(spark):
    t = table(spark)
    with pytest.raises(Exception, match="has no ts"):
        t.append(spark.createDataFrame([(None, 1, 1.0)], "ts timestamp_ntz, device int, v double"))
    assert same(t.scan(), rows(spark)) and t.chunks().count() == 4


def test_old_snapshots_stay(spark):
    t = table(spark)
    old = t.scan()
    t.compress_chunks(t.chunk_starts())
    assert same(old, rows(spark))


def test_a_rewritten_folder_is_read_anew(spark, tmp_path):
    from tidemark.plans import catalogue

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for n in (5, 9):
        rows = [(k, START + timedelta(days=k), k, "view", 1.0, "") for k in range(n)]
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        assert catalogue.QUERIES["iot_tier_reads"](spark, str(tmp_path)).first().all_rows == n
        assert catalogue.QUERIES["fin_chunks"](spark, str(tmp_path)).count() == 1 + (n > 7)


def test_decompress_columns_options_and_description(spark):
    t = table(spark)
    first = t.chunk_starts()[0]
    t.compress_chunk(first)
    t.decompress_chunk(first)
    t.decompress_chunk(first)
    assert same(t.scan(), rows(spark)) and t.chunks().where("is_compressed").count() == 0
    t.add_column("note", "string")
    t.append(rows(spark, days=1, per_day=1).withColumn("note", F.lit("x")))
    assert t.scan().where("note = 'x'").count() == 1 and t.scan().where("note is null").count() == rows(spark).count()
    t.set_options(segment_by=["note"], bloom=["note"])
    t.compress_chunk(first)
    assert [(r.column_name, r.data_type, r.role) for r in t.describe().collect()] == [("ts", "timestamp_ntz", "time"), ("device", "int", None), ("v", "double", None), ("note", "string", "segment")]
    t.drop()
    assert t.store.names(t.path) == []


def test_saved_policies_go_on_in_another_session(spark):
    t, r = rollup(spark)
    p, path, now = Policies(), new_path(spark, "jobs"), START + timedelta(days=28)
    p.add("refresh", r, timedelta(days=60), DAY)
    p.add("drop", t, timedelta(days=14), every=timedelta(days=3))
    p.run(1000, now)
    p.save(spark, path)
    q = Policies.load(spark, path, [t, r])
    assert q.jobs == p.jobs
    assert q.run_due(now) == [1001] and q.run_due(now + DAY) == [1000] and len(t.chunk_starts()) == 2
    q.save(spark, path)
    assert Policies.load(spark, path, [t, r]).run_due(now + DAY) == []
