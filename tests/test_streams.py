from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_lifecycle import DAY, START, aggregate, rows, same
from tidemark.operators.rollup import Rollup, RollupSpec
from tidemark.session import new_path
from tidemark.sources.hypertable import Hypertable, HypertableSpec
from tidemark.streaming.ingest import Ingest
from tidemark.streaming.rollup import bucket_stream, read_live, write_live


def parts(spark, source, *frames):
    at = len(source[1])
    for k, df in enumerate(frames, at):
        df.coalesce(1).write.parquet(f"{source[0]}/part={k}")
        source[1].append(k)


def stream(spark, source, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source[0]}/*")


@pytest.mark.parametrize("breaks", ["before", "after the rows", "after the refresh"])
def test_a_lost_driver_leaves_each_row_once(spark, breaks):
    all_rows = rows(spark)
    source = (new_path(spark, "in"), [])
    parts(spark, source, all_rows.where("device = 0"), all_rows.where("device = 1"))
    t = Hypertable(spark, new_path(spark, "t"), HypertableSpec("t", "ts", timedelta(days=7), ["device"]), all_rows.schema)
    r = Rollup(spark, new_path(spark, "r"), RollupSpec("r", "day", DAY, aggregate, True, ["device"]), t)

    class Breaks(Ingest):
        def put(self, batch, number):
            if number == 1 and breaks == "before":
                raise RuntimeError("lost")
            rollups, self.rollups = self.rollups, [] if breaks == "after the rows" else self.rollups
            super().put(batch, number)
            self.rollups = rollups
            if number == 1:
                raise RuntimeError("lost")

    good = Ingest(t, new_path(spark, "state"), [r], 2 * DAY)
    with pytest.raises(Exception, match="lost"):
        Breaks(t, good.checkpoint, [r], 2 * DAY).start(stream(spark, source, all_rows.schema)).awaitTermination()
    parts(spark, source, all_rows.where("device = 2"))
    good.start(stream(spark, source, all_rows.schema)).awaitTermination()
    assert same(t.scan(), all_rows)
    assert same(r.read(), aggregate(all_rows)) and r.watermark() == START + 25 * DAY  # whole days, two before the newest row
    assert same(r.read(real_time=False), aggregate(all_rows).where(F.col("day") < F.lit(START + 25 * DAY)))
    version = t.manifest()["version"]
    good.start(stream(spark, source, all_rows.schema)).awaitTermination()
    assert t.manifest()["version"] == version


def test_another_stream_into_the_same_table_counts_its_own_batches(spark):
    all_rows = rows(spark, days=2)
    t = Hypertable(spark, new_path(spark, "t"), HypertableSpec("t", "ts", timedelta(days=7)), all_rows.schema)
    for _ in range(2):
        source = (new_path(spark, "in"), [])
        parts(spark, source, all_rows)
        Ingest(t, new_path(spark, "state")).start(stream(spark, source, all_rows.schema)).awaitTermination()
    assert t.scan().count() == 2 * all_rows.count()


def test_open_buckets_show_and_late_rows_correct_them(spark):
    all_rows = rows(spark, days=6)
    source, out, state = (new_path(spark, "in"), []), new_path(spark, "out"), new_path(spark, "state")
    buckets = lambda: bucket_stream(stream(spark, source, all_rows.schema), "ts", "1 day", ["device"], [F.sum("v").alias("s"), F.count("*").alias("n")], "10 days")
    seen = all_rows.limit(0)
    for part in (F.col("v") % 2 == 0, F.col("v") % 4 == 1, F.col("v") % 4 == 3):
        parts(spark, source, all_rows.where(part))
        seen = seen.unionByName(all_rows.where(part))
        write_live(buckets(), out, state).awaitTermination()
        got = read_live(spark, out, buckets().schema, ["device"]).withColumnRenamed("bucket", "day")
        assert same(got, aggregate(seen))
    assert spark.read.parquet(out).count() > got.count()  # corrections stand beside what they correct
