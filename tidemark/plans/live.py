"""Rollups that follow what is written: late rows, rollups of rollups, streams. events plays the readings."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeseries import time_bucket
from tidemark.operators.joins import validate
from tidemark.operators.rollup import Rollup, RollupSpec
from tidemark.operators.states import Measure, States
from tidemark.operators.tables import convert, update_rows
from tidemark.operators.timing import explain_analyze
from tidemark.plans.registry import Tables, dt, query, r8
from tidemark.plans.sensors import HOUR_MEANS, HOUR_SUMS, HOURLY, PLAYED
from tidemark.plans.sensors import _oee as stored_hours
from tidemark.session import new_path
from tidemark.sources.clustered import rows_scanned, time_range, write_clustered
from tidemark.sources.files import read_csv, write_csv
from tidemark.sources.hypertable import Hypertable, HypertableSpec
from tidemark.streaming.ingest import Ingest
from tidemark.streaming.rollup import bucket_stream, read_live, write_live

HOUR, DAY, WEEK = timedelta(hours=1), timedelta(days=1), timedelta(days=7)


def _days(rows: DataFrame) -> DataFrame:
    return rows.groupBy(time_bucket(DAY, "ts").alias("day"), "event_type").agg(r8(F.avg("value")).alias("mean"), F.max("value").alias("top"), F.count("*").alias("n"))


DAYS = "SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, round(avg(value), 8) AS mean, max(value) AS top, count(*) AS n FROM events {} GROUP BY 1, 2"


def _empty(t: Tables, name: str) -> Hypertable:
    return Hypertable(t.spark, new_path(t.spark, name), HypertableSpec(name, "ts", WEEK, ["user_id"], [F.col("ts").desc()]), t.events.schema)


@query("wel_refresh_changed", DAYS.format("WHERE event_type <> 'error' OR ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' OR ts >= TIMESTAMP '2024-01-25'"))
def refresh_changed(t: Tables) -> DataFrame:
    """Errors come in late, over the whole month. A refresh of two weeks takes in those of its days, and reads no other
    day; outside, they pend; above the watermark they show at once."""
    table = _empty(t, "readings")
    table.append(t.events.where("event_type <> 'error'"))
    rollup = Rollup(t.spark, new_path(t.spark, "days"), RollupSpec("days", "day", DAY, _days), table)
    rollup.refresh(None, dt("2024-01-25"))
    table.append(t.events.where("event_type = 'error'"))
    rollup.refresh(dt("2024-01-05"), dt("2024-01-20"))
    return rollup.read()


@query("wel_refresh_pending", "SELECT count(DISTINCT time_bucket(INTERVAL '1 day', ts)) AS days FROM events WHERE event_type = 'error' AND (ts < TIMESTAMP '2024-01-05' OR ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-25')")
def refresh_pending(t: Tables) -> DataFrame:
    """The days below the watermark that still pend after the refresh above."""
    table = _empty(t, "readings")
    table.append(t.events.where("event_type <> 'error'"))
    rollup = Rollup(t.spark, new_path(t.spark, "days"), RollupSpec("days", "day", DAY, _days), table)
    rollup.refresh(None, dt("2024-01-25"))
    table.append(t.events.where("event_type = 'error'"))
    rollup.refresh(dt("2024-01-05"), dt("2024-01-20"))
    mark = int((rollup.watermark() - dt("1970-01-01")) / timedelta(microseconds=1))
    days = sum((min(e, mark) - s) // 86_400_000_000 for s, e in rollup.pending()[0] if s < mark)
    return t.spark.range(1).select(F.lit(days).cast("long").alias("days"))


@query("iot_clustered", "SELECT 'user' AS kind, count(*) AS n, round(sum(value), 6) AS total, true AS skipped FROM events WHERE user_id = 7 UNION ALL SELECT 'day', count(*), round(sum(value), 6), true FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def clustered(t: Tables) -> DataFrame:
    """Readings clustered by time and user: a filter on either leaves most files unread."""
    path = new_path(t.spark, "clustered")
    write_clustered(t.events, path, ["ts", "user_id"], files=64)
    rows = t.spark.read.parquet(path)
    day = time_range("ts", dt("2024-01-10"), dt("2024-01-11"))
    out = None
    for kind, picked in (("user", rows.where("user_id = 7")), ("day", rows.where(day))):
        few = rows_scanned(picked) <= 0.4 * rows.count()
        one = picked.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.lit(few).alias("skipped"))
        out = one if out is None else out.unionByName(one)
    return out


@query("oee_2mo_timing", f"SELECT 'raw' AS side, (SELECT count(*) FROM events) AS n, true AS timed, true AS planned UNION ALL SELECT 'rollup', (SELECT count(*) FROM {HOURLY}), true, true")
def timing(t: Tables) -> DataFrame:
    """As oee_2mo_explain, with what it says of plans and clock: scans in each plan, the raw one of events."""
    runs = {"raw": explain_analyze(t.events.select("ts", "event_type", "value")), "rollup": explain_analyze(stored_hours(t).read())}
    rows = [(side, run.rows, 0 < run.seconds < 3600, "Scan parquet" in run.plan and ("HashAggregate" in run.plan) == (side == "rollup")) for side, run in runs.items()]
    return t.spark.createDataFrame(rows, "side string, n long, timed boolean, planned boolean")


@query("iot_stats_whole", "SELECT count(DISTINCT CAST(epoch(ts) AS BIGINT) // 604800) AS compressed_chunks, true AS smaller FROM events")
def stats_whole(t: Tables) -> DataFrame:
    """Sizes of the compacted chunks, all of them, after against before."""
    told = t.hypertable(compress=True).compression_stats()
    return told.select("compressed_chunks", ((F.col("before_bytes") > 0) & (F.col("after_bytes") > 0) & (F.col("after_bytes") < 2 * F.col("before_bytes"))).alias("smaller"))


# files and constraints -------------------------------------------------------------------------------------


@query("src_csv", "SELECT c_custkey, c_name, c_acctbal, 'plain' AS kind FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal, 'gzip' FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal, 'semicolon' FROM customer")
def csv_files(t: Tables) -> DataFrame:
    """A table as CSV, plain, gzipped and with another delimiter, read back with a declared schema and a column list."""
    out = None
    for kind in ("plain", "gzip", "semicolon"):
        path, mark = new_path(t.spark, "csv"), ";" if kind == "semicolon" else ","
        if kind == "plain":
            write_csv(t.customer, path)
        else:
            t.customer.write.options(header=True, sep=mark, compression="gzip" if kind == "gzip" else "none").csv(path)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.customer.schema)
        one = read_csv(t.spark, path, ddl, ["c_custkey", "c_name", "c_acctbal"], delimiter=mark).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


BROKEN = {
    "l_linenumber is one of 2 values": "SELECT count(*) FROM lineitem WHERE l_linenumber NOT IN (1, 2)",
    "l_orderkey is unique": "SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)",
    "l_orderkey refers to c_custkey": "SELECT count(*) FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT c_custkey FROM customer)",
}


@query("constraints_violated", " UNION ALL ".join(f"SELECT '{rule}' AS rule, CAST(({sql}) AS BIGINT) AS violations" for rule, sql in BROKEN.items()))
def constraints_violated(t: Tables) -> DataFrame:
    """Rules that the table breaks, with how often."""
    return validate(t.lineitem, [], ["l_orderkey"], {"l_linenumber": [1, 2]}, {"l_orderkey": (t.customer, "c_custkey")})


@query("cmp_update", DAYS.replace("FROM events {}", "FROM (SELECT ts, event_type, CASE WHEN user_id = 5 THEN value * 2 ELSE value END AS value FROM events)"))
def updated(t: Tables) -> DataFrame:
    """An update of a chunked table rewrites the chunks that hold its rows; a refresh takes in what it changed."""
    table = convert(t.events, new_path(t.spark, "readings"), HypertableSpec("readings", "ts", WEEK, ["user_id"]))
    rollup = Rollup(t.spark, new_path(t.spark, "days"), RollupSpec("days", "day", DAY, _days), table)
    rollup.refresh(None, dt("2024-02-01"))
    update_rows(table, F.col("user_id") == 5, value=F.col("value") * 2)
    rollup.refresh(None, dt("2024-02-01"))
    return rollup.read()


@query("src_convert", "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def converted(t: Tables) -> DataFrame:
    """A plain table made a chunked one, of which a scan of ten days reads the chunks it needs."""
    table = convert(t.events, new_path(t.spark, "readings"), HypertableSpec("readings", "ts", WEEK, ["user_id"]))
    return table.scan(dt("2024-01-10"), dt("2024-01-20")).select("event_id", "ts", "value")


# rollups of rollups ----------------------------------------------------------------------------------------

EDGES = [Measure("first_value", "first", "value", ("time", "event_id"), True), Measure("last_value", "last", "value", ("time", "event_id"), True), Measure("low", "min", "value"), Measure("high", "max", "value"), Measure("deviation", "stddev", "value"), Measure("n", "count", "1")]
LINES = States(["line_id"], [*(Measure(c, "sum", c) for c in HOUR_SUMS), *(Measure(c, "avg", c) for c in HOUR_MEANS), *EDGES])
DAY_SQL = ", ".join(
    [f"CAST(sum({PLAYED[c]}) AS BIGINT) AS {c}" for c in HOUR_SUMS[:-1]]
    + ["round(sum(value), 6) AS energy_kwh"]
    + [f"round(avg({PLAYED[c]}), 8) AS {c}" for c in HOUR_MEANS]
    + ["arg_min_null(value, (ts, event_id)) AS first_value, arg_max_null(value, (ts, event_id)) AS last_value, min(value) AS low, max(value) AS high, round(stddev_samp(value), 8) AS deviation, count(*) AS n"]
)


@query("oee_day_from_hours", f"SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type AS line_id, {DAY_SQL} FROM events GROUP BY 1, 2")
def day_from_hours(t: Tables) -> DataFrame:
    """Every measure of a line's day, stored days made of stored hours' states, the rest of live ones."""
    rows = t.events.selectExpr("ts AS time", "event_type AS line_id", "event_id", "value", *(f"{PLAYED[c]} AS {c}" for c in HOUR_SUMS + HOUR_MEANS))
    table = Hypertable(t.spark, new_path(t.spark, "lines"), HypertableSpec("lines", "time", WEEK, ["line_id"]), rows.schema)
    table.append(rows)
    hours = Rollup(t.spark, new_path(t.spark, "hours"), RollupSpec("hours", "bucket", HOUR, LINES.partial(HOUR, "time"), True, ["line_id"]), table)
    days = Rollup(t.spark, new_path(t.spark, "days"), RollupSpec("days", "bucket", DAY, LINES.merged(DAY), True, ["line_id"]), hours)
    hours.refresh(None, dt("2024-01-20T13:00:00"))
    days.refresh(None, dt("2024-02-01"))
    out = LINES.final(days.read())
    rounded = {c: F.round(c, 6) if c == "energy_kwh" else r8(F.col(c)) for c in ("energy_kwh", *HOUR_MEANS, "deviation")}
    return out.withColumns(rounded)


# streams ---------------------------------------------------------------------------------------------------


class Lost(RuntimeError):
    """Stands for a driver that goes away."""


@query("stream_ingest", DAYS.format(""))
def stream_ingest(t: Tables) -> DataFrame:
    """A stream of two batches whose driver is lost after the first one's rows are written; it starts again and the
    table has each row once. Days up to a day before the newest row are stored, the others live."""
    source, table = new_path(t.spark, "stream-in"), _empty(t, "streamed")
    t.events.where("event_type <> 'error'").coalesce(1).write.parquet(f"{source}/part=1")
    rows = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    rollup = Rollup(t.spark, new_path(t.spark, "days"), RollupSpec("days", "day", DAY, _days), table)
    ingest = Ingest(table, new_path(t.spark, "ingest"), [rollup], DAY)

    class Breaks(Ingest):
        def put(self, batch: DataFrame, number: int) -> None:
            self.rollups = []
            super().put(batch, number)
            raise Lost("after the rows were written, before the stream noted it")

    try:
        Breaks(table, ingest.checkpoint, [rollup], DAY).start(rows).awaitTermination()
    except Exception as e:
        if "Lost" not in str(e):
            raise
    t.events.where("event_type = 'error'").coalesce(1).write.parquet(f"{source}/part=2")
    ingest.start(rows).awaitTermination()
    return rollup.read()


@query("stream_live", "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type, round(avg(value), 8) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
def stream_live(t: Tables) -> DataFrame:
    """All days of a stream, the open one too; views of the whole month come late and correct their days."""
    source, out, state = (new_path(t.spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    late = F.coalesce((F.col("event_type") == "view") & (F.col("user_id") > 20), F.lit(False))
    for part, kept in enumerate((~late, late)):
        t.events.where(kept).write.parquet(f"{source}/part={part}")
        rows = t.spark.readStream.schema(t.events.schema).parquet(f"{source}/*")
        buckets = bucket_stream(rows, "ts", "1 day", ["event_type"], [F.avg("value").alias("mean"), F.count("*").alias("n")], "60 days")
        write_live(buckets, out, state).awaitTermination()
    return read_live(t.spark, out, buckets.schema, ["event_type"]).withColumn("mean", r8(F.col("mean")))
