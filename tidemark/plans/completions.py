"""Completion jobs, stages and telemetry. customer and orders play jobs and stages, lineitem and events telemetry."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeseries import time_bucket
from tidemark.operators.interval_join import interval_join
from tidemark.operators.joins import range_join
from tidemark.operators.rollup import Rollup, RollupSpec
from tidemark.plans.registry import Tables, dt, query, r8, since
from tidemark.plans.sensors import chunk_stats, stats, tier_lists
from tidemark.session import new_path

MINUTE, DAY = timedelta(minutes=1), timedelta(days=1)


def telemetry(t: Tables) -> DataFrame:
    """Readings with their stage and job."""
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))


TELEMETRY = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"

query("cmp_jobs", "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 100")(lambda t: t.customer.select("c_custkey", "c_name", "c_mktsegment").orderBy("c_custkey").limit(100))


@query("cmp_stage_check", "SELECT c_name, count(*) AS stages, min(o_totalprice) AS top_ft, max(o_totalprice) AS bottom_ft FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def stage_check(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_name")
    return rows.agg(F.count("*").alias("stages"), F.min("o_totalprice").alias("top_ft"), F.max("o_totalprice").alias("bottom_ft")).drop("c_custkey")


query("cmp_sched_check", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS stages FROM lineitem")(lambda t: t.lineitem.agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("stages")))
query("cmp_verify", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id LIMIT 20")(lambda t: t.events.select("event_id", "ts", "value").orderBy(F.col("ts").desc_nulls_first(), "event_id").limit(20))


@query("cmp_rows_by_job", f"SELECT c_mktsegment AS job, count(*) AS readings, count(DISTINCT o_orderkey) AS stages FROM {TELEMETRY} GROUP BY 1")
def rows_by_job(t: Tables) -> DataFrame:
    return telemetry(t).groupBy(F.col("c_mktsegment").alias("job")).agg(F.count("*").alias("readings"), F.countDistinct("o_orderkey").alias("stages"))


@query("cmp_q1", f"SELECT c_name AS job, o_orderkey AS stage, round(avg(l_extendedprice), 2) AS psi, CASE WHEN max(l_extendedprice) >= 90000 THEN 'OVER' WHEN max(l_extendedprice) >= 72000 THEN 'NEAR' ELSE 'OK' END AS alert FROM {TELEMETRY} WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 60 DAY GROUP BY c_custkey, c_name, o_orderkey")
def live_status(t: Tables) -> DataFrame:
    alert = F.when(F.max("l_extendedprice") >= 90000, "OVER").when(F.max("l_extendedprice") >= 72000, "NEAR").otherwise("OK")
    rows = telemetry(t).where(since(t.lineitem, "l_shipdate", days=60)).groupBy("c_custkey", F.col("c_name").alias("job"), F.col("o_orderkey").alias("stage"))
    return rows.agg(F.round(F.avg("l_extendedprice"), 2).alias("psi"), alert.alias("alert")).drop("c_custkey")


@query("cmp_q2", "SELECT time_bucket(INTERVAL '1 minute', ts) AS minute, round(avg(value), 8) AS psi, round(avg(value) - avg(event_id) / 1000.0, 8) AS net FROM events WHERE user_id = 1 GROUP BY 1")
def replay(t: Tables) -> DataFrame:
    return t.events.where("user_id = 1").groupBy(time_bucket(MINUTE, "ts").alias("minute")).agg(r8(F.avg("value")).alias("psi"), r8(F.avg("value") - F.avg("event_id") / 1000.0).alias("net"))


@query("cmp_q3", "SELECT o_orderkey, c_name, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Screenout' ELSE 'In Progress' END AS result, CASE WHEN o_totalprice < 50000 THEN 'UNDER' WHEN o_totalprice > 300000 THEN 'OVER' ELSE 'ON TARGET' END AS flag FROM orders JOIN customer ON o_custkey = c_custkey")
def design_flags(t: Tables) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    result = F.when(status == "F", "Completed").when(status == "O", "Screenout").otherwise("In Progress")
    flag = F.when(price < 50000, "UNDER").when(price > 300000, "OVER").otherwise("ON TARGET")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", result.alias("result"), flag.alias("flag"))


@query(
    "cmp_q4",
    """
WITH s AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY 1),
p AS (SELECT user_id, k, t0 + (k - 1) * INTERVAL 3 DAY AS low, t0 + k * INTERVAL 3 DAY AS high FROM s, (VALUES (1), (2), (3), (4), (5), (6), (7)) v(k))
SELECT e.user_id, k, count(*) AS readings, round(avg(value), 8) AS psi FROM events e JOIN p ON e.user_id = p.user_id AND e.ts BETWEEN low AND high GROUP BY 1, 2""",
)
def substages(t: Tables) -> DataFrame:
    """Seven equal windows for each user; a reading on a shared edge counts in both."""
    return range_join(t.events, windows(t), ["user_id"], "ts", "low", "high").groupBy("user_id", "k").agg(F.count("*").alias("readings"), r8(F.avg("value")).alias("psi"))


def windows(t: Tables) -> DataFrame:
    parts = t.spark.range(1, 8).select(F.col("id").cast("int").alias("k"))
    step = F.expr("INTERVAL '3' DAY")
    spans = t.events.groupBy("user_id").agg(F.min("ts").alias("t0")).crossJoin(F.broadcast(parts))
    return spans.select("user_id", "k", (F.col("t0") + (F.col("k") - 1) * step).alias("low"), (F.col("t0") + F.col("k") * step).alias("high"))


INCIDENTS = "(SELECT event_id AS incident, user_id AS who, ts - INTERVAL 5 MINUTE AS opened, ts + INTERVAL 10 MINUTE AS closed FROM events WHERE event_type = 'error')"


def incidents(t: Tables) -> DataFrame:
    opened, closed = F.col("ts") - F.expr("INTERVAL '5' MINUTE"), F.col("ts") + F.expr("INTERVAL '10' MINUTE")
    return t.events.where("event_type = 'error'").select(F.col("event_id").alias("incident"), F.col("user_id").alias("who"), opened.alias("opened"), closed.alias("closed"))


@query("cmp_incidents", f"SELECT incident, count(*) AS readings, round(avg(value), 8) AS psi FROM events JOIN {INCIDENTS} ON ts BETWEEN opened AND closed GROUP BY 1")
def readings_of_incidents(t: Tables) -> DataFrame:
    """All readings while an incident lasts, whoever made them: a join without a key."""
    found = interval_join(t.events.select("ts", "value"), incidents(t), ("ts", "ts"), ("opened", "closed"))
    return found.groupBy("incident").agg(F.count("*").alias("readings"), r8(F.avg("value")).alias("psi"))


@query(
    "cmp_shift_incidents",
    f"""
WITH s AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY 1),
p AS (SELECT user_id, k, t0 + (k - 1) * INTERVAL 3 DAY AS low, t0 + k * INTERVAL 3 DAY AS high FROM s, (VALUES (1), (2), (3), (4), (5), (6), (7)) v(k))
SELECT user_id, k, count(*) AS incidents FROM p JOIN {INCIDENTS} ON who = user_id AND opened <= high AND low <= closed GROUP BY 1, 2""",
)
def incidents_of_shifts(t: Tables) -> DataFrame:
    """Incidents of a user that touch each of their windows: intervals of both sides, with a key."""
    found = interval_join(windows(t), incidents(t).withColumnRenamed("who", "user_id"), ("low", "high"), ("opened", "closed"), ["user_id"])
    return found.groupBy("user_id", "k").agg(F.count("*").alias("incidents"))


def minutes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(time_bucket(MINUTE, "ts").alias("minute"), F.col("user_id").alias("stage_id")).agg(r8(F.avg("value")).alias("avg_psi"), F.max("value").alias("max_psi"), F.min("value").alias("min_psi"), F.count("*").alias("n"))


MINUTES = "SELECT time_bucket(INTERVAL '1 minute', ts) AS minute, user_id AS stage_id, round(avg(value), 8) AS avg_psi, max(value) AS max_psi, min(value) AS min_psi, count(*) AS n FROM events GROUP BY 1, 2"


def _minutes(t: Tables, real_time: bool) -> Rollup:
    rollup = Rollup(t.spark, new_path(t.spark, "minutes"), RollupSpec("stage_minute_summary", "minute", MINUTE, minutes, real_time, ["stage_id"]), t.hypertable())
    rollup.refresh(None, dt("2024-01-12T07:30:30"))
    return rollup


@query("cmp_cagg", f"SELECT m.*, c_name AS job FROM ({MINUTES}) m JOIN customer ON stage_id = c_custkey WHERE minute < TIMESTAMP '2024-01-12 07:30:00'")
def stored_minutes(t: Tables) -> DataFrame:
    rows = _minutes(t, False).read()
    return rows.join(t.customer, F.col("stage_id") == F.col("c_custkey")).select(*rows.columns, F.col("c_name").alias("job"))


query("cmp_cagg_rt", MINUTES)(lambda t: _minutes(t, True).read())
query("cmp_stats")(stats)
query("cmp_chunk_stats", "SELECT 'events_' || CAST(s AS VARCHAR) AS chunk_name, 'columnar' AS state, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(epoch(ts) AS BIGINT) // 604800 * 604800 AS s FROM events) GROUP BY s")(chunk_stats)
query("cmp_tier", "SELECT DISTINCT make_timestamp((CAST(epoch(ts) AS BIGINT) // 604800 * 604800) * 1000000) AS range_start, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'tiered' ELSE 'queued' END AS state FROM events WHERE ts < TIMESTAMP '2024-01-25'")(tier_lists)
