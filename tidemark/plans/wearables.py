"""Wearables: vital signs by device and user. events plays the readings, customer and nation users and devices."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeseries import time_bucket
from tidemark.operators.rollup import Rollup, RollupSpec
from tidemark.plans.registry import Tables, dt, query, r8, since
from tidemark.plans.sensors import stats, tier_lists
from tidemark.session import new_path

HOUR, DAY = timedelta(hours=1), timedelta(days=1)
USERS = "events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def with_users(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    rows = t.events if rows is None else rows
    return rows.join(t.customer, F.col("user_id") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))


query("bio_head", "SELECT event_id, ts, user_id, value FROM events ORDER BY event_id LIMIT 10")(lambda t: t.events.select("event_id", "ts", "user_id", "value").orderBy("event_id").limit(10))
query("bio_devices", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")(lambda t: t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name"))


@query("bio_abnormal", "SELECT event_id, user_id, value, CASE WHEN value > 200 THEN 'tachycardia' WHEN value < 5 THEN 'bradycardia' END AS kind FROM events WHERE value > 200 OR value < 5 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def abnormal(t: Tables) -> DataFrame:
    """AND binds tighter than OR: the day limits the low readings only."""
    high, low = F.col("value") > 200, F.col("value") < 5
    kind = F.when(high, "tachycardia").when(low, "bradycardia")
    return t.events.where(high | (low & since(t.events, "ts", days=1))).select("event_id", "user_id", "value", kind.alias("kind"))


@query("bio_hourly", "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, round(avg(value), 2) AS avg_hr, round(avg(user_id), 2) AS avg_sys, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 24")
def hourly(t: Tables) -> DataFrame:
    rows = t.events.groupBy(time_bucket(HOUR, "ts").alias("hour")).agg(F.round(F.avg("value"), 2).alias("avg_hr"), F.round(F.avg("user_id"), 2).alias("avg_sys"), F.count("*").alias("n"))
    return rows.orderBy(F.col("hour").desc_nulls_first()).limit(24)


@query("bio_daily_user", f"SELECT time_bucket(INTERVAL '1 day', ts) AS day, c_name, n_name, round(avg(value), 8) AS avg_hr, count(*) AS n FROM {USERS} GROUP BY 1, 2, 3")
def daily_user(t: Tables) -> DataFrame:
    return with_users(t).groupBy(time_bucket(DAY, "ts").alias("day"), "c_name", "n_name").agg(r8(F.avg("value")).alias("avg_hr"), F.count("*").alias("n"))


@query("bio_hypertension", f"SELECT time_bucket(INTERVAL '1 day', ts) AS day, round(avg(value), 8) AS sys, max(value) AS top FROM {USERS} WHERE c_mktsegment LIKE '%BUIL%' GROUP BY 1")
def hypertension(t: Tables) -> DataFrame:
    return with_users(t).where(F.col("c_mktsegment").like("%BUIL%")).groupBy(time_bucket(DAY, "ts").alias("day")).agg(r8(F.avg("value")).alias("sys"), F.max("value").alias("top"))


@query("bio_alerts", f"SELECT event_id, c_name, n_name, value, CASE WHEN value > 150 THEN 'CRITICAL' WHEN value > 100 THEN 'HIGH' ELSE 'LOW' END AS alert FROM {USERS} WHERE (value > 100 OR value < 3) AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def alerts(t: Tables) -> DataFrame:
    value = F.col("value")
    alert = F.when(value > 150, "CRITICAL").when(value > 100, "HIGH").otherwise("LOW")
    rows = t.events.where(((value > 100) | (value < 3)) & since(t.events, "ts", hours=24))
    return with_users(t, rows).select("event_id", "c_name", "n_name", "value", alert.alias("alert"))


def daily_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy(time_bucket(DAY, "ts").alias("day"), F.col("user_id").alias("device_id")).agg(r8(F.avg("value")).alias("avg_hr"), F.min("value").alias("min_hr"), F.max("value").alias("max_hr"), F.count("*").alias("n"))


DAILY = "SELECT time_bucket(INTERVAL '1 day', ts) AS day, user_id AS device_id, round(avg(value), 8) AS avg_hr, min(value) AS min_hr, max(value) AS max_hr, count(*) AS n FROM {} GROUP BY 1, 2"
query("bio_daily_device", DAILY.format("events"))(lambda t: daily_summary(t.events))
query("bio_daily_device_compressed", DAILY.format("events"))(lambda t: daily_summary(t.hypertable(compress=True).scan()))


def _summary(t: Tables) -> Rollup:
    rollup = Rollup(t.spark, new_path(t.spark, "health"), RollupSpec("daily_health_summary", "day", DAY, daily_summary, True, ["device_id"]), t.hypertable())
    rollup.refresh(dt("2024-01-02T12:00:00"), dt("2024-01-20"))
    return rollup


@query("bio_cagg", DAILY.format("(SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-03')"))
def stored(t: Tables) -> DataFrame:
    """The first whole day after the start of the refresh on: a bucket is refreshed whole or not at all."""
    return _summary(t).read()


@query("bio_cagg_unknown_device", DAILY.format("(SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-03' UNION ALL SELECT -1, TIMESTAMP '2024-02-10 08:00:00', 1000099, 'view', 150.0, '')"))
def unknown_device(t: Tables) -> DataFrame:
    """A device that no table knows is in the rollup; joins with users leave it out."""
    rollup = _summary(t)
    rollup.source.append(t.spark.createDataFrame([(-1, dt("2024-02-10T08:00:00"), 1000099, "view", 150.0, "")], t.events.schema))
    return rollup.read()


@query("bio_cagg_after_retention", DAILY.format("events"))
def survives_retention(t: Tables) -> DataFrame:
    """Raw chunks go, the rollup's buckets stay, and a later refresh doesn't empty them."""
    rollup = Rollup(t.spark, new_path(t.spark, "health"), RollupSpec("daily_health_summary", "day", DAY, daily_summary), t.hypertable())
    rollup.refresh(None, dt("2024-01-25"))
    rollup.source.drop_chunks(dt("2024-01-11"))
    rollup.refresh(dt("2024-01-01"), dt("2024-01-28"))
    return rollup.read()


query("bio_rt_check", "SELECT event_id, user_id, value FROM events WHERE user_id = 9 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY")(lambda t: t.events.where((F.col("user_id") == 9) & since(t.events, "ts", days=5)).select("event_id", "user_id", "value"))
query("bio_activity", "SELECT event_type AS activity, round(avg(value), 8) AS avg_hr, round(avg(user_id), 8) AS avg_sys, count(*) AS n FROM events GROUP BY 1")(lambda t: t.events.groupBy(F.col("event_type").alias("activity")).agg(r8(F.avg("value")).alias("avg_hr"), r8(F.avg("user_id")).alias("avg_sys"), F.count("*").alias("n")))


@query("bio_hrv", "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, user_id, round(stddev_samp(value), 8) AS sd, round(max(value) - min(value), 8) AS hr_range FROM events GROUP BY 1, 2")
def variability(t: Tables) -> DataFrame:
    return t.events.groupBy(time_bucket(HOUR, "ts").alias("hour"), "user_id").agg(r8(F.stddev_samp("value")).alias("sd"), r8(F.max("value") - F.min("value")).alias("hr_range"))


@query(
    "bio_sleep_next",
    """
WITH d AS (SELECT time_bucket(INTERVAL '1 day', ts) AS day, user_id, avg(value) AS hr, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT s.day, s.user_id, round(s.hr, 8) AS sleep_hr, round(x.hr, 8) AS next_hr FROM d s JOIN d x ON s.user_id = x.user_id AND x.day = s.day + INTERVAL 1 DAY""",
)
def sleep_next(t: Tables) -> DataFrame:
    """A day's mean with the next day's: a self-join with a shifted key."""
    days = t.events.where("value is not null").groupBy(time_bucket(DAY, "ts").alias("day"), "user_id").agg(F.avg("value").alias("hr"))
    after = days.select((F.col("day") - F.expr("INTERVAL '1' DAY")).alias("day"), "user_id", F.col("hr").alias("next"))
    return days.join(after, ["day", "user_id"]).select("day", "user_id", r8(F.col("hr")).alias("sleep_hr"), r8(F.col("next")).alias("next_hr"))


query("bio_stats")(stats)
query("bio_tier", "SELECT DISTINCT make_timestamp((CAST(epoch(ts) AS BIGINT) // 604800 * 604800) * 1000000) AS range_start, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'tiered' ELSE 'queued' END AS state FROM events WHERE ts < TIMESTAMP '2024-01-25'")(tier_lists)
