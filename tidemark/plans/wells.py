"""Wells: field summaries, rankings with alerts, distances, and the nine panels of a dashboard.

lineitem, supplier and nation play readings, wells and fields; customers get longitudes and latitudes from their
keys.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cells, geo
from tidemark.functions.numeric import round_num, safe_div
from tidemark.functions.timeseries import time_bucket, time_filter
from tidemark.operators.rollup import Rollup, RollupSpec
from tidemark.plans.registry import Tables, dt, query, r8, since
from tidemark.plans.sensors import chunk_stats, stats, tier_lists
from tidemark.session import new_path

DAY, FOUR_HOURS = timedelta(days=1), timedelta(hours=4)
WELLS = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"


def readings(t: Tables) -> DataFrame:
    """Readings with their well and field; the small sides are left to the planner."""
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))


query("wel_verify", "SELECT (SELECT count(*) FROM supplier) AS wells, (SELECT count(*) FROM lineitem) AS readings")(lambda t: t.spark.range(1).select(t.supplier.agg(F.count("*")).scalar().alias("wells"), t.lineitem.agg(F.count("*")).scalar().alias("readings")))
query("wel_list", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY n_name, s_suppkey LIMIT 50")(lambda t: t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name").orderBy("n_name", "s_suppkey").limit(50))


@query("wel_q1", f"SELECT n_name AS field_name, count(DISTINCT s_suppkey) AS active_wells, CAST(round(CAST(avg(l_quantity) AS DECIMAL(38,12)), 2) AS DOUBLE) AS avg_oil, round(avg(l_extendedprice), 2) AS avg_gas FROM {WELLS} WHERE s_acctbal > 0 AND l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 365 DAY GROUP BY 1")
def field_summary(t: Tables) -> DataFrame:
    rows = readings(t).where((F.col("s_acctbal") > 0) & since(t.lineitem, "l_shipdate", days=365))
    return rows.groupBy(F.col("n_name").alias("field_name")).agg(F.countDistinct("s_suppkey").alias("active_wells"), round_num(F.avg("l_quantity"), 2).cast("double").alias("avg_oil"), F.round(F.avg("l_extendedprice"), 2).alias("avg_gas"))


@query("wel_q2", "SELECT time_bucket(INTERVAL '1 day', l_shipdate) AS day, round(avg(l_quantity), 8) AS avg_oil, round(sum(l_quantity) / 96.0, 8) AS total_oil, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem WHERE l_suppkey = 7 AND l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 900 DAY GROUP BY 1")
def daily_trend(t: Tables) -> DataFrame:
    rows = t.lineitem.where((F.col("l_suppkey") == 7) & since(t.lineitem, "l_shipdate", days=900))
    return rows.groupBy(time_bucket(DAY, "l_shipdate").alias("day")).agg(r8(F.avg("l_quantity")).alias("avg_oil"), r8(F.sum("l_quantity") / 96.0).alias("total_oil"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("wel_q3", f"SELECT s_name AS well_name, round(avg(l_extendedprice) - avg(l_quantity) * 1000, 2) AS drawdown, CASE WHEN min(l_extendedprice) < 1000 THEN 'LOW PRESSURE' WHEN max(l_extendedprice) > 95000 THEN 'HIGH PRESSURE' ELSE 'NORMAL' END AS alert FROM {WELLS} WHERE s_acctbal > 0 GROUP BY s_suppkey, s_name")
def ranking(t: Tables) -> DataFrame:
    alert = F.when(F.min("l_extendedprice") < 1000, "LOW PRESSURE").when(F.max("l_extendedprice") > 95000, "HIGH PRESSURE").otherwise("NORMAL")
    rows = readings(t).where("s_acctbal > 0").groupBy("s_suppkey", F.col("s_name").alias("well_name"))
    return rows.agg(F.round(F.avg("l_extendedprice") - F.avg("l_quantity") * 1000, 2).alias("drawdown"), alert.alias("alert")).drop("s_suppkey").orderBy(F.col("drawdown").desc_nulls_first())


def daily_production(rows: DataFrame) -> DataFrame:
    return rows.groupBy(time_bucket(DAY, "ts").alias("day"), (F.col("user_id") % 20).alias("well_id")).agg(r8(F.avg("value")).alias("avg_oil"), r8(F.sum("value") / 96.0).alias("total_oil"), F.min("value").alias("low"), F.max("value").alias("high"))


PRODUCTION = "SELECT time_bucket(INTERVAL '1 day', ts) AS day, user_id % 20 AS well_id, round(avg(value), 8) AS avg_oil, round(sum(value) / 96.0, 8) AS total_oil, min(value) AS low, max(value) AS high FROM {} GROUP BY 1, 2"


def _production(t: Tables, real_time: bool) -> Rollup:
    rollup = Rollup(t.spark, new_path(t.spark, "production"), RollupSpec("daily_well_production", "day", DAY, daily_production, real_time, ["well_id"]), t.hypertable())
    rollup.refresh(None, dt("2024-01-25"))
    return rollup


@query("wel_cagg", f"SELECT d.*, s_name AS well_name FROM ({PRODUCTION.format('events')}) d JOIN supplier ON well_id + 1 = s_suppkey WHERE day >= TIMESTAMP '2024-01-10' AND day < TIMESTAMP '2024-01-25'")
def production_by_well(t: Tables) -> DataFrame:
    rows = _production(t, False).read(dt("2024-01-10"))
    return rows.join(t.supplier, F.col("well_id") + 1 == F.col("s_suppkey")).select(*rows.columns, F.col("s_name").alias("well_name"))


query("wel_cagg_rt", PRODUCTION.format("events"))(lambda t: _production(t, True).read())
query("wel_stats")(stats)
query("wel_chunk_stats", "SELECT 'events_' || CAST(s AS VARCHAR) AS chunk_name, 'columnar' AS state, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(epoch(ts) AS BIGINT) // 604800 * 604800 AS s FROM events) GROUP BY s")(chunk_stats)
query("wel_tier", "SELECT DISTINCT make_timestamp((CAST(epoch(ts) AS BIGINT) // 604800 * 604800) * 1000000) AS range_start, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'tiered' ELSE 'queued' END AS state FROM events WHERE ts < TIMESTAMP '2024-01-25'")(tier_lists)

# places ----------------------------------------------------------------------------------------------------

PLACES = "(SELECT c_custkey, -104 + (c_custkey * 37 % 1000) / 200.0 AS lon, 28 + (c_custkey * 91 % 1000) / 200.0 AS lat FROM customer)"
AWAY = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(31.9 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(31.9)) * pow(sin(radians(-102.15 - lon) / 2), 2))))"


def point() -> tuple[Column, Column]:
    return F.col("lon"), F.col("lat")


def places(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t.customer.select("c_custkey", (-104 + (key * 37 % 1000) / 200.0).alias("lon"), (28 + (key * 91 % 1000) / 200.0).alias("lat"))


def away() -> Column:
    return geo.haversine(*point(), F.lit(-102.15), F.lit(31.9))


@query("wel_geo_radius", f"SELECT c_custkey, round({AWAY}, 2) AS distance_m FROM {PLACES} WHERE {AWAY} <= 60000")
def radius(t: Tables) -> DataFrame:
    return places(t).where(geo.within(*point(), -102.15, 31.9, 60_000)).select("c_custkey", F.round(away(), 2).alias("distance_m"))


@query("wel_geo_knn", f"SELECT c_custkey, round({AWAY}, 2) AS distance_m FROM {PLACES} ORDER BY sqrt(pow(lon + 102.15, 2) + pow(lat - 31.9, 2)), c_custkey LIMIT 5")
def nearest(t: Tables) -> DataFrame:
    """Ordered in the plane, reported on the sphere."""
    return places(t).orderBy(geo.planar(*point(), F.lit(-102.15), F.lit(31.9)), "c_custkey").limit(5).select("c_custkey", F.round(away(), 2).alias("distance_m"))


@query("wel_geo_bbox", f"SELECT c_custkey, lon, lat FROM {PLACES} WHERE lon BETWEEN -103 AND -101 AND lat BETWEEN 28.5 AND 30")
def box(t: Tables) -> DataFrame:
    return places(t).where(geo.in_box(*point(), -103, 28.5, -101, 30))


@query("wel_geo_cells", f"SELECT c_custkey, round({AWAY}, 2) AS distance_m FROM {PLACES} WHERE {AWAY} <= 60000")
def radius_by_cells(t: Tables) -> DataFrame:
    """The same rows from a table in the order of its cells: ranges of them reach the scan."""
    path = new_path(t.spark, "places")
    cells.write_by_cells(places(t), path, *point())
    near = cells.within_by_cells(t.spark.read.parquet(path), "cell", *point(), -102.15, 31.9, 60_000)
    return near.select("c_custkey", F.round(away(), 2).alias("distance_m"))


RIGS = "(SELECT s_suppkey, -104 + (s_suppkey * 53 % 1000) / 200.0 AS x, 28 + (s_suppkey * 29 % 1000) / 200.0 AS y FROM supplier)"
APART = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(lat - y) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * pow(sin(radians(lon - x) / 2), 2))))"


def rigs(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", (-104 + (key * 53 % 1000) / 200.0).alias("x"), (28 + (key * 29 % 1000) / 200.0).alias("y"))


@query("wel_geo_pairs", f"SELECT s_suppkey, c_custkey, round({APART}, 2) AS distance_m FROM {RIGS}, {PLACES} WHERE {APART} <= 15000")
def pairs(t: Tables) -> DataFrame:
    """Each rig with the places near it."""
    near = cells.distance_join(rigs(t), places(t), ("x", "y"), ("lon", "lat"), 15_000)
    return near.select("s_suppkey", "c_custkey", F.round("metres", 2).alias("distance_m"))


@query("wel_geo_nearest", f"SELECT s_suppkey, c_custkey, CAST(row_number() OVER w AS INTEGER) AS rank, round(d, 2) AS distance_m FROM (SELECT *, {APART} AS d FROM {RIGS}, {PLACES}) WINDOW w AS (PARTITION BY s_suppkey ORDER BY d, c_custkey) QUALIFY row_number() OVER w <= 3")
def three_nearest(t: Tables) -> DataFrame:
    """The three places nearest to each rig, by circles that grow until they hold three."""
    found, _ = cells.nearest_join(rigs(t), places(t), "s_suppkey", "c_custkey", ("x", "y"), ("lon", "lat"), 3)
    return found.select("s_suppkey", "c_custkey", F.col("rank").cast("int").alias("rank"), F.round("metres", 2).alias("distance_m"))


# dashboard: the range picker is the last seven days --------------------------------------------------------

RANGE = "ts BETWEEN (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND (SELECT max(ts) FROM events)"


def picked(t: Tables) -> DataFrame:
    end = t.events.agg(F.max("ts")).scalar()
    return t.events.where(time_filter("ts", end - F.expr("INTERVAL '7' DAY"), end))


def _panel(name: str, agg: str, column) -> None:
    query(name, f"SELECT {agg} AS value FROM events WHERE {RANGE}")(lambda t: picked(t).agg(column().alias("value")))


query("wdb_p1", "SELECT count(*) AS value FROM supplier WHERE s_acctbal > 0")(lambda t: t.supplier.where("s_acctbal > 0").agg(F.count("*").alias("value")))
_panel("wdb_p2", "round(sum(value) / 96.0, 8)", lambda: r8(F.sum("value") / 96.0))
_panel("wdb_p3", "round(avg(value), 8)", lambda: r8(F.avg("value")))
_panel("wdb_p4", "max(value)", lambda: F.max("value"))
FOUR = "time_bucket(INTERVAL '4 hours', ts)"
query("wdb_p5", f"SELECT {FOUR} AS time, event_type AS metric, round(sum(value), 8) AS value FROM events WHERE {RANGE} GROUP BY 1, 2")(lambda t: picked(t).groupBy(time_bucket(FOUR_HOURS, "ts").alias("time"), F.col("event_type").alias("metric")).agg(r8(F.sum("value")).alias("value")))
query("wdb_p6", f"SELECT {FOUR} AS time, round(avg(value), 8) AS value, min(value) AS low FROM events WHERE {RANGE} GROUP BY 1")(lambda t: picked(t).groupBy(time_bucket(FOUR_HOURS, "ts").alias("time")).agg(r8(F.avg("value")).alias("value"), F.min("value").alias("low")))


@query("wdb_p7", f"SELECT {FOUR} AS time, round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) / nullif(sum(value), 0) * 100, 8) AS water_cut FROM events WHERE {RANGE} GROUP BY 1")
def water_cut(t: Tables) -> DataFrame:
    water = F.sum(F.when(F.col("event_type") == "view", F.col("value")).otherwise(0.0))
    return picked(t).groupBy(time_bucket(FOUR_HOURS, "ts").alias("time")).agg(r8(safe_div(water, F.sum("value")) * 100).alias("water_cut"))


@query("wdb_p8", f"SELECT s_name, round(sum(l_quantity), 2) AS oil FROM {WELLS} GROUP BY s_suppkey, s_name ORDER BY oil DESC, s_name LIMIT 10")
def top_wells(t: Tables) -> DataFrame:
    return readings(t).groupBy("s_suppkey", "s_name").agg(F.round(F.sum("l_quantity"), 2).alias("oil")).orderBy(F.col("oil").desc_nulls_first(), "s_name").limit(10).drop("s_suppkey")


@query("wdb_p9", f"SELECT n_name AS field, count(DISTINCT s_suppkey) AS wells, round(avg(nullif(l_discount, 0)), 8) AS rate FROM {WELLS} GROUP BY 1 ORDER BY rate DESC NULLS LAST, field LIMIT 10")
def fields(t: Tables) -> DataFrame:
    return readings(t).groupBy(F.col("n_name").alias("field")).agg(F.countDistinct("s_suppkey").alias("wells"), r8(F.avg(F.nullif("l_discount", F.lit(0.0)))).alias("rate")).orderBy(F.col("rate").desc_nulls_last(), "field").limit(10)
