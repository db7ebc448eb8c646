"""Ticks: candles, joins with assets, stored candles. events plays the ticks, orders and customer the assets."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeseries import last_by, ohlc, time_bucket
from tidemark.operators.rollup import Rollup, RollupSpec
from tidemark.plans.registry import Tables, dt, query, since
from tidemark.session import new_path

DAY = timedelta(days=1)


def candles(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy(time_bucket(DAY, "ts").alias("bucket"), F.col("event_type").alias("symbol")).agg(*ohlc("value", "ts", "event_id", whole=True), last_by("event_id", "ts", "event_id", whole=True).alias("last_volume"))


CANDLES = """
SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type AS symbol,
  arg_min_null(value, (ts, event_id)) AS "open", max(value) AS high, min(value) AS low, arg_max_null(value, (ts, event_id)) AS "close",
  arg_max_null(event_id, (ts, event_id)) AS last_volume
FROM {} GROUP BY ALL"""


@query("fin_preview", "SELECT event_id, ts, event_type, value FROM events ORDER BY event_id LIMIT 10")
def preview(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", "event_type", "value").orderBy("event_id").limit(10)


@query("fin_join", "SELECT o_orderkey, o_orderdate, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def join(t: Tables) -> DataFrame:
    top = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return top.orderBy(F.col("o_orderdate").desc_nulls_first(), "o_orderkey").limit(10).select("o_orderkey", "o_orderdate", "o_totalprice", "c_name")


@query("fin_ohlc", CANDLES.format("events"))
def candle(t: Tables) -> DataFrame:
    return candles(t.events)


@query("fin_ohlc_14d", CANDLES.format("(SELECT * FROM events WHERE event_type = 'view' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY)"))
def candle_14d(t: Tables) -> DataFrame:
    return candles(t.events.where((F.col("event_type") == "view") & since(t.events, "ts", days=14)))


@query("fin_ohlc_compressed", CANDLES.format("events"))
def candle_compressed(t: Tables) -> DataFrame:
    return candles(t.hypertable(compress=True).scan())


@query("fin_stats")
def stats(t: Tables) -> DataFrame:
    return t.hypertable(compress=True).compression_stats()


CHUNKS = """
SELECT DISTINCT 'events' AS hypertable_name, 'events_' || CAST(s AS VARCHAR) AS chunk_name, make_timestamp(s * 1000000) AS range_start,
  make_timestamp((s + 604800) * 1000000) AS range_end, {} AS is_compressed
FROM (SELECT CAST(epoch(ts) AS BIGINT) // 604800 * 604800 AS s FROM events WHERE ts IS NOT NULL)"""


def chunk_list(t: Tables, compress: bool = False) -> DataFrame:
    return t.hypertable(compress).chunks().select("hypertable_name", "chunk_name", "range_start", "range_end", "is_compressed")


for _name in ("fin_chunks", "iot_chunks", "oee_chunks", "wel_chunks", "cmp_chunks", "bio_chunks"):
    query(_name, CHUNKS.format("false"))(chunk_list)


def stored(t: Tables, until: str, real_time: bool, rows: DataFrame | None = None) -> DataFrame:
    table = t.hypertable()
    rollup = Rollup(t.spark, new_path(t.spark, "candles"), RollupSpec("one_day_candle", "bucket", DAY, candles, real_time, ["symbol"]), table)
    rollup.refresh(None, dt(until))
    if rows is not None:
        table.append(rows)
    return rollup.read()


@query("fin_cagg", CANDLES.format("(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-20')"))
def stored_candles(t: Tables) -> DataFrame:
    return stored(t, "2024-01-20T13:00:00", False)


@query("fin_cagg_rt", CANDLES.format("(SELECT * FROM events UNION ALL SELECT -1, TIMESTAMP '2024-02-09 12:00:00', 0, 'view', 120000.0, '')"))
def live_candles(t: Tables) -> DataFrame:
    late = t.spark.createDataFrame([(-1, dt("2024-02-09T12:00:00"), 0, "view", 120000.0, "")], t.events.schema)
    return stored(t, "2024-01-20T13:00:00", True, late)


@query("fin_describe", "SELECT * FROM (VALUES ('event_id', 'bigint', NULL), ('ts', 'timestamp_ntz', 'time'), ('user_id', 'bigint', 'segment'), ('event_type', 'string', NULL), ('value', 'double', NULL), ('props', 'string', NULL)) v(column_name, data_type, role)")
def columns(t: Tables) -> DataFrame:
    return t.hypertable().describe()
