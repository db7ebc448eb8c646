"""Registered queries: a function of the tables, and SQL with the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_path, prepare
from tidemark.sources.hypertable import Hypertable, HypertableSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The Parquet tables of a folder, as attributes; and events as a chunked table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def hypertable(self, compress: bool = False) -> Hypertable:
        """events in chunks of seven days, grouped by user and newest first; each query writes its own."""
        events = self.events
        spec = HypertableSpec("events", "ts", timedelta(days=7), ["user_id"], [F.col("ts").desc()], ["event_type"])
        table = Hypertable(self.spark, new_path(self.spark, "events"), spec, events.schema)
        table.append(events)
        if compress:
            table.compress_chunks(table.chunk_starts())
        return table


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return f(Tables(spark, folder))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def latest(df: DataFrame, ts: str) -> Column:
    """The newest time of a table, as a scalar subquery: queries count back from it, not from the clock."""
    return df.agg(F.max(ts)).scalar()


def since(df: DataFrame, ts: str, days: float = 0, hours: float = 0, minutes: float = 0) -> Column:
    seconds = int(days * 86400 + hours * 3600 + minutes * 60)
    return F.col(ts) >= latest(df, ts) - F.expr(f"INTERVAL '{seconds}' SECOND")


def dt(text: str) -> datetime:
    return datetime.fromisoformat(text)


def r4(x: Column) -> Column:
    return F.round(x, 4)


def r8(x: Column) -> Column:
    """Means of prices often end in a 5 at four digits, where the order of a sum decides; not so at eight."""
    return F.round(x, 8)
