"""Time buckets and values ordered by time."""

from __future__ import annotations

from datetime import timedelta
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: buckets count from this Monday, 2000-01-03, in microseconds since 1970.
ORIGIN = 946_857_600_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_bucket(width: timedelta, ts: Column | str, origin: int = ORIGIN) -> Column:
    """Start of the bucket that holds ts, as a timestamp without zone (ts is taken as UTC)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    size = width // timedelta(microseconds=1)
    at = micros(ts)
    return F.timestamp_micros(at - F.pmod(at - F.lit(origin % size), F.lit(size))).cast("timestamp_ntz")


def order_key(ts: Column, tie: Column, whole: bool = False) -> Column:
    """What orders rows by time and then by a tie, null without a time. whole: the tie is an integer, and time and tie
    fit in one number, which Spark keeps in a hash aggregation; a struct makes it sort all rows first."""
    if not whole:
        return F.when(ts.isNotNull(), F.struct(ts.alias("t"), tie.alias("k")))
    lowest = F.lit(Decimal(-(1 << 63) - 1))  # a null tie comes first
    return micros(ts).cast("decimal(18,0)") * F.lit(Decimal(1 << 64)) + F.coalesce(tie.cast("decimal(20,0)"), lowest)


def first_by(value: Column | str, ts: Column | str, tie: Column | str, whole: bool = False) -> Column:
    """Value at the earliest ts, by the smaller tie; rows without ts don't count, a null value does."""
    return _edge(F.min_by, value, ts, tie, whole)


def last_by(value: Column | str, ts: Column | str, tie: Column | str, whole: bool = False) -> Column:
    """Value at the latest ts, by the larger tie; rows without ts don't count, a null value does."""
    return _edge(F.max_by, value, ts, tie, whole)


def _edge(f, value, ts, tie, whole) -> Column:
    value, ts, tie = (F.col(x) if isinstance(x, str) else x for x in (value, ts, tie))
    return f(value, order_key(ts, tie, whole))


def ohlc(value: str, ts: str, tie: str, whole: bool = False) -> list[Column]:
    return [first_by(value, ts, tie, whole).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), last_by(value, ts, tie, whole).alias("close")]


def time_filter(ts: str, start: Column, end: Column) -> Column:
    """A dashboard's time range, both ends included."""
    return F.col(ts).between(start, end)
