"""Joins of intervals that overlap, with or without a key.

Each interval has a level: the smallest k with 4**k above its length in microseconds (or units). Time is cut, for each
level, into bins of 4**k, so an interval touches two bins of its own level at most, and two of any higher one. A pair
meets in the bins of the higher of its two levels and counts only in the bin that holds its later start, so it comes out
once. Both sides send a row to their own level and to those higher levels that the other side has, which a small
aggregation tells; there are 32 levels at most, and mostly a few.

So the join is an equi join of (key, level, bin): without a key it still shuffles, a key that holds much of the table is
spread over its bins, and what is crowded in one bin can be dealt over `salts` (or by adaptive execution).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeseries import micros


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return micros(F.col(name))
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("long")
    raise TypeError(f"{name}: intervals are of times or integers")


def _placed(df: DataFrame, span: tuple[str, str]) -> DataFrame:
    """Rows as a struct with their numbers and level; those without an interval are left out."""
    low, high = (_number(df, c) for c in span)
    rows = df.select(F.struct("*").alias("row"), low.alias("low"), high.alias("high")).where("low <= high")
    bits = F.length(F.bin(F.col("high") - F.col("low")))
    return rows.withColumn("level", F.call_function("div", bits + 1, F.lit(2)).cast("int"))


def _binned(rows: DataFrame, others: list[int]) -> DataFrame:
    """A row for each bin of the row's own level and of the higher levels that the other side has."""
    levels = F.array_union(F.array("level"), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda m: m > F.col("level")))

    def bins(m: Column) -> Column:
        at = lambda x: F.call_function("shiftright", F.col(x), m * 2)
        return F.transform(F.sequence(at("low"), at("high")), lambda b: F.struct(m.alias("m"), b.alias("bin")))

    return rows.withColumn("at", F.explode(F.flatten(F.transform(levels, bins)))).select("row", "low", "high", "level", "at.m", "at.bin")


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: list[str] = (), salts: int = 1) -> DataFrame:
    """Pairs of rows whose closed intervals share a moment and whose `on` columns are equal; a moment is an interval
    with equal ends. The columns of left, then those of right without `on`."""
    twice = (set(left.columns) & set(right.columns)) - set(on)
    if twice:
        raise ValueError(f"both sides have {', '.join(sorted(twice))}")
    a, b = _placed(left, left_span), _placed(right, right_span)
    levels = [sorted(r.level for r in x.select("level").distinct().collect()) for x in (a, b)]  # 32 at most
    a, b = _binned(a, levels[1]), _binned(b, levels[0])
    a = a.withColumn("salt", F.pmod(F.xxhash64("row", "low"), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)).alias("a")
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("b")
    same = F.lit(True)
    for c in ("m", "bin", "salt", *(f"row.{k}" for k in on)):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    meet = (F.col("a.low") <= F.col("b.high")) & (F.col("b.low") <= F.col("a.high"))
    higher = F.col("a.m") == F.greatest("a.level", "b.level")
    later = F.call_function("shiftright", F.greatest("a.low", "b.low"), F.col("a.m") * 2) == F.col("a.bin")
    return a.join(b, same & meet & higher & later).select("a.row.*", *(F.col(f"b.row.{c}") for c in right.columns if c not in on))
