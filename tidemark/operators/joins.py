"""Joins by key and range, and checks of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(facts: DataFrame, spans: DataFrame, on: list[str], at: str, low: str, high: str) -> DataFrame:
    """Rows of facts with each span of the same key that holds `at`, both ends included: a row on a shared edge comes
    with both spans. The key makes it an equi join; the range is part of its condition."""
    keys = [F.col(f"f.{k}") == F.col(f"s.{k}") for k in on]
    condition: Column = F.col(f"f.{at}").between(F.col(f"s.{low}"), F.col(f"s.{high}"))
    for k in keys:
        condition = condition & k
    return facts.alias("f").join(spans.alias("s"), condition).select("f.*", *[f"s.{c}" for c in spans.columns if c not in on])


def validate(df: DataFrame, not_null: list[str] = (), unique: list[str] = (), allowed: dict[str, list] | None = None, refers: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(rule, violations) for declared constraints; storage formats don't check them."""
    counts = [F.sum(F.col(c).isNull().cast("long")).alias(f"{c} is not null") for c in not_null]
    counts += [F.sum((~F.col(c).isin(v)).cast("long")).alias(f"{c} is one of {len(v)} values") for c, v in (allowed or {}).items()]
    out = None
    if counts:
        one = df.agg(*counts)
        out = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.coalesce(one[f"`{c}`"], F.lit(0)).alias("violations")) for c in one.columns])).alias("x")).select("x.*")
    if unique:
        again = df.groupBy(*unique).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
        again = again.select(F.lit(f"{', '.join(unique)} is unique").alias("rule"), "violations")
        out = again if out is None else out.unionByName(again)
    for c, (other, key) in (refers or {}).items():
        lost = df.where(F.col(c).isNotNull()).join(other.select(F.col(key).alias(c)), c, "left_anti").agg(F.count("*").alias("violations"))
        lost = lost.select(F.lit(f"{c} refers to {key}").alias("rule"), "violations")
        out = lost if out is None else out.unionByName(lost)
    return out
