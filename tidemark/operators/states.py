"""Measures as partial states that merge: a day's figures from its hours', without the raw rows.

A measure is kept as columns whose names start with its own: sums and counts add up, extremes compare, first and last
values carry their time, deviations carry count, mean and sum of squared distances. `partial` makes states of rows,
`merged` makes coarser states of finer ones, `final` makes figures of states, so rows -> hours -> days -> figures
equals rows -> figures, up to the rounding of sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeseries import order_key, time_bucket

KINDS = ("sum", "count", "avg", "min", "max", "first", "last", "stddev")


@dataclass(frozen=True)
class Measure:
    """A figure of a column (or SQL expression); first and last need a time and a tie that order rows (whole: the tie is
    an integer)."""

    name: str
    kind: str
    column: str
    order: tuple[str, ...] = ()
    whole: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no measure of kind {self.kind}")
        if (self.kind in ("first", "last")) != bool(self.order):
            raise ValueError(f"{self.name}: {self.kind} {'takes no' if self.order else 'needs an'} order")


class States:
    def __init__(self, keys: list[str], measures: list[Measure]):
        self.keys, self.measures = keys, measures

    def partial(self, width: timedelta, ts: str) -> Callable[[DataFrame], DataFrame]:
        """Rows to states by bucket and keys."""
        cols = [c for m in self.measures for c in _of_rows(m)]
        return lambda rows: rows.groupBy(time_bucket(width, ts).alias("bucket"), *self.keys).agg(*cols)

    def merged(self, width: timedelta) -> Callable[[DataFrame], DataFrame]:
        """States to states of coarser buckets."""

        def merge(states: DataFrame) -> DataFrame:
            coarse = states.withColumn("bucket", time_bucket(width, "bucket")).groupBy("bucket", *self.keys)
            return coarse.agg(*(c for m in self.measures for c in _of_states(m)))

        return merge

    def final(self, states: DataFrame) -> DataFrame:
        return states.select("bucket", *self.keys, *(_figure(m).alias(m.name) for m in self.measures))


def _named(m: Measure, **parts: Column) -> list[Column]:
    return [c.alias(f"{m.name}_{p}") for p, c in parts.items()]


def _of_rows(m: Measure) -> list[Column]:
    x = F.expr(m.column)
    if m.kind in ("first", "last"):
        key = order_key(F.col(m.order[0]), F.col(m.order[1]), m.whole)
        edge, at = (F.min_by, F.min) if m.kind == "first" else (F.max_by, F.max)
        return _named(m, value=edge(x, key), at=at(key))
    if m.kind == "stddev":
        return _named(m, n=F.count(x), mean=F.avg(x), square=F.var_pop(x) * F.count(x))
    return _named(m, **{"sum": {"sum": F.sum(x)}, "count": {"n": F.count(x)}, "avg": {"sum": F.sum(x), "n": F.count(x)}, "min": {"least": F.min(x)}, "max": {"most": F.max(x)}}[m.kind])


def _of_states(m: Measure) -> list[Column]:
    part = lambda p: F.col(f"{m.name}_{p}")
    if m.kind in ("first", "last"):
        edge, at = (F.min_by, F.min) if m.kind == "first" else (F.max_by, F.max)
        return _named(m, value=edge(part("value"), part("at")), at=at(part("at")))
    if m.kind == "stddev":
        both = _spread(m)
        return _named(m, n=both["n"], mean=both["mean"], square=both["square"])
    add = {"sum": F.sum, "n": F.sum, "least": F.min, "most": F.max}
    parts = {"sum": ["sum"], "count": ["n"], "avg": ["sum", "n"], "min": ["least"], "max": ["most"]}[m.kind]
    return _named(m, **{p: add[p](part(p)) for p in parts})


def _spread(m: Measure) -> Column:
    """Counts, means and squared distances, joined two at a time; the states of a bucket are few and sorted."""
    states = F.array_sort(F.collect_list(F.struct("bucket", *(F.col(f"{m.name}_{p}").alias(p) for p in ("n", "mean", "square")))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"))

    def join(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        apart = b["mean"] - a["mean"]
        both = F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["square"] + b["square"] + apart * apart * a["n"] * b["n"] / n).alias("square"))
        return F.when(b["n"] > 0, both).otherwise(a)

    return F.aggregate(states, zero, join)


def _figure(m: Measure) -> Column:
    part = lambda p: F.col(f"{m.name}_{p}")
    if m.kind == "avg":
        return part("sum") / F.nullif(part("n"), F.lit(0))
    if m.kind == "stddev":
        return F.when(part("n") > 1, F.sqrt(part("square") / F.nullif(part("n") - 1, F.lit(0))))
    return part({"sum": "sum", "count": "n", "min": "least", "max": "most", "first": "value", "last": "value"}[m.kind])
