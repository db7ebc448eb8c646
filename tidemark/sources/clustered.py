"""Tables clustered by several columns at once: rows in the order of interleaved bits, so that row groups are narrow in
each column and Parquet skips most of them for a filter on any one.

Spark hands Parquet no filter on times without a zone, so a time column comes with its microseconds in a column of its
own, `<name>_micros`; `time_range` filters on that.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeseries import micros


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return micros(F.col(name)).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    raise TypeError(f"{name}: only numbers and times are clustered")


def interleaved(ranks: list[Column], bits: int) -> Column:
    """Bits of whole numbers below 2**bits, from each in turn; the first has the upper ones."""
    n = len(ranks)
    if n * bits > 62:
        raise ValueError("too many bits")
    at = F.sequence(F.lit(0), F.lit(bits - 1))

    def spread(x: Column, place: int) -> Column:
        one = lambda a, k: a.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", x, k).bitwiseAND(F.lit(1).cast("long")), k * n + place))
        return F.aggregate(at, F.lit(0).cast("long"), one)

    out = spread(ranks[0], n - 1)
    for k, x in enumerate(ranks[1:], 2):
        out = out.bitwiseOR(spread(x, n - k))
    return out


def _part(x: Column, edges: list[float], bits: int) -> Column:
    """The part between edges that holds x, spread over all bits where there are fewer parts; edges are a constant array
    of the plan."""
    if not edges:
        return F.lit(0).cast("long")
    below = F.when(x.isNotNull(), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x))).otherwise(0)
    return F.floor(below * ((1 << bits) / (len(edges) + 1))).cast("long")


def write_clustered(df: DataFrame, path: str, by: list[str], bits: int = 7, files: int | None = None, group_bytes: int | None = None, bloom: list[str] = ()) -> None:
    """Write rows clustered by these columns: each is cut into 2**bits parts of about equal numbers of rows, by
    approximate quantiles, and rows are sorted by the interleaved bits of their parts. Nulls come first. `bloom` columns
    get a Parquet bloom filter, for values that ranges can't tell."""
    edges = df.select(*(_number(df, c).alias(c) for c in by)).agg(*(F.percentile_approx(c, [k / (1 << bits) for k in range(1, 1 << bits)], 100_000).alias(c) for c in by)).first()
    ranks = [_part(_number(df, c), sorted(set(edges[c] or [])), bits) for c in by]
    times: dict[str, Column] = {f"{c}_micros": micros(F.col(c)) for c in by if not isinstance(df.schema[c].dataType, T.NumericType)}
    taken = {*times, "z"} & set(df.columns)
    if taken:
        raise ValueError(f"the table has {', '.join(sorted(taken))} already")
    placed = df.withColumns(times | {"z": interleaved(ranks, bits)})
    dealt = placed.repartitionByRange(files, "z") if files else placed.repartitionByRange("z")
    writer = dealt.sortWithinPartitions("z").drop("z").write
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def time_range(name: str, low: datetime, high: datetime) -> Column:
    """low <= time < high of a clustered table, as a filter that Parquet skips by."""
    at = [(t - datetime(1970, 1, 1)) // timedelta(microseconds=1) for t in (low, high)]
    return (F.col(f"{name}_micros") >= at[0]) & (F.col(f"{name}_micros") < at[1])


def rows_scanned(df: DataFrame) -> int:
    """How many rows the file scans of a query give on, after row groups are skipped; runs the query."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))
