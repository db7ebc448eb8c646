"""Plain tables made chunked ones, and updates of these."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeseries import micros
from tidemark.operators.ranges import merged
from tidemark.sources.hypertable import Hypertable, HypertableSpec


def convert(rows: DataFrame, path: str, spec: HypertableSpec) -> Hypertable:
    """A chunked table of all rows of a plain one."""
    table = Hypertable(rows.sparkSession, path, spec, rows.schema)
    table.append(rows)
    return table


def update_rows(table: Hypertable, where: Column, **values: Column) -> int:
    """Set columns of the rows that the condition holds for, and tell how many chunks were rewritten: only those with
    such a row. Their ranges count as changed, so rollups take them in. The time of a row can't be set."""
    if table.spec.time in values:
        raise ValueError("a row's time decides its chunk: delete the row and append another")
    size = table.spec.chunk // timedelta(microseconds=1)
    start = F.floor(micros(F.col(table.spec.time)) / size) * size
    hit = table.scan().where(where).select(start.cast("long").alias("start")).distinct().collect()  # a row a chunk
    ranges = merged([[r.start, r.start + size] for r in hit], len(hit) or 1)
    if ranges:
        types = {f.name: f.dataType for f in table.schema}
        new = {c: F.when(where, v.cast(types[c])).otherwise(F.col(c)) for c, v in values.items()}
        table.replace(ranges, table.scan_ranges(ranges).withColumns(new))
    return len(hit)
