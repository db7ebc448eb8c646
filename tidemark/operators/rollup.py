"""Continuous aggregates: a GROUP BY over time buckets that is stored, refreshed where rows changed, and read with live
rows. The rows come from a chunked table or from another rollup.

Beside its buckets a rollup keeps a watermark (what lies below is stored), the version of its source that it has seen,
and the ranges of time that changed but are not refreshed yet. A refresh aggregates the changed ranges inside its
window, in whole buckets, and nothing else; with nothing new it reads no row. A late row costs its buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranges import Ranges, inside, merged, outside, widened
from tidemark.sources.hypertable import Hypertable, HypertableSpec, _seconds, _time

_SECOND = 1_000_000
ORIGIN = _seconds(datetime(2000, 1, 3))


@dataclass
class RollupSpec:
    """name, bucket column and width, and the aggregation of the source's rows; real_time: reads add live buckets."""

    name: str
    bucket: str
    width: timedelta
    aggregate: Callable[[DataFrame], DataFrame]
    real_time: bool = True
    segment_by: list[str] = field(default_factory=list)


class Rollup:
    def __init__(self, spark: SparkSession, path: str, spec: RollupSpec, source: Hypertable | Rollup):
        self.spec, self.source = spec, source
        self.base = source.table if isinstance(source, Rollup) else source
        if isinstance(source, Rollup) and (spec.width < source.spec.width or spec.width % source.spec.width):
            raise ValueError(f"buckets of {spec.name} are not made of whole buckets of {source.spec.name}")
        store = HypertableSpec(spec.name, spec.bucket, max(self.base.spec.chunk, spec.width), spec.segment_by, [spec.bucket])
        self.table = Hypertable(spark, path, store, spec.aggregate(self.base.scan()).schema)

    def _floor(self, t: datetime) -> datetime:
        """Start of the bucket that holds t; buckets count from Monday 2000-01-03."""
        size = self.spec.width // timedelta(seconds=1)
        return _time(_seconds(t) - (_seconds(t) - ORIGIN) % size)

    def watermark(self) -> datetime | None:
        w = self.table.facts().get("watermark")
        return None if w is None else _time(w)

    def pending(self) -> tuple[Ranges, int]:
        """Ranges of time, in whole buckets, whose rows changed since they were stored; and the source's version."""
        facts = self.table.facts()
        new, version = self.base.changes(facts.get("seen", 0))
        size = self.spec.width // timedelta(microseconds=1)
        return widened(merged([*facts.get("pending", []), *new]), size, ORIGIN * _SECOND), version

    def refresh(self, start: datetime | None, end: datetime) -> Ranges:
        """Store the whole buckets inside [start, end) whose rows changed, and tell their ranges. Buckets older than the
        oldest chunk of the source stay, so dropping raw chunks doesn't empty the rollup; of a rollup of a rollup, only
        buckets below the source's watermark are stored."""
        starts = self.base.chunk_starts()
        if isinstance(self.source, Rollup):
            mark = self.source.watermark()
            end = end if mark is None else min(end, mark)
        if not starts:
            return []
        oldest = _time(starts[0])
        low = oldest if start is None else max(start, oldest)
        first = self._floor(low)
        first = first if first >= low else first + self.spec.width
        last = self._floor(end)
        if first >= last:
            return []
        window = (_seconds(first) * _SECOND, _seconds(last) * _SECOND)
        pending, version = self.pending()
        todo = merged(inside(pending, *window), 64)
        mark = self.watermark()
        left = inside(outside(pending, *window), _seconds(self._floor(oldest)) * _SECOND, 1 << 62)  # what is gone can't be refreshed
        facts = {"watermark": _seconds(last if mark is None else max(mark, last)), "seen": version, "pending": left}
        if todo or facts != {k: self.table.facts().get(k) for k in facts}:
            self.table.replace(todo, self.spec.aggregate(self.base.scan_ranges(todo)) if todo else None, **facts)
        return todo

    def _rows(self, start: datetime | None, end: datetime | None) -> DataFrame:
        return self.source.read(start, end) if isinstance(self.source, Rollup) else self.source.scan(start, end)

    def read(self, start: datetime | None = None, end: datetime | None = None, real_time: bool | None = None) -> DataFrame:
        """Buckets in [start, end): the stored ones below the watermark and, in real time, those above from the source's
        rows. The range reaches the raw scan as a range of time."""
        mark = self.watermark()
        live = self.spec.real_time if real_time is None else real_time
        t = F.col(self.spec.bucket)

        def cut(df: DataFrame) -> DataFrame:
            if start is not None:
                df = df.where(t >= F.lit(start).cast("timestamp_ntz"))
            return df if end is None else df.where(t < F.lit(end).cast("timestamp_ntz"))

        above = start if mark is None else mark if start is None else max(mark, self._floor(start))
        fresh = cut(self.spec.aggregate(self._rows(above, None if end is None else self._floor(end) + self.spec.width)))
        if mark is None:
            return fresh if live else fresh.limit(0)
        stored = cut(self.table.scan(start, mark if end is None else min(mark, end))).select(*fresh.columns)
        return stored.unionByName(fresh) if live else stored
