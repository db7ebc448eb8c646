"""Streams into chunked tables, each row once, with rollups refreshed behind them."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.rollup import Rollup
from tidemark.sources.hypertable import Hypertable


@dataclass
class Ingest:
    """Appends the batches of a stream to a table and refreshes rollups up to `lag` before the newest row.

    A batch's number is published with its rows, in the same version of the table's manifest, under the id that the
    checkpoint gives the stream. So a batch that is run again, because the driver was lost after the rows were written
    and before the stream noted it, is known and left out, and its rollups are refreshed then if they were not before:
    what changed is noted with the rows, too. Rows written by a batch that never published are in no chunk.
    """

    table: Hypertable
    checkpoint: str
    rollups: list[Rollup] = field(default_factory=list)
    lag: timedelta = timedelta(0)

    def _name(self) -> str:
        return "stream-" + self.table.store.read_json(f"{self.checkpoint}/metadata")["id"]

    def put(self, batch: DataFrame, number: int) -> None:
        name = self._name()
        if number > self.table.facts().get(name, -1):
            self.table.append(batch, **{name: number})
        newest = self.table.newest()
        if newest is not None:
            for r in self.rollups:
                r.refresh(None, newest - self.lag)

    def start(self, rows: DataFrame, every: str | None = None) -> StreamingQuery:
        """Take in what is there and end, or go on with a batch `every` so often."""
        writer = rows.writeStream.foreachBatch(self.put).option("checkpointLocation", self.checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
