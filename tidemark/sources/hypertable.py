"""Tables split into time chunks, kept as Parquet folders that a versioned manifest names.

A chunk holds the rows of one span of time. Appending writes new folders and then a new manifest; compacting,
tiering, replacing and dropping do the same, so readers see a change whole or not at all, and a writer that
loses the race for the next version fails. Folders that a manifest no longer names stay for readers that still
use them. Scans read only the folders of chunks that their time range touches and keep the time predicate, so
Parquet prunes inside them. Writing rebalances rows by chunk: a large chunk is split over tasks and files at run
time, small ones share a task. A row without a time is refused.

Each version of the manifest says which ranges of time its change touched, to a part of a chunk (20 s of seven days): an append
sets a bit for each part that got rows, in one small aggregation over the times just written. So what changed since a
version is the union over the versions after it (`changes`), and rollups need not look at anything else.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeseries import micros
from tidemark.operators.ranges import Ranges, merged
from tidemark.session import Store

_SECOND = 1_000_000
_PARTS = 32_768  # bits of a chunk's bitmap


def _seconds(t: datetime) -> int:
    return int(t.replace(tzinfo=t.tzinfo or timezone.utc).timestamp())


def _time(seconds: int) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)


def _literal(micro: int) -> Column:
    """A time of so many microseconds since 1970."""
    return F.lit(datetime(1970, 1, 1) + timedelta(microseconds=micro)).cast("timestamp_ntz")


@dataclass
class HypertableSpec:
    """name, time column, chunk width, the columns that group and order rows inside a chunk, and the columns that
    get a Parquet bloom filter when a chunk is compacted."""

    name: str
    time: str
    chunk: timedelta = timedelta(days=7)
    segment_by: list[str] = field(default_factory=list)
    order_by: list[str] = field(default_factory=list)
    bloom: list[str] = field(default_factory=list)


class Hypertable:
    def __init__(self, spark: SparkSession, path: str, spec: HypertableSpec, schema: T.StructType | None = None, cold: str | None = None):
        self.spark, self.path, self.spec, self.store = spark, path, spec, Store(spark)
        self.cold = cold or f"{path}/cold"
        self.schema = schema
        if schema is None and self._versions():
            self.schema = T.StructType.fromJson(self.manifest()["schema"])

    # manifest ---------------------------------------------------------------------------------------------

    def _versions(self) -> list[str]:
        return [n for n in self.store.names(f"{self.path}/manifest") if n.endswith(".json")]

    def manifest(self) -> dict:
        names = self._versions()
        return self.store.read_json(f"{self.path}/manifest/{names[-1]}") if names else {"version": 0, "chunks": {}, "facts": {}, "schema": self.schema.jsonValue() if self.schema else None}

    def _publish(self, m: dict, changed: Ranges = ()) -> None:
        m["version"] += 1
        m["changed"] = list(changed)
        m["newest"] = max([m.get("newest"), *(e for _, e in changed)], key=lambda t: -math.inf if t is None else t)
        self.store.write_json(f"{self.path}/manifest/{m['version']:08d}.json", m)

    def set_fact(self, name: str, value) -> None:
        m = self.manifest()
        m["facts"][name] = value
        self._publish(m)

    def facts(self) -> dict:
        return self.manifest()["facts"]

    def newest(self) -> datetime | None:
        """A time just after the newest row ever written, to a part of a chunk."""
        t = self.manifest().get("newest")
        return None if t is None else datetime(1970, 1, 1) + timedelta(microseconds=t)

    def changes(self, since: int) -> tuple[Ranges, int]:
        """Ranges of time that were written to after that version, and the version now."""
        names = self._versions()
        ranges = [r for n in names if int(n.split(".")[0]) > since for r in self.store.read_json(f"{self.path}/manifest/{n}").get("changed", [])]
        return merged(ranges), int(names[-1].split(".")[0]) if names else 0

    def _grain(self) -> int:
        """Microseconds of a part of a chunk: where it can be, a whole part of a minute, an hour or a day, so that no part
        reaches over the edge of a bucket."""
        width = self._width()
        fits = [g for g in (1, 2, 3, 4, 5, 6, 10, 12, 15, 20, 30, 60, 120, 300, 600, 900, 1800, 3600, 86400) if width % g == 0 and width // g <= _PARTS]
        return fits[0] * _SECOND if fits else -(-width * _SECOND // _PARTS)

    def _touched(self, folders: dict[str, str]) -> Ranges:
        """Ranges of time of the rows in folders just written, by their chunk starts."""
        if not folders:
            return []
        width, grain = self._width() * _SECOND, self._grain()
        at = micros(F.col(self.spec.time))
        start = F.floor(at / width) * width
        bits = self._read(list(folders.values())).select(start.cast("long").alias("start"), F.call_function("div", at - start, F.lit(grain)).cast("long").alias("part"))
        out = []
        for start, bitmap in bits.groupBy("start").agg(F.bitmap_construct_agg("part")).collect():  # 4 kB a chunk
            on = np.flatnonzero(np.diff(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"), prepend=0, append=0)).tolist()
            out += [[start + s * grain, start + min(e * grain, width)] for s, e in zip(on[::2], on[1::2])]
        return merged(out)

    # writing ----------------------------------------------------------------------------------------------

    def _width(self) -> int:
        return self.spec.chunk // timedelta(seconds=1)

    def _write(self, df: DataFrame, root: str, compact: bool = False) -> dict[str, str]:
        """Folders by chunk start."""
        start = F.floor(micros(F.col(self.spec.time)) / (self._width() * _SECOND)) * self._width()
        order = [*self.spec.segment_by, *(self.spec.order_by or [F.col(self.spec.time).desc()])]
        refused = F.raise_error(F.lit(f"{self.spec.name}: a row has no {self.spec.time}")).cast("long")
        rows = df.withColumn("chunk_start", F.coalesce(start.cast("long"), refused))
        rows = rows.hint("rebalance", "chunk_start", *(self.spec.segment_by if compact else ()))
        folder = f"{root}/{uuid.uuid4().hex}"
        writer = rows.sortWithinPartitions("chunk_start", *order).write.partitionBy("chunk_start")
        if compact:
            writer = writer.option("compression", "zstd")
            for c in self.spec.bloom:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(folder)
        return {n.split("=")[1]: f"{folder}/{n}" for n in self.store.names(folder) if n.startswith("chunk_start=")}

    def append(self, df: DataFrame, **facts) -> None:
        """Add rows, and set facts with them."""
        if self.schema is None:
            self.schema = df.schema
        m = self.manifest()
        m["schema"] = self.schema.jsonValue()
        new = self._write(df.select(*self.schema.names), f"{self.path}/data")
        for start, folder in new.items():
            c = m["chunks"].setdefault(start, {"folders": [], "compressed": False, "tiered": False, "before": None})
            c["folders"].append(folder)
            c["compressed"] = False
        m["facts"] |= facts
        self._publish(m, self._touched(new))

    def add_column(self, name: str, kind: str) -> None:
        """Rows written before have null in it."""
        m = self.manifest()
        self.schema = T.StructType([*self.schema.fields, T.StructField(name, T.DataType.fromDDL(kind))])
        m["schema"] = self.schema.jsonValue()
        self._publish(m)

    def set_options(self, **options) -> None:
        """segment_by, order_by or bloom of chunks that are written or compacted from now on."""
        for name, value in options.items():
            if name not in ("segment_by", "order_by", "bloom"):
                raise ValueError(f"no option {name}")
            setattr(self.spec, name, list(value))

    def _rewrite(self, starts: list[str], root: str, compact: bool = True, **state) -> None:
        """Write chunks anew, all in one job."""
        if not starts:
            return
        m = self.manifest()
        old = [f for k in starts for f in m["chunks"][k]["folders"]]
        new = self._write(self._read(old), root, compact)
        for k in starts:
            c = m["chunks"][k]
            before = c["before"] or sum(self.store.size(f) for f in c["folders"])
            sizes = {"before": before, "after": self.store.size(new[k])} if compact else {"before": None, "after": None}
            m["chunks"][k] = c | {"folders": [new[k]], "compressed": compact} | sizes | state
        self._publish(m)

    def compress_chunks(self, starts: list[int]) -> None:
        """Rewrite chunks grouped and ordered, with strong compression; those that are so already stay."""
        chunks = self.manifest()["chunks"]
        self._rewrite([str(s) for s in starts if not chunks[str(s)]["compressed"]], f"{self.path}/data")

    def compress_chunk(self, start: int) -> None:
        self.compress_chunks([start])

    def decompress_chunk(self, start: int) -> None:
        """Rewrite a compacted chunk in plain form; again does nothing."""
        c = self.manifest()["chunks"][str(start)]
        if c["compressed"]:
            self._rewrite([str(start)], self.cold if c["tiered"] else f"{self.path}/data", compact=False)

    def tier_chunks(self, starts: list[int]) -> None:
        """Move chunks to the cold folder."""
        chunks = self.manifest()["chunks"]
        self._rewrite([str(s) for s in starts if not chunks[str(s)]["tiered"]], self.cold, tiered=True)

    def tier_chunk(self, start: int) -> None:
        self.tier_chunks([start])

    def replace(self, ranges: Ranges, df: DataFrame | None, **facts) -> None:
        """Put df in the place of the rows in these ranges of time, and set facts with it; rewrites the chunks that the
        ranges touch."""
        m = self.manifest()
        m["facts"] |= facts
        if ranges:
            if self.schema is None:
                self.schema = df.schema
            m["schema"] = self.schema.jsonValue()
            hit = {k: c for k, c in m["chunks"].items() if self._meets(int(k), ranges)}
            old = [f for c in hit.values() for f in c["folders"]]
            rows = df.select(*self.schema.names)
            if old:
                rows = self._read(old).where(~self._within(ranges)).unionByName(rows)
            new = self._write(rows, f"{self.path}/data")
            for k in hit:
                del m["chunks"][k]
            for k, folder in new.items():
                m["chunks"][k] = {"folders": [folder], "compressed": False, "tiered": False, "before": None}
        self._publish(m, ranges)

    def drop_chunks(self, older_than: datetime) -> list[int]:
        """Drop chunks that end at or before the time; their starts."""
        m = self.manifest()
        gone = [k for k in m["chunks"] if int(k) + self._width() <= _seconds(older_than)]
        for k in gone:
            del m["chunks"][k]
        if gone:
            self._publish(m)
        return sorted(map(int, gone))

    def drop(self) -> None:
        """Delete the table with its own folders."""
        self.store.delete(self.path)
        self.store.delete(self.cold)

    # reading ----------------------------------------------------------------------------------------------

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def scan(self, t0: datetime | None = None, t1: datetime | None = None, tiered: bool = True) -> DataFrame:
        """Rows with t0 <= time < t1; tiered: cold chunks too."""
        folders = []
        for k, c in sorted(self.manifest()["chunks"].items()):
            if (t0 is None or int(k) + self._width() > _seconds(t0)) and (t1 is None or int(k) < _seconds(t1) + (t1.microsecond > 0)) and (tiered or not c["tiered"]):
                folders += c["folders"]
        df, t = self._read(folders), F.col(self.spec.time)
        if t0 is not None:
            df = df.where(t >= F.lit(t0).cast("timestamp_ntz"))
        return df if t1 is None else df.where(t < F.lit(t1).cast("timestamp_ntz"))

    def _meets(self, start: int, ranges: Ranges) -> bool:
        low, high = start * _SECOND, (start + self._width()) * _SECOND
        return any(s < high and e > low for s, e in ranges)

    def _within(self, ranges: Ranges) -> Column:
        t, out = F.col(self.spec.time), F.lit(False)
        for s, e in ranges:
            out = out | ((t >= _literal(s)) & (t < _literal(e)))
        return out

    def scan_ranges(self, ranges: Ranges) -> DataFrame:
        """Rows in any of the ranges; reads only chunks that one of them touches."""
        folders = [f for k, c in sorted(self.manifest()["chunks"].items()) if self._meets(int(k), ranges) for f in c["folders"]]
        return self._read(folders).where(self._within(ranges))

    def describe(self) -> DataFrame:
        """(column_name, data_type, role) of each column."""
        roles = {c: "segment" for c in self.spec.segment_by} | {self.spec.time: "time"}
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), roles.get(f.name)) for f in self.schema], "column_name string, data_type string, role string")

    def chunk_starts(self) -> list[int]:
        return sorted(map(int, self.manifest()["chunks"]))

    def chunks(self) -> DataFrame:
        """(hypertable_name, chunk_name, range_start, range_end, is_compressed, is_tiered, before_bytes, after_bytes)."""
        rows = [
            (self.spec.name, f"{self.spec.name}_{k}", _time(int(k)), _time(int(k) + self._width()), c["compressed"], c["tiered"], c["before"] or sum(map(self.store.size, c["folders"])), c.get("after") if c["compressed"] else None)
            for k, c in sorted(self.manifest()["chunks"].items())
        ]
        return self.spark.createDataFrame(rows, "hypertable_name string, chunk_name string, range_start timestamp_ntz, range_end timestamp_ntz, is_compressed boolean, is_tiered boolean, before_bytes long, after_bytes long")

    def compression_stats(self) -> DataFrame:
        """One row: bytes before and after over the compacted chunks, and what was saved in percent."""
        done = self.chunks().where("is_compressed")
        before, after = F.sum("before_bytes"), F.sum("after_bytes")
        return done.agg(F.count("*").alias("compressed_chunks"), before.alias("before_bytes"), after.alias("after_bytes"), F.round((1 - after / F.nullif(before, F.lit(0))) * 100, 1).alias("saved_percent"))
