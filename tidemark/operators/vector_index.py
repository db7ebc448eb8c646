"""A stored index for nearest-vector search: cells around centres, as folders of Parquet that a manifest names.

Centres come from a few rounds of spherical k-means over a bounded sample; every row is assigned to its nearest
centre and written to that cell's folder. A search reads the cells nearest to the query (approximate), and by
default also every cell that may still hold a nearer row: a cell of radius r at angle a holds nothing nearer than
a - r, so the result equals that of a full search.

The manifest keeps centres, widest angles, row counts and, where they are few, the labels of each cell, so another
session opens the index without a job. Inserts go to the cells that are there; one that outgrows `full` rows is split in
two around centres of its own, and only its rows are written again. Each insert and split publishes a new version of the
manifest, and of two writers one fails. A search for labels leaves out cells that have none of them.

Vectors that are null, zero, not finite or of another length are kept in a cell of their own that no search reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.vector import nearest
from tidemark.session import Store, prepare

APART = -1  # the cell of rows that no search finds
SLACK = 1e-6  # rounding of angles
BIN = 16_384  # rows, or queries, that a task of a search for many queries holds
LABELS = 64  # of a cell, kept for pruning


def _centres(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    centres = sample[:cells].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def _units(column: pa.Array | pa.ChunkedArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors can be searched, these as unit rows), from the array's buffers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(column.offsets.to_numpy()) == d)
    flat = column.filter(pa.array(ok)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)  # null components are nan
    top = np.abs(flat).max(1, initial=0) if d else np.zeros(len(flat))
    fine = np.isfinite(top) & (top > 0)
    ok[np.flatnonzero(ok)[~fine]] = False
    x = flat[fine] / top[fine, None]
    return ok, x / np.sqrt((x * x).sum(1, keepdims=True))


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest
        self.key, self.vector, self.label, self.full = (manifest[k] for k in ("key", "vector", "label", "full"))
        self.schema = T.StructType.fromJson(manifest["schema"])

    # building ---------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str, vector: str, cells: int | None = None, sample: int = 20_000, rounds: int = 5, label: str | None = None, full: int | None = None) -> VectorIndex:
        """Index (key, vector, label) of every row; only the centres are fitted on `sample` rows, those of the smallest
        hash. A cell is split when an insert makes it larger than `full`, by default eight times a cell's share now."""
        spark = rows.sparkSession
        prepare(spark)
        rows = rows.select(key, vector, *([label] if label else []))
        n = rows.count()
        cells = cells or min(1024, max(1, int(n**0.5)))
        first = rows.where(F.size(vector) > 0).orderBy(F.xxhash64(key), key).limit(sample).select(vector).toArrow().column(0).combine_chunks()
        lengths = np.diff(first.offsets.to_numpy()) if len(first) else np.ones(1, int)
        d = int(np.bincount(lengths).argmax())
        known = _units(first, d)[1] if len(first) else np.empty((0, d))
        centres = _centres(known, min(cells, len(known)), rounds) if len(known) else np.eye(1, d)
        manifest = {"version": 0, "key": key, "vector": vector, "label": label, "full": full or max(1_000, 8 * n // len(centres)), "schema": rows.schema.jsonValue(), "dimensions": d, "next": len(centres)}
        manifest["cells"] = {str(k): {"centre": c.tolist(), "roots": [], "rows": 0, "angle": 0.0, "labels": []} for k, c in enumerate(centres)}
        index = cls(spark, path, manifest)
        index.insert(rows)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        store = Store(spark)
        return cls(spark, path, store.read_json(f"{path}/manifest/{store.names(f'{path}/manifest')[-1]}"))

    def _publish(self) -> None:
        self.manifest["version"] += 1
        Store(self.spark).write_json(f"{self.path}/manifest/{self.manifest['version']:08d}.json", self.manifest)

    @property
    def cells(self) -> dict[int, tuple[float, int]]:
        """Widest angle and rows of each cell that has any."""
        return {int(k): (c["angle"], c["rows"]) for k, c in self.manifest["cells"].items() if c["rows"] and int(k) != APART}

    def _assign(self, rows: DataFrame, names: list[int]) -> DataFrame:
        """Rows with the nearest of these cells, and the angle to its centre."""
        centres = np.array([self.manifest["cells"][str(k)]["centre"] for k in names])
        shared = self.spark.sparkContext.broadcast((np.array(names, np.int32), centres))  # a row a cell
        d, vector = self.manifest["dimensions"], self.vector

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, at = shared.value
            for b in batches:
                ok, unit = _units(b.column(b.schema.get_field_index(vector)), d)
                cell, angle = np.full(b.num_rows, APART, np.int32), np.zeros(b.num_rows)
                cosine = unit @ at.T
                cell[ok] = own[cosine.argmax(1)]
                angle[ok] = np.arccos(np.clip(cosine.max(1), -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], [*b.schema.names, "cell", "angle"])

        schema = T.StructType([*self.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
        return rows.mapInArrow(run, schema)

    def _write(self, placed: DataFrame) -> dict[str, dict]:
        """Facts of the cells of rows just written: a row a cell reaches the driver."""
        root = f"{self.path}/rows/part={uuid.uuid4().hex}"
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(root)  # a large cell goes to several tasks
        schema = T.StructType([*self.schema.fields, T.StructField("angle", T.DoubleType()), T.StructField("cell", T.IntegerType())])
        told = self.spark.read.schema(schema).parquet(root).groupBy("cell", *([self.label] if self.label else [])).agg(F.count("*").alias("n"), F.max("angle").alias("angle"))
        facts = {str(r.cell): {"roots": [root], "rows": r.n, "angle": r.angle, "labels": None} for r in told.groupBy("cell").agg(F.sum("n").alias("n"), F.max("angle").alias("angle")).collect()}
        if self.label:
            few = told.groupBy("cell").agg(F.count("*").alias("kinds")).where(F.col("kinds") <= LABELS).select("cell")
            for cell, label in told.join(few, "cell").select("cell", self.label).collect():  # LABELS rows a cell at most
                facts[str(cell)]["labels"] = [*(facts[str(cell)]["labels"] or []), *([] if label is None else [label])]
        return facts

    def insert(self, rows: DataFrame) -> list[int]:
        """Add rows; the cells that were split for it."""
        prepare(self.spark)
        cells = self.manifest["cells"]
        found = self._write(self._assign(rows.select(*self.schema.names), [int(k) for k in cells if int(k) != APART]))
        for k, new in found.items():
            c = cells.setdefault(k, {"centre": None, "roots": [], "rows": 0, "angle": 0.0, "labels": []})
            both = None if c["labels"] is None or new["labels"] is None else sorted({*c["labels"], *new["labels"]})
            c |= {"roots": c["roots"] + new["roots"], "rows": c["rows"] + new["rows"], "angle": max(c["angle"], new["angle"]), "labels": both if both is None or len(both) <= LABELS else None}
        self._publish()
        full = [int(k) for k, c in cells.items() if c["rows"] > self.full and int(k) != APART]
        for k in full:
            self._split(k)
        return full

    def _split(self, cell: int, sample: int = 2_000, rounds: int = 5) -> None:
        """Put two cells in the place of one; a cell of equal vectors stays as it is."""
        old = self.manifest["cells"][str(cell)]
        rows = self._read([cell]).select(*self.schema.names)
        first = rows.orderBy(F.xxhash64(self.key), self.key).limit(sample).select(self.vector).toArrow().column(0)
        unit = _units(first, self.manifest["dimensions"])[1]
        apart = unit[int((unit @ unit[0]).argmin())]
        if apart @ unit[0] > 1 - 1e-9:
            return
        centres = _centres(np.vstack([unit[:1], apart[None], unit]), 2, rounds)
        names = [self.manifest["next"], self.manifest["next"] + 1]
        for k, c in zip(names, centres):
            self.manifest["cells"][str(k)] = {"centre": c.tolist(), "roots": [], "rows": 0, "angle": 0.0, "labels": []}
        for k, facts in self._write(self._assign(rows, names)).items():
            self.manifest["cells"][k] |= facts
        assert sum(self.manifest["cells"][str(k)]["rows"] for k in names) == old["rows"]
        del self.manifest["cells"][str(cell)]
        self.manifest["next"] += 2
        self._publish()

    # reading ----------------------------------------------------------------------------------------------

    def _read(self, cells: list[int]) -> DataFrame:
        """Rows of the cells, with their cell: roots that hold one of them, and in these only their folders. Numbers of
        cells are never used again, so what a split leaves behind is not read."""
        schema = T.StructType([*self.schema.fields, T.StructField("part", T.StringType()), T.StructField("cell", T.IntegerType())])
        roots = sorted({r for k in cells for r in self.manifest["cells"][str(k)]["roots"]})
        if not roots:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.path}/rows").schema(schema).parquet(*roots).where(F.col("cell").isin(cells))

    def _names(self, labels: list | None) -> np.ndarray:
        """Cells that may hold rows of the labels."""
        fits = lambda c: labels is None or c["labels"] is None or bool(set(c["labels"]) & set(labels))
        return np.array(sorted(k for k in self.cells if fits(self.manifest["cells"][str(k)])), int)

    def _nearest(self, query: list[float], cells: list[int], k: int, labels: list | None) -> DataFrame:
        at = F.array(*(F.lit(float(x)) for x in query))
        rows = self._read(cells)
        if labels is not None:
            rows = rows.where(F.col(self.label).isin(labels))
        return nearest(rows, self.vector, at, k, self.key).select(self.key, "distance")

    def search(self, query: list[float], k: int, probes: int = 8, exact: bool = True, labels: list | None = None) -> DataFrame:
        """(key, distance) of the k nearest rows, of these labels where given; exact=False reads the `probes` nearest
        cells only."""
        if labels is not None and not self.label:
            raise ValueError("the index keeps no labels")
        ok, unit = _units(pa.array([query], pa.list_(pa.float64())), self.manifest["dimensions"])
        if not ok[0]:
            raise ValueError("a query needs finite components, one of them not zero, and the length of the index")
        names = self._names(labels)
        if not len(names):
            return self._nearest(query, [], k, labels)
        cells = self.manifest["cells"]
        angle = np.arccos(np.clip(np.array([cells[str(c)]["centre"] for c in names]) @ unit[0], -1, 1))
        least = angle - np.array([cells[str(c)]["angle"] for c in names])
        near = np.argsort(angle, kind="stable")[:probes]
        if exact and len(near) < len(names):
            found = self._nearest(query, names[near].tolist(), k, labels).collect()  # k rows
            reach = np.arccos(np.clip(1 - found[-1]["distance"], -1, 1)) if len(found) == k else np.inf
            near = np.union1d(near, np.flatnonzero(least <= reach + SLACK))
        return self._nearest(query, names[near].tolist(), k, labels)

    def _bins(self, names: np.ndarray) -> list[tuple[int, int, int]]:
        """(cell, first, parts): neighbouring cells share a bin of about so many rows, a larger cell is dealt over several."""
        out, at, held = [], 0, 0
        for name in names.tolist():
            n = self.manifest["cells"][str(name)]["rows"]
            if held and held + n > BIN:
                at, held = at + 1, 0
            parts = -(-n // BIN)
            out.append((name, at, parts))
            at, held = (at + parts, 0) if parts > 1 else (at, held + n)
        return out

    def search_many(self, queries: DataFrame, key: str, vector: str, k: int, probes: int = 8) -> DataFrame:
        """(query, key, probe, distance, rank) of the k nearest rows that the `probes` nearest cells hold, for every query in
        one job. probe: which of its nearest cells had the row.

        Rows lie in bins of cells; a query goes once to each bin that has one of its cells. A bin's rows meet the queries
        sent there, some thousands of either, by products of matrices, and only k rows of each query leave it."""
        prepare(self.spark)
        names = self._names(None)
        centres = np.array([self.manifest["cells"][str(c)]["centre"] for c in names]).reshape(len(names), -1)
        name = self.key
        d = self.manifest["dimensions"]
        told = queries.select(F.col(key).alias("query"), F.col(vector).alias("asked"))
        query, label = _kind(told.schema, "query"), _kind(self.schema, name)
        if not len(names):
            return told.select("query", F.lit(None).cast(label).alias(name), F.lit(1).alias("probe"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).limit(0)
        bins = self._bins(names)
        shared = self.spark.sparkContext.broadcast((names.astype(np.int32), centres, np.array(bins)))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, at, dealt = shared.value
            few = min(probes, len(own))
            for b in batches:
                for s in range(0, b.num_rows, 256):
                    some = b.slice(s, 256)
                    ok, unit = _units(some.column(1), d)
                    best = np.argsort(-(unit @ at.T), axis=1, kind="stable")[:, :few]
                    wide = dealt[best.ravel(), 2]
                    row = np.repeat(np.repeat(np.arange(len(unit)), few), wide)
                    part = np.repeat(dealt[best.ravel(), 1], wide) + np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide)
                    cell, probe = np.repeat(own[best.ravel()], wide), np.repeat(np.tile(np.arange(1, few + 1), len(unit)), wide)
                    order = np.lexsort((part, row))
                    row, part, cell, probe = (x[order].astype(np.int32) for x in (row, part, cell, probe))
                    first = np.flatnonzero(np.r_[len(row) > 0, (row[1:] != row[:-1]) | (part[1:] != part[:-1])])
                    ends = pa.array(np.r_[first, len(row)].astype(np.int32))
                    who = pa.array(np.flatnonzero(ok)[row[first]])
                    cols = [some.column(0).take(who), some.column(1).take(who), pa.array(part[first]), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (cell, probe))]
                    yield pa.RecordBatch.from_arrays(cols, ["query", "asked", "bin", "cells", "probes"])

        def distances(sent: pa.Table, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by(name)
            y, cell = _units(rows.column(self_vector), d)[1], rows.column("cell").to_numpy()
            known = np.unique(cell)
            found: list[tuple[np.ndarray, ...]] = []
            for s in range(0, sent.num_rows if len(y) else 0, 512):
                some = sent.slice(s, 512).combine_chunks()
                x = _units(some.column("asked"), d)[1]
                cells, took = (some.column(c).combine_chunks() for c in ("cells", "probes"))
                ask = np.repeat(np.arange(len(x)), np.diff(cells.offsets.to_numpy()))
                probe = np.zeros((len(x), len(known) + 1), np.int32)
                flat = cells.flatten().to_numpy()
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                probe[ask, np.where(known[at] == flat, at, len(known))] = took.flatten().to_numpy()
                which = np.searchsorted(known, cell)
                far = 1 - x @ y.T
                far[probe[:, which] == 0] = np.inf
                edge = np.partition(far, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
                i, j = np.nonzero((far <= edge[:, None] + SLACK) & np.isfinite(far))
                exact = np.concatenate([1 - (x[i[c : c + 8192]] * y[j[c : c + 8192]]).sum(1) for c in range(0, len(i), 8192)] or [np.empty(0)])
                order = np.lexsort((j, exact, i))  # rows are in order of their keys
                i, j, exact = i[order], j[order], exact[order]
                start = np.flatnonzero(np.r_[len(i) > 0, i[1:] != i[:-1]])
                place = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
                top = place < k
                found.append((s + i[top], j[top], probe[i[top], which[j[top]]], exact[top]))
            i, j, p, e = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, t) for t in (int, int, np.int32, float))
            return pa.table({"query": sent.column("query").take(pa.array(i)), name: rows.column(name).take(pa.array(j)), "probe": pa.array(p, pa.int32()), "distance": pa.array(e, pa.float64())})

        self_vector = self.vector
        asked = told.mapInArrow(send, f"query {query}, asked {_kind(told.schema, 'asked')}, bin int, cells array<int>, probes array<int>")
        blocks = max(1, -(-told.count() // BIN))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
        placed = F.broadcast(self.spark.createDataFrame(bins, "cell int, first int, parts int"))
        rows = self._read(names.tolist()).join(placed, "cell").select("cell", name, self.vector, (F.col("first") + F.pmod(F.xxhash64(name), "parts")).cast("int").alias("bin"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        tasks = min(8192, blocks * (max(first + parts for _, first, parts in bins)))
        both = asked.repartition(tasks, "bin", "block").groupBy("bin", "block").cogroup(rows.repartition(tasks, "bin", "block").groupBy("bin", "block"))
        met = both.applyInArrow(distances, f"query {query}, `{name}` {label}, probe int, distance double")
        by = Window.partitionBy("query").orderBy("distance", name)
        return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    def probes_for(self, queries: DataFrame, key: str, vector: str, k: int, recall: float) -> int:
        """The least number of cells to look at that gives these queries so much of their k nearest rows."""
        whole = self.search_many(queries, key, vector, k, max(1, len(self.cells)))
        counts = sorted(tuple(r) for r in whole.groupBy("probe").count().collect())  # a row a cell at most
        seen, all_rows = 0, sum(c for _, c in counts)
        for probe, c in counts:
            seen += c
            if seen >= recall * all_rows:
                return probe
        return 1


def _kind(schema: T.StructType, name: str) -> str:
    return schema[name].dataType.simpleString()
