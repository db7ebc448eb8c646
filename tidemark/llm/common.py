"""Helpers shared by the corpus operators: shared-folder tables, key-ordered chunks, components."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MADE: list[tuple[object, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is deleted when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_drop_all)
    _MADE.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _drop_all() -> None:
    for spark, table in _TABLES:
        try:
            spark.sql(f"drop table if exists {table}")
        except Exception:  # as below
            break
    for spark, path in _MADE:
        try:
            drop(spark, path)
        except Exception:  # the session is gone already; the shared folder belongs to the cluster
            return


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make gives, materialised. Tables that were written on the way are dropped, as nothing reads them any more."""
    at = len(_MADE)
    out, path = materialise(make(), name)
    for spark, old in _MADE[at:]:
        if old != path:
            drop(spark, old)
    _MADE[at:] = [x for x in _MADE[at:] if x[1] == path]
    return out


def materialise_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As materialise, in buckets of a key: joins on it read the rows where they lie instead of moving them. Its entry
    in the catalog goes with the files when the driver exits."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(table)
    _TABLES.append((spark, table))
    return spark.table(table)


def key_chunks(batches: Iterator[pa.RecordBatch], key: str, rows: int = 200_000) -> Iterator[pa.Table]:
    """Regroup batches sorted by key into tables of about so many rows that never split a key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if cut:
            yield t.slice(0, cut)
            held, n = t.slice(cut).to_batches(), n - cut
    if held:
        yield pa.Table.from_batches(held)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 4 << 20) -> Iterator[pa.Table]:
    """Regroup batches into tables of about so many bytes of text; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        at = 0
        lengths = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        while at < b.num_rows:
            end = int(np.searchsorted(lengths, lengths[at] + max(size - n, 0), side="right")) - 1
            end = min(max(end, at + (n == 0)), b.num_rows)
            if end > at:
                held.append(b.slice(at, end - at))
                n += int(lengths[end] - lengths[at])
            if end < b.num_rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
                give_back()
            at = end
    if held:
        yield pa.Table.from_batches(held)


def find_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b); component is its smallest node.

    Alternating large-star and small-star rounds: each round replaces links by links to the smallest
    neighbour, so a hub costs one link per node. Rounds are written to the shared folder; only a count
    and a checksum reach the driver. Nodes without links to others do not appear.
    """
    spark = edges.sparkSession
    star = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = materialise(star, "links")
    seen = None
    for _ in range(limit):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old = path
        now, path = materialise(small, "links")
        drop(spark, old)
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, side by side."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)
