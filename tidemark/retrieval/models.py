"""Embedding and chat models as small protocols, with deterministic stand-ins that need no network."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.vector import nearest
from tidemark.session import Store, prepare


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class ChatModel(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class HashingEmbedder:
    """Bag of words hashed into a unit vector: the same text gives the same vector everywhere."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for k, text in enumerate(texts):
            for w in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(w.encode())
                out[k, h % self.dimensions] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class EchoChat:
    """Says what it was asked, for tests and offline runs."""

    def complete(self, system: str, user: str) -> str:
        return f"{system}\n{user}"


class Patient:
    """A model behind a service: texts go in batches of at most `batch`, and a call that fails is made again, after a
    pause that doubles, at most `attempts` times."""

    def __init__(self, model: Embedder | ChatModel, batch: int = 64, attempts: int = 4, pause: float = 0.5):
        self.model, self.batch, self.attempts, self.pause = model, batch, attempts, pause
        self.dimensions = getattr(model, "dimensions", 0)

    def _call(self, f, *args):
        for k in range(self.attempts):
            try:
                return f(*args)
            except Exception:
                if k + 1 == self.attempts:
                    raise
                time.sleep(self.pause * 2**k)

    def embed(self, texts: list[str]) -> np.ndarray:
        parts = [self._call(self.model.embed, texts[k : k + self.batch]) for k in range(0, len(texts), self.batch)]
        if any(len(p) != len(texts[k * self.batch : (k + 1) * self.batch]) for k, p in enumerate(parts)):
            raise ValueError("the model gave another number of vectors than texts")
        return np.concatenate(parts) if parts else np.empty((0, self.dimensions), np.float32)

    def complete(self, system: str, user: str) -> str:
        return self._call(self.model.complete, system, user)


def _parts(texts: pa.Array, most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts of an Arrow batch, some at a time, of about so many bytes together: a batch may hold 10,000 long ones."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield [t or "" for t in texts.slice(a, b - a).to_pylist()]


def _vectors(model: Embedder, texts: list[str]) -> pa.ListArray:
    x = np.asarray(model.embed(texts), np.float32).reshape(len(texts), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def embed(text: Column, model: Embedder) -> Column:
    """Vector of each text, in parts of Arrow batches."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            done = [_vectors(model, part) for part in _parts(texts) if part]
            yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.float32()))

    return run(text)


def split_text(text: str | None, size: int = 800, overlap: int = 0, marks: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most size characters, cut at the first of the marks that makes them fit."""
    if not text:
        return []
    if len(text) <= size:
        return [text]
    mark = next(m for m in marks if not m or m in text)
    last = text.count(mark)
    parts = list(text) if not mark else [p + mark * (k < last) for k, p in enumerate(text.split(mark))]
    out, held = [], ""
    for p in parts:
        if len(held) + len(p) > size and held:
            out.append(held)
            held = held[-overlap:] if overlap and len(held[-overlap:]) + len(p) <= size else ""
        if len(p) > size:
            out += split_text(p, size, overlap, marks[marks.index(mark) + 1 :])
        else:
            held += p
    return out + [held] if held else out


def chunk_texts(df: DataFrame, key: str, text: str, size: int = 800, overlap: int = 0, model: Embedder | None = None, along: tuple[str, ...] = ()) -> DataFrame:
    """(key, chunk_seq, chunk) of every row's pieces, with their embedding where a model is given and columns that come
    along; texts are cut and embedded in one pass, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in _parts(b.column(1)):
                cut = [split_text(t, size, overlap) for t in part]
                row = pa.array(np.repeat(np.arange(at, at + len(cut)), [len(c) for c in cut]))
                at += len(cut)
                told = [c for own in cut for c in own]
                if not told:
                    continue
                cols = [b.column(0).take(row), pa.array([k for own in cut for k in range(len(own))], pa.int32()), pa.array(told, pa.string())]
                cols += [_vectors(model, told)] if model else []
                yield pa.RecordBatch.from_arrays([*cols, *(b.column(k).take(row) for k in range(2, b.num_columns))], names)

    prepare(df.sparkSession)
    rows = df.select(key, F.col(text).cast("string").alias("text"), *along)
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField(key, kinds[key]), T.StructField("chunk_seq", T.IntegerType()), T.StructField("chunk", T.StringType())])
    if model:
        schema.add("embedding", T.ArrayType(T.FloatType()))
    for c in along:
        schema.add(c, kinds[c])
    names = schema.names
    return rows.mapInArrow(run, schema)


class Vectorizer:
    """Keeps a Parquet store of embedded chunks in step with a source.

    Each row is stored with the hash of its text. A run finds rows that are new, changed or gone by a full outer join of
    hashes, embeds the new and changed ones and writes them under the run's number, with a mark (no chunk) for keys that
    have none any more. A key's newest run is what counts when the store is read. Keys must be unique and not null; a
    source is taken as the whole table: what it lacks is gone.
    """

    def __init__(self, path: str, key: str, text: str, model: Embedder, size: int = 800):
        self.path, self.key, self.text, self.model, self.size = path, key, text, model, size

    def _runs(self, spark: SparkSession) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in Store(spark).names(self.path) if n.startswith("run="))

    def _rows(self, source: DataFrame) -> DataFrame:
        """All that was ever written, with its run."""
        spark = source.sparkSession
        kind = source.schema[self.key].dataType.simpleString()
        schema = f"`{self.key}` {kind}, chunk_seq int, chunk string, embedding array<float>, text_hash string, run int"
        return spark.read.schema(schema).parquet(self.path) if self._runs(spark) else spark.createDataFrame([], schema)

    def _newest(self, source: DataFrame) -> DataFrame:
        return self._rows(source).groupBy(self.key).agg(F.max("run").alias("run"))

    def stored(self, source: DataFrame) -> DataFrame:
        """(key, chunk_seq, chunk, embedding) of what is current."""
        return self._current(source).select(self.key, "chunk_seq", "chunk", "embedding")

    def _current(self, source: DataFrame) -> DataFrame:
        return self._rows(source).join(self._newest(source), [self.key, "run"], "left_semi").where("chunk_seq is not null")

    def changes(self, source: DataFrame) -> DataFrame:
        """(key, change): new, changed or gone; a row whose text is empty stays new as long as nothing is stored of it."""
        told = source.select(self.key, F.md5(F.coalesce(self.text, F.lit(""))).alias("now"))
        known = self._current(source).groupBy(self.key).agg(F.first("text_hash").alias("then"))
        change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("then"), "changed")
        return told.join(known, self.key, "full_outer").select(self.key, change.alias("change")).where("change is not null")

    def pending(self, source: DataFrame) -> DataFrame:
        """Rows of the source that the next run embeds."""
        return source.join(self.changes(source).where("change <> 'gone'"), self.key, "left_semi")

    def run(self, source: DataFrame) -> None:
        prepare(source.sparkSession)
        run = max(self._runs(source.sparkSession), default=-1) + 1
        rows = self.pending(source).withColumn("text_hash", F.md5(F.coalesce(self.text, F.lit(""))))
        chunks = chunk_texts(rows, self.key, self.text, self.size, model=self.model, along=("text_hash",))
        emptied = source.where(F.coalesce(self.text, F.lit("")) == "").select(self.key)
        changes = self.changes(source)
        gone = changes.where("change = 'gone'").select(self.key).unionByName(changes.where("change = 'changed'").select(self.key).join(emptied, self.key, "left_semi"))
        chunks.unionByName(gone, allowMissingColumns=True).write.parquet(f"{self.path}/run={run}")

    def compact(self, source: DataFrame) -> None:
        """Write what is current as one run and delete the runs before; no reader may be using them."""
        spark = source.sparkSession
        old = self._runs(spark)
        self._current(source).drop("run").write.parquet(f"{self.path}/run={max(old, default=-1) + 1}")
        for run in old:
            Store(spark).delete(f"{self.path}/run={run}")


def search(rows: DataFrame, question: str, model: Embedder, k: int = 10, vector: str = "embedding", tie: str = "id") -> DataFrame:
    """The k rows nearest to a question; filter rows before."""
    query = F.array(*[F.lit(float(x)) for x in model.embed([question])[0]])
    return nearest(rows, vector, query, k, tie)


def answer(found: DataFrame, text: str, order: list[str], system: str, question: str, chat: ChatModel) -> str:
    """Ask a chat model about the texts found; only they reach the driver, as one string."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_text"))))
    context = found.agg(F.array_join(F.transform(listed, lambda x: x["_text"]), "\n").alias("context")).first()["context"]
    return chat.complete(system, f"{question}\n{context}")
