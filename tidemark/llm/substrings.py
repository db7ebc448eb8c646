"""Removal of word sequences that documents share, by windows that double in length.

A window of `window` words is a repeat in a document if the same words also start in a document with a smaller
doc_id; every word that a repeat covers goes. Levels: window lengths go up from a short one by doubling (7 and 13,
or 4, 7 and 13: a window of 13 is two of 7 that share a word). At each level only windows whose two halves were
both found in several documents are candidates, and of these only the ones found in several documents go on; the
last level compares doc_ids. Windows found in one document alone end where they stand. `repeat_levels` carries the
doubling on beyond the full window, from the survivors of each level, until none is left.

At scale: texts are packed into chunks of bounded size, written once, in buckets, so that answers travel to the
chunks and no chunk is moved. At each level a chunk asks about its distinct candidate windows by 64-bit hashes
(`exchange`); an answer is a bit for each. So a window that a third of all documents hold costs one entry for each
chunk, nothing is gathered by window or by document, and rows are told apart by their place in a chunk.

Edge cases: a null or short text has no window and keeps all words; words are split at ASCII white space and
otherwise unchanged; repeats within one document, or between rows that repeat a doc_id, don't count; rows
that repeat a doc_id are judged each by its own text; a null doc_id is smaller than no other and no other is
smaller than it, so such a row keeps its words; a text longer than a chunk has a chunk of its own; other columns
may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_map, give_back, materialise, materialise_by, text_chunks
from tidemark.llm.exchange import answer, ask, ranges_for, unpacked, with_answers
from tidemark.llm.words import Words, mix, pack, unpack

_BASE = np.uint64(0xD6E8FEB86659FD93)


def lengths_up_to(window: int, least: int) -> list[int]:
    """Window lengths from one of `least` words or less (two at least) on, each but twice the one before."""
    out = [window]
    while out[0] > max(least, 2):
        out.insert(0, (out[0] + 1) // 2)
    return out


def _window_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """Hash of the tokens [i, i+length) for each i at which they fit."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h *= _BASE
        h += tokens[k : k + n]
    return mix(h)


class Chunk:
    """Words of some texts, and which windows of them are still candidates after the levels told so far."""

    def __init__(self, data: bytes):
        x = unpack(data)
        self.tokens = x["hashes"][x["codes"]] if len(x["codes"]) else np.empty(0, np.uint64)
        self.starts = np.r_[0, np.cumsum(x["lengths"])].astype(np.int64)
        self.docs = x["docs"]
        text = np.repeat(np.arange(len(x["lengths"])), x["lengths"])
        self.end = self.starts[1:][text]
        self.live = (x["none"] == 0)[text]  # a row without a doc_id takes no part
        self.doc = self.docs[text]

    def level(self, length: int, before: tuple[int, np.ndarray] | None) -> None:
        """Find candidates of a length, given the places where windows of the level before go on."""
        h = _window_hashes(self.tokens, length)
        if before is None:
            at = np.flatnonzero(self.live[: len(h)] & (np.arange(len(h)) + length <= self.end[: len(h)]))
        else:
            shorter, on = before
            alive = np.zeros(len(self.tokens) + 1, bool)
            alive[on] = True
            at = on[on + length <= self.end[on]]
            at = at[alive[at + length - shorter]]  # both halves stand
        keys = h[at]
        order = np.argsort(keys)
        new = np.r_[True, keys[order][1:] != keys[order][:-1]][: len(at)]
        first = np.flatnonzero(new)
        doc = self.doc[at[order]]
        self.at, self.keys = at, keys[order][first]
        self.group = np.empty(len(at), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(doc, first) if len(first) else np.empty(0, np.int64)
        self.most = np.maximum.reduceat(doc, first) if len(first) else np.empty(0, np.int64)

    def candidates(self, lengths: list[int], told: list[np.ndarray]) -> None:
        """The level after those told."""
        before = None
        for k, length in enumerate(lengths[: len(told) + 1]):
            self.level(length, before)
            if k < len(told):
                before = length, self.at[(told[k] > 0)[self.group]]

    def repeats(self, told: np.ndarray) -> np.ndarray:
        """Starts of windows of the present level that a document with a smaller doc_id has: here or elsewhere."""
        return self.at[(told > 0)[self.group] | (self.doc[self.at] > self.least[self.group])]


def _write(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for k, t in enumerate(text_chunks(batches, "_tm_text", size)):
        w = Words(t.column("_tm_text"))
        ids = t.column("_tm_doc").combine_chunks()
        data = pack(codes=w.codes.astype(np.uint32), lengths=np.diff(w.starts), hashes=w.hashes(), docs=ids.fill_null(0).to_numpy(zero_copy_only=False), none=ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        sink = pa.BufferOutputStream()
        rows = t.drop_columns(["_tm_doc"]).combine_chunks()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows)
        cols = [pa.array([(task << 32) + k], pa.int64()), pa.array([len(w.codes)], pa.int64()), pa.array([data], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["chunk", "words", "data", "rows"])


def _chunks(docs: DataFrame, columns: list[str], chunk_bytes: int) -> DataFrame:
    """(chunk, words, data, rows): texts packed for their windows, and the rows with these columns as they are."""
    own = [F.col(f"`{c}`").alias(f"_tm_{k}") for k, c in enumerate(columns)]
    rows = docs.select(docs["doc_id"].cast("long").alias("_tm_doc"), docs["text"].cast("string").alias("_tm_text"), *own)
    return materialise_by(arrow_map(rows, lambda b: _write(b, chunk_bytes), "chunk long, words long, data binary, rows binary"), "windows", "chunk")


def _early(keys: np.ndarray, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Windows go on that two chunks hold, or two documents of one chunk."""
    size = np.diff(np.r_[first, len(keys)])
    return np.repeat((size > 1) | (np.add.reduceat(values, first) > 0) if len(first) else np.empty(0, bool), size), []


def _last(keys: np.ndarray, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Does another chunk hold the window in a document with a smaller doc_id?"""
    size = np.diff(np.r_[first, len(keys)])
    return values > np.repeat(np.minimum.reduceat(values, first) if len(first) else values, size), []


def _question(lengths: list[int], last: bool) -> Callable[[dict], tuple[np.ndarray, np.ndarray]]:
    def question(row: dict) -> tuple[np.ndarray, np.ndarray]:
        c = Chunk(row["data"])
        c.candidates(lengths, unpacked(row["answers"]) if "answers" in row else [])
        return c.keys, c.least if last else (c.most > c.least).astype(np.int64)

    return question


def _levels(chunks: DataFrame, window: int, least: int) -> tuple[list[int], list[DataFrame]]:
    """Window lengths, and what was answered at each."""
    if window < 2:
        raise ValueError("a window has two words at least")
    lengths, told = lengths_up_to(window, least), []
    ranges = ranges_for(chunks, chunks.agg(F.sum("words")).first()[0] or 0)
    for k, _ in enumerate(lengths):
        last = k == len(lengths) - 1
        asking = chunks.select("chunk", "data")
        told.append(_answered(with_answers(asking.hint("merge"), *told) if told else asking, lengths[: k + 1], last, ranges))
    return lengths, told


def _answered(asking: DataFrame, lengths: list[int], last: bool, ranges: int) -> DataFrame:
    return materialise(answer(ask(asking, _question(lengths, last), ranges), _last if last else _early), "windows-told")[0]


def _gone(row: dict, lengths: list[int], window: int) -> tuple[Chunk, np.ndarray]:
    """The chunk, and which of its words go."""
    c, told = Chunk(row["data"]), unpacked(row["answers"])
    c.candidates(lengths, told[:-1])
    edge = np.zeros(len(c.tokens) + 1, np.int64)
    at = c.repeats(told[-1])
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return c, np.cumsum(edge)[:-1] > 0


def _each_chunk(docs: DataFrame, columns: list[str], window: int, least: int, chunk_bytes: int, render: Callable, schema: str | T.StructType) -> DataFrame:
    chunks = _chunks(docs, columns, chunk_bytes)
    lengths, told = _levels(chunks, window, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {name: b.column(name)[k].as_py() for name in ("data", "rows", "answers")}
                c, gone = _gone(row, lengths, window)
                less = np.r_[0, np.cumsum(gone)]
                less = (less[c.starts[1:]] - less[c.starts[:-1]]).tolist()
                yield from render(pa.ipc.open_stream(row["rows"]).read_all().combine_chunks(), c.starts.tolist(), gone, less)
                give_back()

    return arrow_map(with_answers(chunks.select("chunk", "data", "rows").hint("merge"), *told), run, schema)


def _kept(text: str | None, gone: np.ndarray, less: int) -> list[bytes]:
    words = (text or "").encode().split()
    return [w for w, g in zip(words, gone.tolist()) if not g] if less else words


def substring_digests(docs: DataFrame, window: int = 13, least: int = 7, chunk_bytes: int = 3 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row; least: the words of the shortest level, or fewer."""

    def render(t: pa.Table, starts: list[int], gone: np.ndarray, less: list[int]) -> Iterator[pa.RecordBatch]:
        sha = [hashlib.sha256(b" ".join(_kept(x, gone[i:j], n))).hexdigest() for x, i, j, n in zip(t.column("_tm_text").to_pylist(), starts, starts[1:], less)]
        cols = [t.column("_tm_0").combine_chunks(), pa.array(np.diff(starts), pa.int64()), pa.array(less, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return _each_chunk(rows, ["doc_id"], window, least, chunk_bytes, render, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame, window: int = 13, least: int = 7, chunk_bytes: int = 3 << 20) -> DataFrame:
    """docs with the words of repeats taken out of text, and n_chars (if there) as it then is.

    A text that loses words becomes its kept words joined by one space; other texts stay as they are. A
    document that loses all its words goes.
    """
    columns, kinds = docs.columns, [f.dataType for f in docs.schema]
    others = [c for c in columns if c != "text"]

    def render(t: pa.Table, starts: list[int], gone: np.ndarray, less: list[int]) -> Iterator[pa.RecordBatch]:
        texts, keep = t.column("_tm_text").to_pylist(), np.ones(len(t), bool)
        for k in np.flatnonzero(less).tolist():
            kept = _kept(texts[k], gone[starts[k] : starts[k + 1]], less[k])
            texts[k], keep[k] = b" ".join(kept).decode(), bool(kept)
        cols = [pa.array(texts, pa.string()) if c == "text" else t.column(f"_tm_{others.index(c)}").combine_chunks() for c in columns]
        yield from pa.table(dict(zip((f"c{k}" for k in range(len(cols))), cols))).filter(pa.array(keep)).to_batches()

    schema = T.StructType([T.StructField(f"c{k}", T.StringType() if c == "text" else kind) for k, (c, kind) in enumerate(zip(columns, kinds))])
    out = _each_chunk(docs, others, window, least, chunk_bytes, render, schema)
    out = out.select(*[F.col(f"c{k}").cast(kind).alias(c) if c == "text" else F.col(f"c{k}").alias(c) for k, (c, kind) in enumerate(zip(columns, kinds))])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def repeat_levels(docs: DataFrame, window: int = 13, least: int = 7, chunk_bytes: int = 3 << 20) -> DataFrame:
    """(length, doc_id, n): for windows of the given length, then twice and twice again, the number of repeats
    that each document still has. Each level extends what the level before left, until nothing is left."""
    chunks = _chunks(docs.select(docs["doc_id"], docs["text"]), [], chunk_bytes)
    ranges = ranges_for(chunks, chunks.agg(F.sum("words")).first()[0] or 0)
    lengths, told = _levels(chunks, window, least)
    told, out = told[:-1], None
    while True:
        asking = chunks.select("chunk", "data")
        final = _answered(with_answers(asking.hint("merge"), *told) if told else asking, lengths, True, ranges)

        def run(batches: Iterator[pa.RecordBatch], lengths: list[int] = list(lengths)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    c, answers = Chunk(b.column("data")[k].as_py()), unpacked(b.column("answers")[k].as_py())
                    c.candidates(lengths, answers[:-1])
                    doc, n = np.unique(c.doc[c.repeats(answers[-1])], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), lengths[-1]), pa.int32()), pa.array(doc, pa.int64()), pa.array(n, pa.int64())], ["length", "doc_id", "n"])

        level = arrow_map(with_answers(asking.hint("merge"), *told, final), run, "length int, doc_id long, n long").groupBy("length", "doc_id").agg(F.sum("n").alias("n"))
        if level.isEmpty():
            return level if out is None else out
        out = level if out is None else out.unionByName(level)
        told = [*told, _answered(with_answers(asking.hint("merge"), *told) if told else asking, lengths, False, ranges)]
        lengths = [*lengths, 2 * lengths[-1]]
