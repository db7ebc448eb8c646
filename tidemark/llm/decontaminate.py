"""Benchmark decontamination by latent semantic retrieval, then checks in the text.

Words are lower-cased and stripped of punctuation at both ends. The benchmark is worked off in blocks of at
most `block` items and `most_words` distinct words, which are the vocabulary of the block. Items are sparse rows
throughout; a task is sent the block's latent space, most_words x rank numbers of four bytes, and nothing larger.

1. Texts are read once for a block: the vocabulary numbers of all their words are stored, packed, and what follows
   reads these. Document frequencies of the vocabulary over all documents give TF-IDF weights.
2. Latent space: TF-IDF rows of the items and of all passages of all documents are decomposed by a randomised SVD.
   Each task sums the products of the words of its passages, those of the most frequent words in a dense table; the
   sums, at most vocabulary x vocabulary whatever the number of rows, are added by strips of the vocabulary and
   stored, and each round multiplies the strips into the sketch.
3. Search: an item's answer is its telling words: those in at most about the square root of all documents
   (the four of greatest weight at least). Items are searched by classes of length, each with windows of at most
   twice an item's length, so a long item doesn't dilute a short one. A match must hold `answer_share` of an
   answer, so only windows with that many words of any answers of the class are placed in the latent space. Items
   of the class with a cosine of at least `cosine` are candidates.
4. Checks: the longest common subsequence of the item and the passage with its surroundings must have
   `order_share` of the item's words, and the passage `answer_share` of its answer. So copies with changed
   case, punctuation, inserted, left out or replaced words are found, and texts that share common words only
   are not.

Items of fewer than `least_words` words are matched as exact sequences of words instead. Every document is
searched whole. Edge cases: a null text has no passage; items without words match nothing; equal items are one item each; a null doc_id is
searched like others; an empty table or benchmark finds nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, drop, materialise, text_chunks
from tidemark.llm.words import Words, pack, unpack

_EDGES = string.punctuation + "“”‘’«»„…–—¿¡"
WINDOW, LEAST_WINDOW = 48, 12
#: Words whose products a task sums in a dense table, products of other words that it holds, the most numbers of a
#: strip, and the fewest strips.
DENSE, HELD, STRIP, STRIPS = 2048, 1 << 22, 1 << 23, 64


def plain(word: str) -> str:
    return word.strip(_EDGES).lower()


@dataclass
class Items:
    """A block of benchmark items over their own vocabulary."""

    ids: list[int]
    words: list[list[int]]
    vocabulary: dict[str, int]
    idf: np.ndarray = field(default_factory=lambda: np.empty(0))
    answers: list[set[int]] = field(default_factory=list)
    placed: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))  # a row of the latent space for each word, weighed
    latent: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))  # unit rows of the items
    short: list[tuple[int, list[int]]] = field(default_factory=list)

    @staticmethod
    def of(rows: list[tuple[int, str | None]], least_words: int) -> Items:
        vocabulary: dict[str, int] = {}
        ids, words, short = [], [], []
        for i, text in rows:
            own = [w for w in map(plain, (text or "").split()) if w]
            if len(own) >= least_words:
                ids.append(i)
                words.append([vocabulary.setdefault(w, len(vocabulary)) for w in own])
            elif own:
                short.append((i, [vocabulary.setdefault(w, len(vocabulary)) for w in own]))
        return Items(ids, words, vocabulary, short=short)

    def classes(self) -> dict[int, list[int]]:
        """Items by the width of their windows, which is at least an item's length and doubles from class to class."""
        out: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            out.setdefault(LEAST_WINDOW << max(0, (-(-len(w) // LEAST_WINDOW) - 1).bit_length()), []).append(k)
        return dict(sorted(out.items()))

    def weigh(self, frequency: np.ndarray, documents: int, least: int = 4) -> None:
        self.idf = np.log((documents + 1) / (frequency + 1)) + 0.01
        for w in self.words:
            ranked = sorted(set(w), key=lambda x: (-self.idf[x], x))
            self.answers.append({x for k, x in enumerate(ranked) if k < least or self.idf[x] >= 0.5 * np.log(documents + 1)})

    def sparse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit TF-IDF rows of the items as (row, word, weight), in order of the rows."""
        own = [np.unique(w, return_counts=True) for w in self.words]
        row = np.repeat(np.arange(len(own)), [len(w) for w, _ in own])
        word = np.concatenate([w for w, _ in own])
        weight = np.concatenate([n for _, n in own]) * self.idf[word]
        return row, word, weight / np.maximum(np.sqrt(np.bincount(row, weight * weight)), 1e-12)[row]

    def place(self, basis: np.ndarray) -> None:
        self.placed = (self.idf[:, None] * basis).astype(np.float32)
        self.latent = np.stack([_unit(self.placed[w].sum(0, dtype=np.float64)) for w in self.words]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _coded(texts: pa.ChunkedArray, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): vocabulary numbers of the words of each text, -1 for others, -2 for bare punctuation."""
    w = Words(texts)
    number = np.array([vocabulary.get(x, -1 if x else -2) for x in map(plain, w.words.to_pylist())], np.int64)
    return (number[w.codes] if len(w.codes) else w.codes), w.starts


def code_texts(rows: DataFrame, items: Items) -> tuple[DataFrame, str]:
    """A row for each chunk of texts: ids, whether they are null, digests of the texts, and codes and starts of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_chunks(batches):
            codes, starts = _coded(t.column("text"), items.vocabulary)
            ids = t.column("doc_id").combine_chunks()
            md5 = np.frombuffer(b"".join([hashlib.md5((x or "").encode()).digest() for x in t.column("text").to_pylist()]), "V16")
            data = pack(ids=ids.fill_null(0).to_numpy(), none=ids.is_null().to_numpy(zero_copy_only=False), md5=md5, codes=codes.astype(np.int32), starts=starts)
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

    return materialise(arrow_map(rows.select("doc_id", "text"), run, "data binary"), "coded")


def _chunks(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[dict[str, np.ndarray]]:
    """Coded chunks, from rows of code_texts or from texts."""
    if "data" in (first := next(batches, pa.RecordBatch.from_pylist([], pa.schema([("data", pa.binary())])))).schema.names:
        for b in chain([first], batches):
            for data in b.column("data"):
                yield unpack(data.as_py())
    else:
        for t in text_chunks(chain([first], batches)):
            yield dict(zip(("codes", "starts"), _coded(t.column("text"), items.vocabulary)))


def _frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """How many documents hold each word of the vocabulary, and how many there are; docs are texts or coded chunks."""
    size = len(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for t in _chunks(batches, items):
            codes, starts = t["codes"], t["starts"]
            doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            known = np.flatnonzero(codes >= 0)
            total += np.bincount(np.unique(doc[known] * size + codes[known]) % size, minlength=size)
            n += len(starts) - 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, held]), pa.array(np.r_[n, total[held]])], ["word", "n"])

    out = np.zeros(size, np.int64)
    documents = 0
    for r in arrow_map(docs, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row for each word of the block
        if r["word"] < 0:
            documents = r["n"]
        else:
            out[r["word"]] = r["n"]
    return out, documents


def _tfidf(codes: np.ndarray, starts: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows of the passages of texts as (row, word, weight)."""
    n = np.diff(starts)
    place = np.arange(len(codes)) - np.repeat(starts[:-1], n)
    passage = np.repeat(np.cumsum(-(-n // WINDOW)) - -(-n // WINDOW), n) + place // WINDOW
    known = np.flatnonzero(codes >= 0)
    size = len(items.vocabulary)
    pair, count = np.unique(passage[known] * size + codes[known], return_counts=True)
    row, word = pair // size, pair % size
    weight = count * items.idf[word]
    norm = np.sqrt(np.bincount(row, weight * weight))
    return row, word, weight / np.maximum(norm[row], 1e-12)


def _add_products(total: np.ndarray, x: np.ndarray, row: np.ndarray, word: np.ndarray, weight: np.ndarray, some: int = 16_000) -> None:
    """Add A'A x to total for sparse rows A, some entries at a time; entries are sorted by row."""
    at = 0
    while at < len(row):
        end = len(row) if at + some >= len(row) else int(np.searchsorted(row, row[at + some], side="left"))
        end = end if end > at else int(np.searchsorted(row, row[at], side="right"))
        r, w, v = row[at:end], word[at:end], weight[at:end, None]
        new = np.r_[True, r[1:] != r[:-1]]
        v = v.astype(x.dtype)
        y = np.add.reduceat(v * x[w], np.flatnonzero(new))[np.cumsum(new) - 1] * v
        order = np.argsort(w, kind="stable")
        first = np.flatnonzero(np.r_[True, w[order][1:] != w[order][:-1]])
        total[w[order][first]] += np.add.reduceat(y[order], first)
        at = end


def _pairs(row: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (a, b) of entries of one row, which are sorted by row: all of them with a <= b, or each of own with all of its row."""
    end = np.searchsorted(row, row, side="right")
    a = np.arange(len(row)) if own is None else own
    low = a if own is None else np.searchsorted(row, row[own])
    n = end[a] - low
    return np.repeat(a, n), np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(value[order], first) if len(key) else value


def word_products(coded: DataFrame, items: Items, dense: int = DENSE, held: int = HELD, strip: int = STRIP, strips: int = STRIPS) -> tuple[DataFrame, str, int]:
    """(rows, path, words of a strip): A'A of the TF-IDF rows A of all passages, a row (part, data) for each strip of it."""
    size = len(items.vocabulary)
    words = max(1, min(strip // size, -(-size // strips)))  # of a strip
    often = np.sort(np.argsort(items.idf, kind="stable")[:dense])  # the most frequent words weigh least
    slot = np.full(size, -1)
    slot[often] = np.arange(len(often))

    def cut(key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = key // (words * size)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, b in zip(first, np.r_[first[1:], len(part)].astype(int)):
            data = pack(key=key[a:b] - part[a] * words * size, value=value[a:b].astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(often)
        total = np.zeros(k * k)
        rest: list[tuple[np.ndarray, np.ndarray]] = []

        def rare(key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Products of a rare word and another one; a frequent one has none with it yet."""
            turn = slot[key % size] >= 0
            key = np.r_[key, key[turn] % size * size + key[turn] // size]
            order = np.argsort(key)
            return cut(key[order], np.r_[value, value[turn]][order])

        for t in _chunks(batches, items):
            rows, words, weights = _tfidf(t["codes"].astype(np.int64), t["starts"], items)
            ends = np.r_[np.searchsorted(rows, np.arange(0, rows[-1] + 1, 1000)), len(rows)] if len(rows) else []
            for lo, hi in zip(ends[:-1], ends[1:]):  # a thousand passages
                row, word, weight = rows[lo:hi], words[lo:hi], weights[lo:hi]
                place = slot[word]
                some = place >= 0
                at, value = place[some], weight[some]
                a, b = _pairs(row[some])
                np.add.at(total, (at * k)[a] + at[b], value[a] * value[b])
                a, b = _pairs(row, np.flatnonzero(~some))
                rest.append(_sums(word[a] * size + word[b], weight[a] * weight[b]))
                if sum(len(key) for key, _ in rest) > held:
                    rest = [_sums(*map(np.concatenate, zip(*rest)))]
                    if 2 * len(rest[0][0]) > held:
                        yield from rare(*rest.pop())
        total = total.reshape(k, k)
        for lo in range(0, k, 256):  # the half below the diagonal is that above it
            own = total[lo : lo + 256]
            own[:, :lo] = total[:lo, lo : lo + 256].T
            own[:, lo : lo + 256] += np.triu(own[:, lo : lo + 256], 1).T
            x, y = np.nonzero(own)
            yield from cut(often[lo + x] * size + often[y], own[x, y])
        if rest:
            yield from rare(*_sums(*map(np.concatenate, zip(*rest))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            key = np.flatnonzero(total)
            data = pack(key=key, value=total[key].astype(np.float32))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])

        now, total = None, np.zeros(words * size)
        for b in batches:  # strip by strip
            for part, data in zip(b.column("part").to_pylist(), b.column("data")):
                if part != now:
                    if now is not None:
                        yield told()
                        total[:] = 0
                    now = part
                some = unpack(data.as_py())
                total[some["key"]] += some["value"]
        if now is not None:
            yield told()

    schema = "part int, data binary"
    sums = arrow_map(coded, multiply, schema).repartition(-(-size // words), "part").sortWithinPartitions("part")
    return *materialise(arrow_map(sums, add, schema), "word-products"), words


def fit_basis(products: DataFrame, words: int, items: Items, rank: int, rounds: int = 2) -> np.ndarray:
    """vocabulary x rank: leading right singular vectors of the TF-IDF rows of items and of all passages, whose products
    come by strips of so many words."""
    size = len(items.vocabulary)
    own = items.sparse()

    def times(x: np.ndarray) -> np.ndarray:
        """A'A x, strip by strip."""
        x = x.astype(np.float32)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, data in zip(b.column("part").to_pylist(), b.column("data")):
                    some = unpack(data.as_py())
                    strip = np.zeros((min(words, size - part * words), size), np.float32)
                    strip.reshape(-1)[some["key"]] = some["value"]
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([(strip @ x).tobytes()], pa.binary())], ["part", "data"])

        out = np.zeros((size, x.shape[1]))
        _add_products(out, x.astype(np.float64), *own)
        for r in arrow_map(products, multiply, "part int, data binary").toLocalIterator():  # vocabulary x rank numbers
            out[r["part"] * words : (r["part"] + 1) * words] += np.frombuffer(r["data"], np.float32).reshape(-1, x.shape[1])
        return out

    rank = min(rank, size)
    q = np.linalg.qr(np.random.default_rng(42).standard_normal((size, rank)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(times(q))[0]
    return q


def common_length(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, by one machine word operation a word of text."""
    where: dict[int, int] = {}
    for k, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


def _exact(codes: np.ndarray, starts: np.ndarray, short: list[tuple[int, list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(text, number in short, word) of the first place of each short item in each text."""
    at = np.flatnonzero(codes != -2)
    told = codes[at]
    doc = np.searchsorted(starts, at, side="right") - 1
    for n in sorted({len(w) for _, w in short}):
        own: dict[tuple[int, ...], list[int]] = {}
        for number, (_, w) in enumerate(short):
            if len(w) == n:
                own.setdefault(tuple(w), []).append(number)
        first = np.flatnonzero(np.isin(told[: max(len(told) - n + 1, 0)], [w[0] for w in own]))
        for k, part in enumerate(np.array(list(own)).T):
            first = first[np.isin(told[first + k], part)]
        first = first[doc[first] == doc[first + n - 1]]
        seen = set()
        for i in first.tolist():
            for number in own.get(tuple(told[i : i + n].tolist()), ()):
                if (doc[i], number) not in seen:
                    seen.add((doc[i], number))
                    yield int(doc[i]), number, int(at[i] - starts[doc[i]])


def _search(batches: Iterator[pa.RecordBatch], items: Items, cosine: float, order_share: float, answer_share: float) -> Iterator[pa.RecordBatch]:
    size = len(items.vocabulary)
    classes = []
    for width, own in items.classes().items():
        telling = np.zeros(size + 2, bool)
        telling[[w for k in own for w in items.answers[k]]] = True
        classes.append((width, np.array(own), telling, min(int(np.ceil(answer_share * len(items.answers[k]))) for k in own)))
    ids = [*items.ids, *(i for i, _ in items.short)]
    for t in _chunks(batches, items):
        codes, starts = t["codes"].astype(np.int64), t["starts"]
        found: dict[tuple[int, int], tuple] = {}
        n = np.diff(starts)
        for window, members, telling, least in classes:
            # windows with enough telling words, three to a width
            stride = window // 3
            steps = np.maximum(1, -(-(n - window) // stride) + 1)
            doc = np.repeat(np.arange(len(n)), steps)
            begin = starts[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(steps) - steps, steps)) * stride
            end = np.minimum(begin + window, starts[doc + 1])
            told = np.r_[0, np.cumsum(telling[codes])]
            likely = np.flatnonzero(told[end] - told[begin] >= least)
            for at in range(0, len(likely), 512):
                some = likely[at : at + 512]
                x = np.zeros((len(some), items.placed.shape[1]), np.float32)
                for k, (a, b) in enumerate(zip(begin[some].tolist(), end[some].tolist())):
                    own = codes[a:b]
                    x[k] = items.placed[own[own >= 0]].sum(0, dtype=np.float64)
                near = _unit(x) @ items.latent[members].T
                for k, member in zip(*(y.tolist() for y in np.nonzero(near >= cosine))):
                    item = int(members[member])
                    d, a, b = int(doc[some[k]]), int(begin[some[k]]), int(end[some[k]])
                    extra = len(items.words[item])
                    a, b = max(int(starts[d]), a - extra), min(int(starts[d + 1]), b + extra)
                    text = codes[a:b].tolist()
                    share = len(items.answers[item] & set(text)) / len(items.answers[item])
                    if share < answer_share:
                        continue
                    order = common_length(items.words[item], text) / extra
                    if order >= order_share and (order, share, float(near[k, member])) > found.get((d, item), (0,))[:3]:
                        found[d, item] = (order, share, float(near[k, member]), a - int(starts[d]))
        for d, number, place in _exact(codes, starts, items.short):
            found[d, len(items.ids) + number] = (1.0, 1.0, 1.0, place)
        if found:
            at = [d for d, _ in found]
            cols = [pa.array(t["ids"][at], mask=t["none"][at]), pa.array([ids[i] for _, i in found], pa.int64())]
            cols += [pa.array([v[k] for v in found.values()], kind) for k, kind in enumerate((pa.float64(), pa.float64(), pa.float64(), pa.int64()))]
            cols.append(pa.array([t["md5"][d].tobytes().hex() for d in at]))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "order_share", "answer_share", "cosine", "word", "text_md5"])


def _blocks(benchmark: DataFrame, block: int, most_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of so many, and of so many distinct words together, which bounds what a block sends; an item
    with more of them stands alone."""
    held: list[tuple[int, str]] = []
    known: set[str] = set()
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        words = set(map(plain, (r[1] or "").split()))
        if held and (len(held) >= block or len(known) + len(words - known) > most_words):
            yield held
            held, known = [], set()
        held.append((r[0], r[1]))
        known |= words
    if held:
        yield held


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, block: int = 4096, most_words: int = 32_768, rank: int = 320, cosine: float = 0.25, order_share: float = 0.5, answer_share: float = 0.5, least_words: int = 6
) -> DataFrame:
    """(doc_id, item_id, order_share, answer_share, cosine, word, text_md5) of the benchmark items found in documents.

    The texts are read once for a block of items; most_words bounds its distinct words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, order_share double, answer_share double, cosine double, word long, text_md5 string"
    spark, out = docs.sparkSession, None
    for part in _blocks(benchmark, block, most_words):
        items = Items.of(part, least_words)
        if not items.ids and not items.short:
            continue
        coded, path = code_texts(rows, items)
        made = [path]
        if items.ids:
            items.weigh(*_frequencies(coded, items))
            products, path, words = word_products(coded, items)
            made.append(path)
            items.place(fit_basis(products, words, items, rank))
        sent = spark.sparkContext.broadcast(items)  # bounded by block and most_words
        found, _ = materialise(arrow_map(coded, lambda b, sent=sent: _search(b, sent.value, cosine, order_share, answer_share), schema), "found")
        sent.unpersist()
        for path in made:
            drop(spark, path)
        out = found if out is None else out.unionByName(found)
    return _none(spark, schema) if out is None else out


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, n_items, item_id, order_share) of every row; item_id is the best match.

    Rows that repeat a doc_id are told contaminated together.
    """
    best = F.max_by("item_id", F.struct("order_share", "answer_share", "cosine", -F.col("item_id")))
    found = leaks(docs, benchmark, **options).groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), best.alias("item_id"), F.max("order_share").alias("order_share"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    joined = rows.join(found.withColumnRenamed("doc_id", "_tm_doc"), F.col("doc_id").eqNullSafe(F.col("_tm_doc")), "left")
    return joined.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id", F.coalesce("order_share", F.lit(0.0)).alias("order_share"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows in which no item is found, with the columns of docs. Each row is judged by its own text."""
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_tm_doc"), F.col("text_md5").alias("_tm_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_tm_doc"]) & (F.md5(docs["text"].cast("string")) == bad["_tm_text"])
    return docs.join(bad, same, "left_anti")
