"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text falls into one of a few bins, and a lookup table says what that bin adds to the score;
a few pairs of features have tables of their own. The tables come from cyclic boosting: in every round each
feature in turn gets a shallow tree (two cuts) on the present gradients, added to its table with a small
rate; then the pairs with the best single cut pair are boosted the same way. A held-back part of the learning
rows says when to stop. A score is the logistic function of the sum, computed by adding table entries of
whole columns at once.

Features see the text alone (TEXT_FEATURES). The model is fitted on at most `sample` labelled rows, those with
the smallest hash of doc_id; features and scores cover every row.

Edge cases: a null or empty text has all features zero and a score like any other; labels without a document,
or with a null quality, teach nothing; documents that repeat a doc_id teach once for each label value; with
no usable labels every score is 0.5, with one class only the (smoothed) share of it; a null doc_id counts as
held out; a very long text is read whole, in a chunk of its own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_map, text_chunks

TEXT_FEATURES = (
    "log_words", "word_length", "distinct_words", "top_word", "same_as_before", "distinct_pairs", "short_words", "long_words", "no_letter_words", "end_marks",
    "letters", "capitals", "digits", "symbols", "marks", "other_bytes", "entropy", "log_line_length", "same_lines", "capital_words",
)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?'\"-()"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_features(text: str | None) -> list[float]:
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(TEXT_FEATURES)
    n, counts = len(words), Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    same = sum(a == b for a, b in zip(words, words[1:]))
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    full = bytes_ * ~_SPACE
    solid = int(full.sum())
    letters = int(full[_LETTER].sum())
    upper, ascii_letters = int(full[65:91].sum()), int(full[65:91].sum() + full[97:123].sum())
    share = full[full > 0] / solid
    lines = [x for x in data.split(b"\n") if x.strip()]
    has_letter = sum(not w.isalpha() and not any(_LETTER[c] for c in w) for w in counts)
    return [
        math.log1p(n),
        float(sizes.mean()),
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        same / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        float((sizes <= 3).mean()),
        float((sizes >= 12).mean()),
        has_letter / len(counts),
        sum(w[-1] in b".!?" for w in words) / n,
        letters / solid,
        upper / max(1, ascii_letters),
        int(full[48:58].sum()) / solid,
        (solid - letters - int(full[48:58].sum()) - int(full[_MARKS].sum())) / solid,
        int(full[_MARKS].sum()) / solid,
        int(full[128:].sum()) / solid,
        float(-(share * np.log2(share)).sum()),
        math.log1p(len(data) / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(w[:1].isupper() for w in words) / n,
    ]


def _features(t: pa.Table) -> np.ndarray:
    """A row of features for each text."""
    return np.array([text_features(x) for x in t.column("text").to_pylist()], float).reshape(-1, len(TEXT_FEATURES))


@dataclass
class Model:
    """start + tables[j][bin of feature j] + pair tables, before the logistic function."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.start)
        for j, table in enumerate(self.tables):
            total += table[b[j]]
        for j, k, table in self.pairs:
            total += table[b[j], b[k]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, cuts: int = 2) -> np.ndarray:
    """Step function over bins with so many cuts, each the best at its time; g and h are sums by bin."""
    edges = [0, len(g)]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    for _ in range(cuts):
        best, where = 1e-9, None
        for a, b in zip(edges, edges[1:]):
            m = np.arange(a + 1, b)
            if len(m):
                gl, hl, gr, hr = cg[m] - cg[a], ch[m] - ch[a], cg[b] - cg[m], ch[b] - ch[m]
                gain = np.where((hl > 1) & (hr > 1), _gain(gl, hl) + _gain(gr, hr) - _gain(cg[b] - cg[a], ch[b] - ch[a]), 0)
                if gain.max() > best:
                    best, where = float(gain.max()), int(m[gain.argmax()])
        if where is None:
            break
        edges = sorted([*edges, where])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both features of a pair: its gain and the four leaves over the bins."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = np.meshgrid(np.arange(g.shape[0] - 1), np.arange(g.shape[1] - 1), indexing="ij")
    if not a.size:
        return 0.0, np.zeros(g.shape)
    total, gain = 0.0, 0.0
    parts = []
    for c in (cg, ch):
        low, left, top = c[a, b], c[a, -1], c[-1, b]
        parts.append([low, left - low, top - low, c[-1, -1] - left - top + low])
    for x, y in zip(*parts):
        gain = gain + _gain(x, y)
        total = total + np.where(y > 1, 0, 1)
    gain = np.where(total == 0, gain - _gain(cg[-1, -1], ch[-1, -1]), 0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    table = np.zeros(g.shape)
    for rows, x in ((slice(0, i + 1), 0), (slice(i + 1, None), 2)):
        for cols, y in ((slice(0, j + 1), 0), (slice(j + 1, None), 1)):
            k = {(0, 0): 0, (0, 1): 1, (2, 0): 2, (2, 1): 3}[x, y]
            table[rows, cols] = _leaf(parts[0][k][i, j], parts[1][k][i, j])
    return float(gain.max()), table


def fit(x: np.ndarray, y: np.ndarray, most_bins: int = 48, rounds: int = 200, rate: float = 0.1, n_pairs: int = 6) -> Model:
    if not len(y):
        return Model(0.0, [np.empty(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [])
    mean = (y.sum() + 0.5) / (len(y) + 1)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, most_bins + 1)[1:-1], method="nearest")) for c in x.T]
    model = Model(float(np.log(mean / (1 - mean))), edges, [np.zeros(len(e) + 1) for e in edges], [])
    if y.min() == y.max():
        return model
    b = model.bins(x)
    check = np.arange(len(y)) % 7 == 3  # held back to say when to stop
    learn = ~check
    total = np.full(len(y), model.start)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return (y - p) * learn, p * (1 - p) * learn

    def loss() -> float:
        return float(np.logaddexp(0, np.where(y > 0, -total, total))[check].mean()) if check.any() else 0.0

    def boost(step, state: list, most: int) -> None:
        """Rounds of step until the held-back loss has not fallen for a while; the best state stays."""
        nonlocal total
        best, kept, since = loss(), ([t.copy() for t in state], total.copy()), 0
        for _ in range(most):
            step()
            now = loss()
            if now < best - 1e-6:
                best, kept, since = now, ([t.copy() for t in state], total.copy()), 0
            else:
                since += 1
            if since >= 15:
                break
        state[:], total = kept

    def singles() -> None:
        nonlocal total
        for j, bins in enumerate(b):
            g, h = gradients()
            size = len(edges[j]) + 1
            add = rate * _tree(np.bincount(bins, g, size), np.bincount(bins, h, size))
            model.tables[j] += add
            total = total + add[bins]

    boost(singles, model.tables, rounds)

    def sums(j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = gradients()
        shape = (len(edges[j]) + 1, len(edges[k]) + 1)
        at = b[j] * shape[1] + b[k]
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    gains = sorted(((_quarters(*sums(j, k))[0], j, k) for j in range(len(b)) for k in range(j)), reverse=True)
    chosen = [(j, k) for _, j, k in gains[:n_pairs]]
    tables = [np.zeros((len(edges[j]) + 1, len(edges[k]) + 1)) for j, k in chosen]

    def doubles() -> None:
        nonlocal total
        for t, (j, k) in zip(tables, chosen):
            add = rate * _quarters(*sums(j, k))[1]
            t += add
            total = total + add[b[j], b[k]]

    boost(doubles, tables, rounds // 2)
    model.pairs = [(j, k, t) for (j, k), t in zip(chosen, tables)]
    return model


def _held_out(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))) % folds == 0


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = 20_000) -> Model:
    """Fit on labels whose crc32(doc_id as text) mod folds is not 0."""
    ids = F.col("doc_id").cast("long")
    marked = labels.select(ids.alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").distinct()
    marked = marked.where(~_held_out(F.col("doc_id"), folds)).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_chunks(batches):
            x = pa.array(list(_features(t)), pa.list_(pa.float64()))
            yield from t.select(["doc_id", "quality"]).append_column("x", x).combine_chunks().to_batches()

    texts = docs.select(ids.alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marked), "doc_id").select("doc_id", "quality", "text")
    rows = arrow_map(texts, run, "doc_id long, quality int, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect()  # `sample` rows at most
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(TEXT_FEATURES))
    return fit(x, np.array([r["quality"] > 0 for r in rows], float))


def score_texts(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted; all other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_chunks(batches):
            score = model.score(_features(t))
            yield from t.append_column("score", pa.array(score)).append_column("predicted", pa.array((score >= threshold).astype(np.int32))).combine_chunks().to_batches()

    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*columns).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return arrow_map(docs.select(*columns), run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = fit_quality(docs, labels, folds)
    scored = score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, threshold)
    return scored.select("doc_id", _held_out(F.col("doc_id"), folds).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """Rows whose text scores at least the threshold, with the columns of docs."""
    model = fit_quality(docs, labels, folds)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_chunks(batches):
            yield from t.filter(pa.array(model.score(_features(t)) >= threshold)).to_batches()

    return arrow_map(docs, run, schema)
