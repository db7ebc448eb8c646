"""Hard negatives by ball trees: bounds of inner products from both sides decide what is looked at.

Each component x becomes the integer floor(scale * x); a row's score for an anchor is the integer inner product, higher
ones first, ties by the smaller id. An anchor's positives are its best other rows of the same label; for each positive,
the negatives are the best rows of another label whose score lies in a window of the positive's.

1. Rows are dealt by ranges of (length, label, id) into blocks of about BLOCK rows, so a label of any size is split and
   small labels share a block. A task builds its block's trees, one for each length of vectors, and writes them as a row.
2. Anchors go to the blocks that hold their label, and each block answers with its best few; the best of all blocks
   are the positives.
3. Anchors go, with the windows of their positives, to all blocks, and the best of all answers are the negatives.

A node of a tree is a ball with centre c and radius r around its rows, so the score of a row in it lies within |q| r of
q . c. A node is left out if all its scores lie below or above the window, or strictly below the k-th best found so
far, or if its labels can't fit. A block's anchors go down its tree together, each node a matrix product.

Edge cases: a row without id, label or vector, or with a component that is null or not finite takes no part, nor does
one whose integers have a squared length of 2**53 or more, as its scores would not be exact; vectors of different
lengths are never compared; an empty vector scores 0 with the other empty ones; of rows that repeat an id that with the
smallest label and vector takes part; ties and equal vectors are told apart by ids; an anchor without positives or
without rows in a window has no result rows; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, give_back, materialise
from tidemark.llm.words import pack, unpack

BLOCK, LEAF, ASKED = 32_768, 64, 2_048
_NONE = np.iinfo(np.int64).max


class BallTree:
    """Rows in the order of the leaves; node k has rows start[k] to end[k], child[k] and child[k] + 1 (0: a leaf)."""

    FIELDS = ("x", "ids", "labels", "start", "end", "child", "centre", "radius", "low", "high")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.arange(len(x))
        spans, child, k = [(0, len(x))], [], 0
        while k < len(spans):
            s, e = spans[k]
            child.append(0)
            if e - s > leaf:
                part = x[order[s:e]]
                widest = int(np.argmax(part.var(0))) if x.shape[1] else 0
                middle = (e - s) // 2
                cut = np.argpartition(part[:, widest], middle) if x.shape[1] else np.arange(e - s)
                order[s:e] = order[s:e][cut]
                child[k] = len(spans)
                spans += [(s, s + middle), (s + middle, e)]
            k += 1
        x, ids, labels = x[order], ids[order], labels[order]
        centre = np.array([x[s:e].mean(0) for s, e in spans])
        radius = np.array([np.sqrt(((x[s:e] - c) ** 2).sum(1).max()) for (s, e), c in zip(spans, centre)])
        low, high = (np.array([f(labels[s:e]) for s, e in spans]) for f in (np.min, np.max))
        start, end = np.array(spans).T
        return cls(x=x, ids=ids, labels=labels, start=start, end=end, child=np.array(child), centre=centre, radius=radius, low=low, high=high)

    def pack(self) -> bytes:
        flat = {name: getattr(self, name) for name in self.FIELDS}
        return pack(**flat | {"x": self.x.astype(np.int32).ravel(), "centre": self.centre.ravel(), "size": np.array([self.x.shape[1]])})

    @classmethod
    def unpack(cls, data: bytes) -> BallTree:
        a = unpack(data)
        d = int(a.pop("size")[0])
        return cls(**a | {"x": a["x"].astype(float).reshape(len(a["ids"]), d), "centre": a["centre"].reshape(len(a["start"]), d)})

    def best(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids of the k best rows of each query with a score in [low, high], of its own label or of the others;
        unfilled places have a score of minus infinity. Also how many rows were scored."""
        scores, ids, seen = np.full((len(q), k), -np.inf), np.full((len(q), k), _NONE), 0
        norm = np.sqrt((q * q).sum(1))
        reach_of = np.sqrt((self.centre**2).sum(1)) + self.radius
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, now = stack.pop()
            if same:
                fits = (self.low[node] <= label[now]) & (label[now] <= self.high[node])
            else:
                fits = ~((self.low[node] == label[now]) & (label[now] == self.high[node]))
            now = now[fits]
            middle = q[now] @ self.centre[node]
            reach = norm[now] * (self.radius[node] + 1e-9 * reach_of[node]) + 1e-6  # a little more than rounding can take
            near = (middle + reach >= np.maximum(low[now], scores[now, -1])) & (middle - reach <= high[now])
            now = now[near]
            if not len(now):
                continue
            if self.child[node]:
                a, b = self.child[node], self.child[node] + 1
                first = a if (q[now] @ (self.centre[a] - self.centre[b])).mean() >= 0 else b
                stack += [(a + b - first, now), (first, now)]
                continue
            s, e = self.start[node], self.end[node]
            found = q[now] @ self.x[s:e].T  # whole numbers below 2**53: exact in any order
            seen += found.size
            fits = (self.labels[s:e] == label[now, None]) == same
            fits &= (found >= low[now, None]) & (found <= high[now, None]) & (self.ids[s:e] != own[now, None])
            both = np.concatenate([scores[now], np.where(fits, found, -np.inf)], 1)
            named = np.concatenate([ids[now], np.where(fits, self.ids[s:e], _NONE)], 1)
            top = np.lexsort((named, -both), axis=1)[:, :k]
            scores[now], ids[now] = np.take_along_axis(both, top, 1), np.take_along_axis(named, top, 1)
        return scores, ids, seen


def integer_rows(rows: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, q) of the rows that take part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    plain = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fine = plain.where("id is not null and label is not null and x is not null").where(fine)
    fine = fine.select("id", "label", F.transform("x", lambda v: F.floor(F.greatest(F.least(v, F.lit(1e15)), F.lit(-1e15)) * scale).cast("double")).alias("x"))
    fine = fine.where(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v) < float(1 << 53))
    whole = fine.select("id", "label", F.transform("x", lambda v: v.cast("int")).alias("q"))
    twice = whole.groupBy("id").count().where("count > 1").limit(1)
    if twice.count():
        whole = whole.groupBy("id").agg(F.min(F.struct("label", "q")).alias("s")).select("id", "s.label", "s.q")
    return whole


def _vectors(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all components one after the other, length of each row)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(float), np.diff(offsets)


def build_trees(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, length, labels, tree) of blocks of about so many rows of (id, label, q)."""
    parts = max(1, -(-rows.count() // block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a partition is a block
        if not held:
            return
        t = pa.Table.from_batches(held)
        del held
        number, length = t.column("block").to_numpy(), t.column("length").to_numpy()
        for one in np.unique(number):
            for d in np.unique(length[number == one]):
                part = t.filter(pa.array((number == one) & (length == d)))
                labels = part.column("label").to_numpy()
                tree = BallTree.build(_vectors(part.column("q"))[0].reshape(part.num_rows, d), part.column("id").to_numpy(), labels)
                yield pa.RecordBatch.from_arrays([pa.array([int(one)], pa.int32()), pa.array([int(d)], pa.int32()), pa.array([np.unique(labels)], pa.list_(pa.int64())), pa.array([tree.pack()], pa.binary())], ["block", "length", "labels", "tree"])
        give_back()

    dealt = rows.withColumn("length", F.size("q")).repartitionByRange(parts, "length", "label", "id").withColumn("block", F.spark_partition_id())
    return arrow_map(dealt, run, "block int, length int, labels array<long>, tree binary")


def ask_trees(trees: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, positive, positive_score, id, score): the k best rows of each block for each window of (block, length,
    id, label, q, windows); a block's tree comes first, its anchors follow in pieces."""
    window = "array<struct<positive:long,score:long,low:long,high:long>>"
    asked = asked.select("block", "length", "id", "label", "q", F.col("windows").cast(window).alias("windows"))
    both = trees.select("block", "length", "tree").unionByName(asked, allowMissingColumns=True)

    def answers(tree: BallTree, part: pa.RecordBatch) -> pa.RecordBatch | None:
        windows = part.column("windows")
        each = np.diff(windows.offsets.to_numpy())
        w = windows.flatten()
        low, high, positive, score = (w.field(n).to_numpy(zero_copy_only=False) for n in ("low", "high", "positive", "score"))
        at = np.repeat(np.arange(part.num_rows), each)
        q = _vectors(part.column("q"))[0].reshape(part.num_rows, tree.x.shape[1])
        own, label = part.column("id").to_numpy(), part.column("label").to_numpy()
        found, ids, _ = tree.best(q[at], own[at], label[at], same, low.astype(float), high.astype(float), k)
        row, place = np.nonzero(np.isfinite(found))
        cols = (own[at[row]], positive[row], score[row], ids[row, place], found[row, place].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor", "positive", "positive_score", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = None, None
        for b in batches:
            where = np.flatnonzero(b.column("tree").is_valid().to_numpy(zero_copy_only=False))
            cuts = [0, *where.tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if s in where and e > s:
                    tree = BallTree.unpack(b.column("tree")[s].as_py())
                    of = (b.column("block")[s].as_py(), b.column("length")[s].as_py())
                    s += 1
                while s < e:
                    part = b.slice(s, min(ASKED, e - s))
                    s += part.num_rows
                    mine = (part.column("block").to_numpy() == (of or (-1,))[0]) & (part.column("length").to_numpy() == (of or (-1, -1))[1])
                    part = part.filter(pa.array(mine))  # a block may hold no vectors of that length
                    if part.num_rows:
                        yield answers(tree, part)
        give_back()

    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, "block", "length").sortWithinPartitions("block", "length", F.col("tree").isNull())
    return arrow_map(dealt, run, "anchor long, positive long, positive_score long, id long, score long")


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _hundredth(x: Column) -> Column:
    """floor(x / 100) of whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (id, label, q), for those
    that `anchor` tells; a negative's score lies between `least` and `most` hundredths of the positive's."""
    rows, _ = materialise(rows, "integer-rows")
    trees, _ = materialise(build_trees(rows, block), "ball-trees")
    anchors = rows.where(anchor).withColumn("length", F.size("q"))
    bound = 1 << 53
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("positive"), F.lit(0).cast("long").alias("score"), F.lit(-bound).alias("low"), F.lit(bound).alias("high")))
    homes = trees.select("block", "length", F.explode("labels").alias("label"))
    found = ask_trees(trees, anchors.join(homes, ["length", "label"]).withColumn("windows", whole), True, positives)
    best, _ = materialise(_best(found, ["anchor"], positives).select("anchor", F.col("id").alias("positive"), "score"), "positives")
    score = F.col("score")
    # least * p <= 100 * n <= most * p in whole numbers: n from the ceiling of the one to the floor of the other
    low, high = -_hundredth(-score * least), _hundredth(score * most)
    windows = best.select("anchor", F.struct("positive", "score", low.alias("low"), high.alias("high")).alias("w")).where("w.low <= w.high")
    windows = windows.groupBy(F.col("anchor").alias("id")).agg(F.array_sort(F.collect_list("w")).alias("windows"))  # a few of each anchor
    last = trees.agg(F.max("block")).first()[0] or 0
    asked = anchors.join(windows, "id").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))
    found = ask_trees(trees, asked, False, negatives)
    out = _best(found, ["anchor", "positive"], negatives)
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame, every: int = 50, shift: int = 7, labels: int = 10, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """Hard negatives of the rows whose vec_id `every` divides; where `shift` divides it, the label is the next one."""
    label = F.when(F.col("vec_id") % shift == 0, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label"))
    return mine(integer_rows(embeddings, "vec_id", "embedding", label, scale), F.col("id") % every == 0, block=block)
