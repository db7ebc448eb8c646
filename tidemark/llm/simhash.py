"""Near-duplicate documents by SimHash: fingerprints, then a binary trie self-join under a bit budget.

Fingerprints: text with A-Z lower-cased, words split at ASCII white space, shingles of consecutive words
(repeats count), XXH64 of each; a bit is set if it is set in over half of the hashes.

Join: a pair within two bits agrees on one of three blocks of the fingerprint, and what is left of it again
on one of three blocks. So each distinct fingerprint goes to nine keys of about 35 agreed bits, and the
fingerprints of a key form a binary trie over their other bits. Tries are joined with themselves, a level
(one bit) at a time: a pair of nodes carries its differing bits so far and ends as soon as they exceed the
budget. A pair of fingerprints within the budget meets under at least one key, so none is lost. Only a
spanning forest of each trie's links leaves the task, so a large group costs a row per member. Exact copies
were folded into one fingerprint before, so their number does not matter.

Edge cases: a null or wordless text has fingerprint zero, linked like any other; a text with fewer words than
a shingle hashes its whole word sequence; repeated rows link with themselves and come back as often as given;
a null doc_id keeps its fingerprint and takes part as a row, but never names a component unless it has no
other member; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import arrow_map, connected_components, find_roots, key_chunks, materialise

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    ends = ends[shingle - 1 :]
    digest = xxhash.xxh64_digest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit integer of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def _blocks(bits: list[int]) -> list[list[int]]:
    n = len(bits)
    return [bits[: n // 3], bits[n // 3 : 2 * n // 3], bits[2 * n // 3 :]]


def agreed_masks() -> list[int]:
    """The bits that the fingerprints of a key share, for each of the nine kinds of keys."""
    masks = []
    for block in _blocks(list(range(BITS))):
        rest = [b for b in range(BITS) if b not in block]
        masks += [sum(1 << b for b in block + inner) for inner in _blocks(rest)]
    return masks


def _walk(group: np.ndarray, words: np.ndarray, budget: int, joined: Callable[..., np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one group whose fingerprints differ in at most budget bits, part by part.

    Rows are sorted by (group, words) and distinct; words has a row of 64-bit words for each fingerprint. The node pair
    (a, b) of a level stands for two runs of rows [a0, a1) and [b0, b1) that agree on all bits read so far but diff of
    them. Node pairs that joined says yes to are left out.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    keep = ends - starts > 1
    count = words.shape[1]
    stack = [(BITS * count - 1, *(x[keep] for x in (starts, ends, starts, ends)), np.zeros(keep.sum(), np.int8))]
    while stack:
        bit, a0, a1, b0, b1, diff = stack.pop()
        if joined and len(a0):
            apart = ~joined(a0, a1, b0, b1)
            a0, a1, b0, b1, diff = (x[apart] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        if len(a0) > 1 << 19:  # bound memory: later parts wait
            half = len(a0) // 2
            stack += [(bit, *(x[half:] for x in (a0, a1, b0, b1, diff))), (bit, *(x[:half] for x in (a0, a1, b0, b1, diff)))]
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1) & (a0 != b0)
        if single.any():  # two leaves: the bits left are compared at once
            i, j = a0[single], b0[single]
            near = np.bitwise_count(words[i] ^ words[j]).sum(1) <= budget
            yield i[near], j[near]
            a0, a1, b0, b1, diff = (x[~single] for x in (a0, a1, b0, b1, diff))
        if bit < 0 or not len(a0):
            continue
        # the row at which a run turns from bit 0 to bit 1; rows of a run are sorted
        word = words[:, count - 1 - bit // BITS]
        one = np.r_[0, np.cumsum((word >> np.uint64(bit % BITS)) & np.uint64(1)).astype(np.int64)]
        am, bm = a1 - (one[a1] - one[a0]), b1 - (one[b1] - one[b0])
        own = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1)]
        parts.append(tuple(x[~own] for x in (am, a1, b0, bm, diff + 1)))
        new = [np.concatenate(x) for x in zip(*parts)]
        a0, a1, b0, b1, diff = new
        live = (a1 > a0) & (b1 > b0) & (diff <= budget) & ~((a0 == b0) & (a1 == b1) & (a1 - a0 == 1))
        stack.append((bit - 1, *(x[live] for x in new)))


def trie_links(group: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of the walk over fingerprints of 64 bits."""
    out = list(_walk(group, fp[:, None], budget))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def trie_roots(group: np.ndarray, words: np.ndarray, budget: int) -> np.ndarray:
    """For each row the first row of its group that it reaches over pairs of the walk.

    Rows beside each other are linked first; runs of rows that are linked already are not entered, so many alike
    fingerprints cost about a step each, not their pairs."""
    n = len(group)
    root, change = np.arange(n), np.arange(n)

    def link(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal root, change
        old = np.flatnonzero(root != np.arange(n))
        root = find_roots(n, np.concatenate([old, i]), np.concatenate([root[old], j]))
        change = np.cumsum(np.r_[False, root[1:] != root[:-1]])

    def joined(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        return (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (root[a0] == root[b0])

    beside = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(words[1:] ^ words[:-1]).sum(1) <= budget))
    link(beside, beside + 1)
    waiting, held = [], 0
    for i, j in _walk(group, words, budget, joined):
        waiting.append((i, j))
        held += len(i)
        if held > 1 << 16:
            link(*(np.concatenate(x) for x in zip(*waiting)))
            waiting, held = [], 0
    if held:
        link(*(np.concatenate(x) for x in zip(*waiting)))
    return root


def _trie_join(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    for t in key_chunks(batches, "key"):
        key, fp = t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        kind = t.column("kind").to_numpy()
        order = np.lexsort((fp, kind, key))
        key, kind, fp = key[order], kind[order], fp[order]
        group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])])
        # two agreed parts may share a hash key; the budget still decides on the whole fingerprints
        i, j = trie_links(group, fp, budget)
        root = find_roots(len(fp), i, j)
        linked = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[root[linked]].view(np.int64))], ["a", "b"])


def near_links(fps: DataFrame, budget: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span every group within the budget of bits."""
    if not 0 <= budget <= 2:
        raise ValueError("the keys hold for budgets of 0 to 2 bits")
    keys = F.explode(F.array(*[F.struct(F.lit(n).cast("int").alias("kind"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("part")) for n, m in enumerate(agreed_masks())]))
    rows = fps.select("fp").distinct().select("fp", keys.alias("k")).select("fp", "k.kind", F.xxhash64("k.kind", "k.part").alias("key"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key").sortWithinPartitions("key")
    return arrow_map(rows, lambda b: _trie_join(b, budget), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, budget: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    return _placed(docs, shingle, budget, seed).select("doc_id", "fp", "component_id")


def _placed(docs: DataFrame, shingle: int, budget: int, seed: int = 42) -> DataFrame:
    """simhash_groups with c, a fingerprint of the component: a doc_id that repeats may name several."""
    fps, _ = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    parts = connected_components(near_links(fps, budget))
    named = first.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "c").select("fp", "c", "component_id")
    return fps.join(classes, "fp")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """Keep the document with the smallest doc_id of each group; all columns stay.

    Rows are told apart by doc_id and fingerprint: of rows that repeat a doc_id only those go whose own text is in
    the group of a smaller one, and of near copies among them the one with the smallest text stays. Rows without
    a doc_id stay, but one of those with equal texts; `near.drop_near_copies` drops them too.
    """
    groups, _ = materialise(_placed(docs, shingle, budget), "groups")
    classes = groups.where("doc_id is not null").select(F.col("doc_id").alias("_tm_id"), F.col("fp").alias("_tm_fp"), F.col("component_id").alias("_tm_least"), F.col("c").alias("_tm_part")).distinct()
    names = [f"_tm_{k}" for k in range(len(docs.columns))]
    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(names, docs.schema)), StructField("_tm_fp", LongType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(at).cast(pa.string()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], [*names, "_tm_fp"])

    rows = arrow_map(docs.toDF(*names), run, schema).withColumn("_tm_id", F.col(names[docs.columns.index("doc_id")]).cast("long"))
    text = names[at]
    with_id = rows.where("_tm_id is not null").join(classes, ["_tm_id", "_tm_fp"]).where("_tm_id = _tm_least").drop("_tm_least")
    without = rows.where("_tm_id is null").withColumn("_tm_part", F.lit(None).cast("long"))
    first = F.row_number().over(Window.partitionBy("_tm_id", "_tm_part", F.when(F.col("_tm_id").isNull(), F.xxhash64(text))).orderBy(text))
    both = with_id.unionByName(without).withColumn("_tm_row", first).where("_tm_row = 1")
    return both.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
