"""Near-duplicate documents by word shingles: candidates by SimHash tries, links by exact Jaccard similarity.

Texts with A-Z lower-cased are split at ASCII white space; a text is the set of its sequences of five words (a
shorter text is its whole word sequence). Two texts are linked if the Jaccard similarity of their sets is at
least 0.8. At that similarity a bit of their SimHash fingerprints differs with a probability of 0.15 (0.19 for the
smallest sets), 10 to 12 bits of 64, so that op10's keys of fixed agreed bits, which hold for two, find few of them.

1. Texts of the same words are one node. The shingles of a node cast 512 votes. Its fingerprint is their signs, its keys
   are agreed bits at the places that its votes are surest of: each of the (at least 56) tables turns the
   votes (sums of four of them with signs) and takes place and sign of the strongest in either half. At 0.8 nodes share
   one key in five, so that they share none with a probability of about 5e-6; places in a half double as nodes grow
   fourfold, so that nodes of a key stay few, and tables grow with their log.
2. The first 128 bits of the fingerprints of a key form a binary trie, which is joined with itself under a budget of 44 bits
   (at 0.8 nodes differ in 19, the smallest in 24, with a spread of 4; unlike ones in 64). One unlike pair of a key in
   4,000 passes, so nodes that met unlike ones alone would grow with the nodes of a key. So those that reach each other
   form a second trie of all 512 bits, under a budget of 140 (at 0.8 nodes differ in 78, the smallest in 96, with a
   spread of 9; unlike ones in 256, with one of 11). Nodes that reach each other there are a band.
3. In each band, nodes within 104 bits of the smallest node are compared with it; components over the links found are formed.
4. In bands whose nodes are still in several components, the nodes outside the band's largest component are compared
   with a member of it, another one in each of ROUNDS rounds and in each band, if that component has an eighth of the
   band or more. So a large group of copies costs a few pairs a node; bands with few links cost none.
5. What is still apart is joined by its rarest shingles: texts that are alike share one of the first fifth of each
   one's shingles, from rare to common, and the first one that they share leaves enough of either behind it. Pairs of
   different components that share a shingle at such places, and whose sizes allow the similarity, are compared.
   Texts that share a template and differ in the rest have no such shingle.

Pairs within a component can't change it, so components are those of all candidate pairs.

Edge cases: texts without words (null ones too) are equal; a null doc_id takes part as a row and is kept only if
its group has no other; rows are told apart by doc_id and text, so of rows that repeat a doc_id only those go
whose text has a near copy; of equal rows one stays; very long texts are processed whole, in chunks of texts; an empty
table gives an empty result; further columns, whatever their names, come through as they are.
"""

from __future__ import annotations

import functools
import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, connected_components, key_chunks, materialise, settled, text_chunks
from tidemark.llm.simhash import BITS, trie_roots
from tidemark.llm.words import mix

SHINGLE, SIMILARITY = 5, 0.8
VOTES, WORDS, BUDGET, CLOSE = 512, 8, 140, 104
FIRST_WORDS, FIRST_BUDGET = 2, 44
PLACES, CROWD = 64, 32
ROUNDS, SMALL = 2, 8
_SALTS = mix(np.arange(1, 1 + VOTES // BITS, dtype=np.uint64))


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word sequences, sorted."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :])]), ">u8").astype(np.uint64))


def votes(shingles: np.ndarray) -> np.ndarray:
    """The sum of the shingles' votes, 1 or -1, on each of VOTES bits."""
    yes = np.zeros(VOTES, np.int64)
    for at in range(0, len(shingles), 255):  # sums of 255 bits fit a byte
        hashes = mix(shingles[at : at + 255, None] ^ _SALTS)
        yes += np.unpackbits(hashes.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return 2 * yes - len(shingles)


def places_for(nodes: int) -> int:
    """Places in either half of the turned votes, for keys of few nodes."""
    places = PLACES
    while CROWD * (2 * places) ** 2 < nodes:
        places *= 2
    return places


@functools.cache
def turns(places: int) -> np.ndarray:
    """For each table the four votes that are summed at each of its places."""
    tables = 16 * (places.bit_length() - 1) - 40
    return np.random.default_rng(places).integers(0, VOTES, (tables, 4, 2 * places))


def strong_keys(cast: np.ndarray, places: int) -> np.ndarray:
    """A key for each column of votes and each table: place and sign of the strongest vote in either half."""
    keys, bits = [], np.int64(places.bit_length())
    at = (np.arange(2 * places) % places << 1)[:, None]
    for n, (a, b, c, d) in enumerate(turns(places)):
        turned = cast[a] - cast[b] + cast[c] - cast[d]
        told = np.abs(turned) << bits | at | (turned > 0)
        first, second = (told[k : k + places].max(0) & ((1 << bits) - 1) for k in (0, places))
        keys.append(n << 2 * bits | first << bits | second)
    return np.stack(keys, 1)


def band_keys(shingles: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The keys of one set."""
    return strong_keys(votes(shingles)[:, None], places)[0]


def whole_key(shingles: np.ndarray) -> int:
    """The only key of a set of fewer than four shingles: no other set is alike. It is negative, other keys are not."""
    return int(np.bitwise_xor.reduce(mix(shingles)) | np.uint64(1 << 63)) - (1 << 64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, raw, node, size, fp, keys) of each row: raw is the text's hash, node that of its words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    places = places_for(rows.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            for t in (chunk.slice(at, 256) for at in range(0, len(chunk), 256)):  # short texts are many
                raw, node, sets = [], [], []
                for text in t.column("text").to_pylist():
                    words = plain_words(text)
                    sets.append(shingle_set(words))
                    raw.append(hashlib.md5((text or "").encode()).hexdigest())
                    node.append(xxhash.xxh64_intdigest(b" ".join(words), 7))
                cast = np.stack([votes(x) for x in sets], 1)
                fp = np.packbits(cast[: BITS * WORDS] > 0, axis=0).T.copy().view(np.int64)
                keys = [row if len(x) > 3 else [whole_key(x)] if len(x) else [] for row, x in zip(strong_keys(cast, places), sets)]
                cols = [t.column("doc_id").combine_chunks(), pa.array(raw), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(map(len, sets), pa.int32()), pa.array(list(fp), pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "raw", "node", "size", "fp", "keys"])

    return arrow_map(rows, run, "doc_id long, raw string, node long, size int, fp array<long>, keys array<long>")


def reached(rows: DataFrame, count: int, budget: int) -> DataFrame:
    """(key, node, hub, bits): nodes of a key that reach each other in the trie of so many words f0, f1, ... under the budget,
    with a key of their own, the smallest of them and the number of bits in which its fingerprint differs from the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_chunks(batches, "key"):
            key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
            words = np.stack([t.column(f"f{k}").to_numpy() for k in range(count)], 1).view(np.uint64)
            order = np.lexsort((node, *words.T[::-1], key))
            key, node, words = key[order], node[order], words[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (words[1:] != words[:-1]).any(1)]  # the same fingerprint is one row of the trie
            at = np.cumsum(new) - 1
            root = trie_roots(key[new], words[new], budget)[at]
            by = np.lexsort((node, root))
            first = np.empty(len(root), np.int64)  # of each root the place of its smallest node
            first[root[by[::-1]]] = by[::-1]
            hub = first[root]
            several = np.bincount(root, minlength=len(root))[root] > 1
            own = mix(mix(key.view(np.uint64)) ^ node[hub].view(np.uint64)).view(np.int64)
            bits = np.bitwise_count(words ^ words[hub]).sum(1, dtype=np.int32)
            cols = {"key": own, "node": node, "hub": node[hub], "bits": bits}
            yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in cols.values()], list(cols))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(rows.repartition(n, "key").sortWithinPartitions("key"), run, "key long, node long, hub long, bits int")


def trie_bands(nodes: DataFrame) -> DataFrame:
    """(key, node, size, hub, bits): nodes that reach each other in the trie of a key, and then in that of their whole
    fingerprints. Only nodes that pass the first trie carry the whole ones."""
    words = [F.col("fp")[k].alias(f"f{k}") for k in range(WORDS)]
    met = reached(nodes.select(F.explode("keys").alias("key"), "node", *words[:FIRST_WORDS]), FIRST_WORDS, FIRST_BUDGET)
    whole = met.select("key", "node").join(nodes.select("node", *words), "node")
    return reached(whole.select("key", "node", *(f"f{k}" for k in range(WORDS))), WORDS, BUDGET).join(nodes.select("node", "size"), "node")


def alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(node: int, text: str) -> np.ndarray:
            if node not in known:
                known[node] = shingle_set(plain_words(text))
                if len(known) > 512:
                    known.popitem(last=False)
            return known[node]

        for batch in batches:
            a, b, ta, tb = (batch.column(k) for k in range(4))
            good = []
            for i, j, x, y in zip(a.to_pylist(), b.to_pylist(), ta, tb):
                s, t = of(i, x.as_py()), of(j, y.as_py())
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(both >= SIMILARITY * (len(s) + len(t) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    told = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return arrow_map(told.select("a", "b", "ta", "tb"), run, "a long, b long")


def near_components(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, component) of nodes that have near copies; rows: signatures of docs."""
    one = rows.groupBy("node").agg(F.min("raw").alias("raw"), *(F.first(c).alias(c) for c in ("size", "fp", "keys")))
    bands, _ = materialise(trie_bands(one), "bands")
    wanted = rows.join(bands.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("raw").alias("raw"))
    distinct = docs.select(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("raw"), F.col("text").cast("string").alias("text")).dropDuplicates(["raw"])
    texts, _ = materialise(distinct.join(wanted, "raw").select("node", "text"), "candidates")
    stars, _ = materialise(bands.where(f"node <> hub and bits <= {CLOSE}").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    near, _ = materialise(alike(stars, texts), "near")
    parts = connected_components(near).withColumnRenamed("component", "c")
    placed, _ = materialise(_mixed(bands.join(parts, "node", "left").select("key", "node", "size", F.coalesce("c", "node").alias("c"))), "mixed-bands")
    merged = []
    for turn in range(1, ROUNDS + 1):
        if placed.isEmpty():
            break
        pick = F.min(F.struct(F.xxhash64(F.lit(turn), "key", "node").alias("h"), "node", "size")).alias("pick")
        own = placed.groupBy("key", "c").agg(F.count("*").alias("n"), pick)
        hubs = own.groupBy("key").agg(F.max(F.struct("n", "c", "pick")).alias("hub"), F.sum("n").alias("rows"))
        hubs = hubs.where(f"hub.n > 1 and hub.n * {SMALL} >= rows").select("key", "hub.c", "hub.pick.node", "hub.pick.size")
        x, y = placed.alias("x"), hubs.alias("y")
        asked = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & _fits())
        step = _joined(asked, texts)
        merged.append(step)
        placed, _ = materialise(_mixed(_renamed(placed, step)), "mixed-bands")
    if not placed.isEmpty():
        rare, _ = materialise(rare_shingles(placed.select("node", "size", "c").distinct(), texts), "rare-shingles")
        x, y = rare.alias("x"), rare.alias("y")
        # no more is shared than the first shared shingle and what follows it in either
        shared_most = 1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
        enough = shared_most >= F.ceil((F.col("x.size") + F.col("y.size")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)
        asked = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.c") < F.col("y.c")) & enough & _fits())
        merged.append(_joined(asked, texts))
    for step in merged:
        moved = step.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        near = near.unionByName(moved)
    return connected_components(near) if merged else parts.withColumnRenamed("c", "component")


def _fits():
    return F.least("x.size", "y.size") >= SIMILARITY * F.greatest("x.size", "y.size") - 1e-9


def _mixed(placed: DataFrame) -> DataFrame:
    """Rows of bands whose nodes lie in several components."""
    several = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    return placed.join(several, "key")


def _joined(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) over components that turn out to be linked: c as node, the smallest c as component."""
    pairs, _ = materialise(asked.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"), F.greatest("x.c", "y.c").alias("ca"), F.least("x.c", "y.c").alias("cb")).distinct(), "pairs")
    links = alike(pairs.select("a", "b"), texts).join(pairs, ["a", "b"])
    return connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))


def _renamed(placed: DataFrame, step: DataFrame) -> DataFrame:
    return placed.join(step.withColumnRenamed("node", "c"), "c", "left").select("key", "node", "size", F.coalesce("component", "c").alias("c"))


def rare_shingles(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(shingle, node, size, c, place): of each node's shingles from rare to common, those of the first fifth that others have.

    Alike texts share at least SIMILARITY of the larger one's shingles, so the first shared one, in an order that all
    agree on, is among the first size - ceil(SIMILARITY * size) + 1 of either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_chunks(batches):
            sets = [shingle_set(plain_words(x)) for x in t.column("text").to_pylist()]
            node = np.repeat(t.column("node").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.concatenate(sets).view(np.int64), pa.int64())], ["node", "shingle"])

    told, _ = materialise(arrow_map(texts.join(nodes, "node", "left_semi").select("node", "text"), run, "node long, shingle long"), "shingles")
    shared = told.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    known = told.join(shared, "shingle").join(nodes, "node")
    by_node = Window.partitionBy("node")
    alone = F.col("size") - F.count("*").over(by_node)  # those that no other node has come first
    place = alone + F.row_number().over(by_node.orderBy("n", "shingle"))
    first = F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-9) + 1
    return known.select("shingle", "node", "size", "c", place.alias("place"), first.alias("first")).where("place <= first").drop("first")


def _kept(docs: DataFrame) -> DataFrame:
    """(id, none, raw) of the rows that stay."""
    rows, _ = materialise(signatures(docs), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")
    first = rows.groupBy("node").agg(F.min(place).alias("first"))  # exact copies are folded before groups are
    named = first.join(near_components(docs, rows), "node", "left").withColumn("c", F.coalesce("component", "node"))
    on = [F.coalesce("first.doc_id", F.lit(0)).alias("id"), F.col("first.none").alias("none"), F.col("first.raw").alias("raw")]
    return named.groupBy("c").agg(F.min("first").alias("first")).select(*on)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id; all columns stay."""
    kept = settled(lambda: _kept(docs), "kept")
    ids = docs["doc_id"].cast("long")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(ids, F.lit(0)).alias("id"), ids.isNull().alias("none"), F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("raw"))
    names = ["id", "none", "raw"]
    return keyed.dropDuplicates(names).join(kept, names, "left_semi").select("row.*")
