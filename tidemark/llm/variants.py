"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

Words are runs of Latin letters, A-Z lower-cased; a run whose checksum with its doc_id is divisible by `typo` loses a
code point. The vocabulary is the results of at least `least` code points that occur at least `seen` times.

A word of n code points between marks has n + q - 1 positional q-grams. One edit spares all but q of the longer word's,
so words one edit apart share at least as many as the longer has code points, less one: at the same places if they are
equally long, else at the same place or one further on in the longer.

1. A word is cut into SEGMENTS pieces. One edit leaves all of them but one, so a word goes to a key for each piece left
   out: of its length and all that stands before and after the piece. It is a member there, and asks for its own length;
   under the keys that its letters would have in a word longer by one it asks for those. So words one edit apart meet
   under exactly one key in which their first difference lies in the piece left out, and are counted only there.
2. Under a key, the q-grams outside the free piece are shared by all and need not be counted. Members are indexed by the
   gram and place of the others; for a question the postings of its grams, at the places that it allows, are merged in
   a heap, members that come up often enough for the bound are compared letter by letter, and each word's near words
   are summed up in the task: pairs are never written.

Keys with more than CROWD members are dealt out in blocks of members, each block asked by all of the key's words, so no
task holds more. A word's form is its commonest near word (ties: the first in code-point order) if that is `times` as
frequent; roots follow forms by doubling steps, as frequencies at least double with each.

Edge cases: null and empty texts have no words; a null doc_id counts as an empty one in the checksum; repeated rows are
counted each; very long texts are processed whole; ties as above; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, drop, key_chunks, materialise

Q, SEGMENTS, CROWD = 2, 5, 4_096
MEMBER, EVEN, LONGER = 1, 2, 4  # what a word is under a key: indexed there, a question for its own length, for one more
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(docs: DataFrame, typo: int = 97, least: int = 5, seen: int = 3) -> DataFrame:
    """(word, n) of the vocabulary."""
    text = F.translate(F.col("text").cast("string"), UPPER, UPPER.lower())
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text, F.lit("[a-z\\u00C0-\\u00FF]+"), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= least).withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    cut = F.expr("concat(substring(run, 1, cast(h % char_length(run) as int)), substring(run, cast(h % char_length(run) as int) + 2))")
    words = runs.select(F.when(F.col("h") % typo == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seen)


def grams(word: str, q: int = Q) -> list[str]:
    p = "^" * (q - 1) + word + "$" * (q - 1)
    return [p[k : k + q] for k in range(len(word) + q - 1)]


def cuts(n: int) -> list[int]:
    return [n * k // SEGMENTS for k in range(SEGMENTS + 1)]


def keyed_words(vocabulary: DataFrame) -> DataFrame:
    """(key, piece, role, word, n): a word under what is left of it without a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            keys, at = [], []
            for row, word in enumerate(b.column(0).to_pylist()):
                for longer in (0, 1):
                    n = len(word) + longer
                    edges = cuts(n)
                    for k, (s, e) in enumerate(zip(edges, edges[1:])):
                        if s < e:
                            keys.append((digest(f"{n}:{k}:{word[:s]} {word[e - longer :]}".encode()) - (1 << 63), k, LONGER if longer else MEMBER | EVEN))
                            at.append(row)
            at = pa.array(at, pa.int64())
            key, piece, role = zip(*keys) if keys else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(piece, pa.int32()), pa.array(role, pa.int32()), b.column(0).take(at), b.column(1).take(at)], ["key", "piece", "role", "word", "n"])

    return arrow_map(vocabulary.select("word", "n"), run, "key long, piece int, role int, word string, n long")


def first_difference(a: str, b: str) -> int:
    """Where the first difference of words lies that are exactly one inserted, deleted or replaced code point apart; -1
    of others."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return -1
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return k if a[k + (len(a) == len(b)) :] == b[k + 1 :] else -1


class PositionalIndex:
    """Words of one length that agree outside of [start, end): postings of the grams that touch it, by (gram, place), as
    ascending numbers of the words."""

    def __init__(self, words: list[str], start: int, end: int, q: int = Q):
        self.words, self.start, self.end, self.q = words, start, end, q
        self.postings: dict[tuple[str, int], list[int]] = defaultdict(list)
        if end - start > 1:  # else one edit may spare none of these grams, and all words are candidates
            for k, word in enumerate(words):
                for place, g in enumerate(grams(word, q)[start : end + q - 1], start):
                    self.postings[g, place].append(k)

    def candidates(self, word: str, longer: bool) -> Iterator[int]:
        """Numbers of the words that share enough grams with one of the same length, or of one code point less."""
        bound = self.end - self.start - 1
        if not bound:
            yield from range(len(self.words))
            return
        lists = []
        for place, g in enumerate(grams(word, self.q)[self.start : self.end - longer + self.q - 1], self.start):
            for p in (place, place + 1) if longer else (place,):
                if (g, p) in self.postings:
                    lists.append(self.postings[g, p])
        if len(lists) >= bound:
            for k, same in groupby(heapq.merge(*lists)):
                if bound == 1 or sum(1 for _ in same) >= bound:
                    yield k

    def near(self, word: str, longer: bool) -> Iterator[int]:
        """Numbers of the words one edit away whose first difference lies in [start, end)."""
        for k in self.candidates(word, longer):
            if self.start <= first_difference(word, self.words[k]) < self.end:
                yield k


def near_words(vocabulary: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, near, m, other): how many near words a word has under a key, and the first of them by frequency m."""
    keyed, _ = materialise(keyed_words(vocabulary), "keyed-words")
    member = f"role & {MEMBER} > 0"
    sizes = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.expr(member).cast("long")).alias("members")).where("rows > 1 and members > 0")
    many = F.col("members") > crowd
    dealt = keyed.join(sizes, "key").select("key", "piece", "role", "word", "n", F.when(many, F.ceil(F.col("members") / crowd).cast("int")).otherwise(1).alias("blocks"))
    # of a crowd, members lie in one block and all words ask all blocks
    own = F.struct(F.pmod(F.xxhash64("word"), "blocks").cast("int").alias("block"), F.lit(MEMBER).alias("role"))
    asks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("block"), F.when(F.col("role") == LONGER, LONGER).otherwise(EVEN).alias("role")))
    crowded = F.when(F.expr(member), F.concat(F.array(own), asks)).otherwise(asks)
    one = F.array(F.struct(F.lit(0).alias("block"), F.col("role").alias("role")))
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("blocks") > 1, crowded).otherwise(one))).select("key", "at.block", "piece", "at.role", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_chunks(batches, "key", 50_000):
            key, block, role, n = (t.column(c).to_numpy() for c in ("key", "block", "role", "n"))
            words, piece = t.column("word").to_pylist(), t.column("piece").to_pylist()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
            ends = np.r_[starts[1:], len(key)]
            worth = (np.add.reduceat(role & MEMBER, starts) > 0) & (ends - starts > 1)
            roles, counts = role.tolist(), n.tolist()
            out: list[tuple[int, int, int]] = []  # row, near words, row of the first
            for s, e in zip(starts[worth].tolist(), ends[worth].tolist()):
                out += summed(range(s, e), roles, words, counts, piece[s])
            row, near, first = (np.array(x, np.int64) for x in (zip(*out) if out else ((), (), ())))
            w = t.column("word").combine_chunks()
            yield pa.RecordBatch.from_arrays([w.take(pa.array(row)), pa.array(near), pa.array(n[first]), w.take(pa.array(first))], ["word", "near", "m", "other"])

    parts = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(dealt.repartition(parts, "key", "block").sortWithinPartitions("key", "block"), run, "word string, near long, m long, other string")


def summed(rows: range, roles: list[int], words: list[str], counts: list[int], piece: int) -> list[tuple[int, int, int]]:
    """(row, how many near words it has under this key, row of the first of them)."""
    own = sorted((k for k in rows if roles[k] & MEMBER), key=lambda k: (-counts[k], words[k]))
    edges = cuts(len(words[own[0]]))
    index = PositionalIndex([words[k] for k in own], edges[piece], edges[piece + 1])
    free = edges[piece + 1] - edges[piece]
    near: dict[int, list[int]] = {}  # row: number of near words, the first
    place = {index.words[k]: k for k in range(len(own))}

    def add(row: int, number: int, first: int) -> None:
        if number:
            had = near.setdefault(row, [0, first])
            had[0] += number
            if (-counts[first], words[first]) < (-counts[had[1]], words[had[1]]):
                had[1] = first

    for k in rows:
        if roles[k] & EVEN:
            if free == 1:  # they differ in one letter: all others are near, and the first is first
                me = place.get(words[k], -1)
                others = len(own) - (me >= 0)
                add(k, others, own[me == 0] if others else k)
            else:
                found = list(index.near(words[k], False))
                add(k, len(found), own[min(found)] if found else k)
        if roles[k] & LONGER:
            found = list(index.near(words[k], True))
            add(k, len(found), own[min(found)] if found else k)
            for m in found:
                add(own[m], 1, k)
    return [(row, number, first) for row, (number, first) in near.items()]


def spelling_variants(docs: DataFrame, typo: int = 97, least: int = 5, seen: int = 3, times: int = 2, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the vocabulary."""
    vocabulary, _ = materialise(word_counts(docs, typo, least, seen), "vocabulary")
    near = near_words(vocabulary, crowd)
    first = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    told = vocabulary.join(first, "word", "left")
    found = -F.col("best.m") >= times * F.col("n")
    told, _ = materialise(told.select("word", F.when(found, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(found, -F.col("best.m")).alias("form_n")), "forms")
    return told.join(roots(told.where("form is not null").select("word", F.col("form").alias("to"))), "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def roots(steps: DataFrame) -> DataFrame:
    """(word, to) with `to` followed to the end of its chain; chains have no rings. Each round doubles the steps taken."""
    now, path = materialise(steps, "steps")
    while True:
        ahead = now.select(F.col("word").alias("to"), F.col("to").alias("next"))
        new, new_path = materialise(now.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "steps")
        moved = new.where("moved").limit(1).count()
        drop(steps.sparkSession, path)
        now, path = new.select("word", "to"), new_path
        if not moved:
            return now
