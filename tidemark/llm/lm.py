"""Scoring of texts by smoothed n-grams, run as a weighted backoff automaton.

States: the root, a state for each token and each pair of tokens that training texts hold, and the start of a text.
A state has an arc for each token seen after it, which leads to the state of the last two tokens, and a failure arc
to the state without its first token. State u relies on its own counts by lam(u) = rely*c(u)/(c(u)+ease): a seen arc
w weighs lam*c(uw)/c(u) + (1-lam)*p(w), with p(w) the weight of w at the state below, and the failure arc weighs
1-lam, so all that leaves a state sums to one. The root discounts each count by D = n1/(n1+2*n2) (kept within 0.05
and 0.95): p(w) = (c-D)/N, and D*V/N goes to all unknown tokens together, which lead back to the root. Texts are
read from left to right: each token follows its arc, or failure arcs until a state has one, and adds their log10
weights. Many stretches of text are read side by side; a stretch within a text enters two tokens early without
counting them, after which it carries the very state of a reading from the start.

At scale the automaton is never whole anywhere. Texts are cut into chunks of bounded size, written once as token
codes. Each chunk asks for the tokens, pairs and triples that occur in it, with its own training counts; key ranges
add these up over all chunks and answer in the chunk's order (`exchange`), so a chunk builds exactly the part of the
automaton that its texts can reach, and a token that all texts hold costs one entry in each chunk. Tokens, pairs and
triples are told apart by 54-bit hashes: at 10^13 distinct ones a count in 2,000 is another's too.

Tokens: A-Z lower-cased, split at ASCII white space, then one end token per text. Edge cases: a null text is
empty (its end token alone is scored); a null doc_id counts as held out; repeated rows are scored each and
count each; a text longer than a chunk has one of its own; without training texts every token is unknown and score
and base_score are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, give_back, materialise, text_chunks
from tidemark.llm.exchange import answer, ask, ranges_for, unpacked, with_answers
from tidemark.llm.words import Words, mix, pack, unpack

#: How far a state of one token, and of two, relies on its counts at most, and the count at which it does so by half.
RELY, EASE = (0.6, 0.8), (3.0, 3.0)
_START = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0xD1342543DE82EF95)
STRETCH, MEMORY = 256, 2
#: Bits of a key; the lowest two say how many tokens it stands for.
KEY_BITS = 56


def _read(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for k, t in enumerate(text_chunks(batches, "text", size)):
        w = Words(t.column("text"), lower=True)
        ids = t.column("doc_id")
        data = pack(
            codes=w.codes.astype(np.uint32),
            lengths=np.diff(w.starts),
            hashes=np.r_[w.hashes(), Words(pa.array(["x"])).hashes(1)],  # the end token comes last
            held=t.column("held_out").to_numpy().astype(np.uint8),
            ids=ids.fill_null(0).to_numpy(),
            none=ids.is_null().to_numpy().astype(np.uint8),
        )
        yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + k], pa.int64()), pa.array([len(w.codes) + len(ids)], pa.int64()), pa.array([data], pa.binary())], ["chunk", "tokens", "data"])


class Grams:
    """Tokens of a chunk, and its distinct tokens, pairs and triples with their training counts in it."""

    def __init__(self, data: bytes):
        x = unpack(data)
        self.n_words, self.lengths = len(x["hashes"]), x["lengths"] + 1
        self.ids, self.held = pa.array(x["ids"], pa.int64(), mask=x["none"].astype(bool)), x["held"].astype(bool)
        self.begin = np.r_[0, np.cumsum(self.lengths)].astype(np.int64)
        self.tokens = np.full(int(self.begin[-1]), self.n_words - 1, np.int64)
        inner = np.ones(len(self.tokens), bool)
        inner[self.begin[1:] - 1] = False
        self.tokens[inner] = x["codes"]
        train = ~np.repeat(self.held, self.lengths)
        start = self.begin[:-1]
        last = np.r_[np.int64(0), self.tokens[:-1]]
        last[start] = self.n_words  # stands for the start of a text
        self.pairs, pair = np.unique(last * self.n_words + self.tokens, return_inverse=True)
        deep = np.ones(len(self.tokens), bool)
        deep[start] = False  # the first token has one token before it, the start
        before = np.r_[np.int64(0), pair[:-1]]
        self.triples, triple = np.unique((before * self.n_words + self.tokens)[deep], return_inverse=True)
        counts = [np.bincount(v[t], minlength=n) for v, t, n in ((self.tokens, train, self.n_words), (pair, train, len(self.pairs)), (triple, train[deep], len(self.triples)))]
        states = np.r_[x["hashes"], _START]
        double = mix(mix(states[self.pairs // self.n_words]) * _PAIR + x["hashes"][self.pairs % self.n_words])
        treble = mix(mix(double[self.triples // self.n_words]) * _PAIR + x["hashes"][self.triples % self.n_words])
        keys = np.concatenate([(mix(k) >> np.uint64(64 - KEY_BITS)) & ~np.uint64(3) | np.uint64(order) for order, k in enumerate((x["hashes"], double, treble))])
        self.order = np.argsort(keys)
        self.keys, self.counts = keys[self.order], np.concatenate(counts)[self.order]

    def split(self, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts in all training texts of the tokens, pairs and triples."""
        c = np.empty(len(told), np.int64)
        c[self.order] = told
        return tuple(np.split(c, [self.n_words, self.n_words + len(self.pairs)]))


class Automaton:
    """The states and arcs that some texts can reach. State 0 is the root, 1 + w that of token w, then the start,
    then the pairs."""

    def __init__(self, g: Grams, told: np.ndarray, n: int, v: int, n1: int, n2: int):
        one, two, three = g.split(told)
        words = g.n_words
        self.words, self.start = words, 1 + words
        d = min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
        root = np.where(one > 0, one - d, d * v) / n if n else np.ones(words)
        state = np.r_[one, one[-1]]  # texts begin as often as they end
        (rely1, rely2), (ease1, ease2) = RELY, EASE
        lam1 = rely1 * state / (state + ease1)
        lam1[words - 1] = 0  # nothing follows the end
        first, last = g.pairs // words, g.pairs % words
        pair = lam1[first] * two / np.maximum(state[first], 1) + (1 - lam1[first]) * root[last]
        lam2 = np.where(last == words - 1, 0, rely2 * two / (two + ease2))
        #: the pair without the triple's first token is a pair of this chunk too
        parent, final = g.triples // words, g.triples % words
        below = pair[np.searchsorted(g.pairs, last[parent] * words + final)]
        triple = lam2[parent] * three / np.maximum(two[parent], 1) + (1 - lam2[parent]) * below
        own = np.flatnonzero(two)  # pairs that are states
        number = np.zeros(len(two), np.int64)
        number[own] = 2 + words + np.arange(len(own))
        token = np.where(one > 0, 1 + np.arange(words), 0)
        self.fail = np.concatenate([np.zeros(2 + words, np.int64), token[last[own]]])
        self.down = np.log10(np.concatenate([[1.0], 1 - lam1, 1 - lam2[own]]))
        self.root, self.token = np.log10(root), token
        seen = np.flatnonzero(three)
        # an arc of a pair leads to the pair of its last two tokens, which training texts hold too
        onto = number[np.searchsorted(g.pairs, last[parent[seen]] * words + final[seen])]
        arcs = np.concatenate([(1 + first[own]) * words + last[own], number[parent[seen]] * words + final[seen]])
        order = np.argsort(arcs)
        self.arcs = arcs[order]
        self.weight = np.log10(np.concatenate([pair[own], triple[seen]]))[order]
        self.onto = np.concatenate([number[own], onto])[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 weight, next state) of reading a word in each state."""
        gained, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        at = np.arange(len(state))
        while len(at):
            s, w = state[at], word[at]
            low = s == 0
            gained[at[low]] += self.root[w[low]]
            after[at[low]] = self.token[w[low]]
            at, s, w = at[~low], s[~low], w[~low]
            key = s * self.words + w
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1) if len(self.arcs) else np.zeros(len(key), np.int64)
            hit = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(key), bool)
            gained[at[hit]] += self.weight[arc[hit]]
            after[at[hit]] = self.onto[arc[hit]]
            at, s = at[~hit], s[~hit]
            gained[at] += self.down[s]
            state = state.copy()
            state[at] = self.fail[s]
        return gained, after

    def read(self, tokens: np.ndarray, begin: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """Scores of texts, which begin and end at the places given."""
        n = np.diff(begin)
        count = -(-n // stretch)
        text = np.repeat(np.arange(len(n)), count)
        head = begin[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * stretch
        end = np.minimum(head + stretch, begin[1:][text])
        at = np.maximum(head - MEMORY, begin[:-1][text])
        state = np.where(at == begin[:-1][text], self.start, 0)
        score = np.zeros(len(text))
        order = np.argsort(at - end, kind="stable")  # the longest first
        text, head, end, at, state = (x[order] for x in (text, head, end, at, state))
        longest = end - at
        for k in range(int(longest[0]) if len(longest) else 0):
            m = int(np.searchsorted(-longest, -k, side="left"))  # stretches longer than k
            spot = at[:m] + k
            gained, state[:m] = self.step(state[:m], tokens[spot])
            score[:m] += np.where(spot >= head[:m], gained, 0)
        return np.bincount(text, score, len(n))


def _add(keys: np.ndarray, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Sums by key; and of the tokens all, how many distinct, once and twice."""
    total = np.add.reduceat(values, first) if len(first) else values
    token = total[(keys[first] & np.uint64(3)) == 0]
    return np.repeat(total, np.diff(np.r_[first, len(keys)])), [token.sum(), (token > 0).sum(), (token == 1).sum(), (token == 2).sum()]


def _question(row: dict) -> tuple[np.ndarray, np.ndarray]:
    g = Grams(row["data"])
    return g.keys, g.counts


def _score(batches: Iterator[pa.RecordBatch], n: int, v: int, n1: int, n2: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data, answers in zip(b.column("data"), b.column("answers")):
            g, told = Grams(data.as_py()), unpacked(answers.as_py())[0].astype(np.int64)
            c = g.split(told)[0]
            base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            score = Automaton(g, told, n, v, n1, n2).read(g.tokens, g.begin)
            sums = [np.add.reduceat(x[g.tokens], g.begin[:-1]) for x in ((c > 0).astype(np.int64), base)]
            cols = [g.ids, pa.array(g.held), pa.array(g.lengths), pa.array(sums[0]), pa.array(np.full(len(g.lengths), n, np.int64)), pa.array(sums[1]), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            give_back()


def lm_scores(docs: DataFrame, folds: int = 10, chunk_bytes: int = 5 << 20) -> DataFrame:
    """Scores of all texts by the model of those whose crc32(doc_id as text) mod folds is not 0."""
    ids = F.col("doc_id").cast("long")
    rows = docs.select(ids.alias("doc_id"), F.col("text").cast("string").alias("text"), (F.crc32(F.coalesce(ids.cast("string"), F.lit(""))) % folds == 0).alias("held_out"))
    chunks, _ = materialise(arrow_map(rows, lambda b: _read(b, chunk_bytes), "chunk long, tokens long, data binary"), "lm-texts")
    ranges = ranges_for(chunks, 3 * (chunks.agg(F.sum("tokens")).first()[0] or 0))
    chunks = chunks.select("chunk", "data")
    facts = ("n", "v", "n1", "n2")
    told, _ = materialise(answer(ask(chunks, _question, ranges, KEY_BITS), _add, facts), "lm-counts")
    sums = [int(x or 0) for x in told.agg(*[F.sum(x) for x in facts]).first()]
    return arrow_map(with_answers(chunks, told), lambda b: _score(b, *sums), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
