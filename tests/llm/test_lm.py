import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from tests.llm.fixtures import docs
from tidemark.llm import lm


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + [None]


def brute(rows):
    """Probabilities by their recursion, token by token."""
    held = {d: zlib.crc32(str(d).encode() if d is not None else b"") % 10 == 0 for d, _ in rows}
    c = Counter()
    for d, t in rows:
        if not held[d]:
            ts = tokens(t)
            c.update((w,) for w in ts)
            c[("<s>",)] += 1
            c.update(zip(["<s>", *ts], ts))
            c.update(zip(["<s>", *ts], ts, ts[1:]))
    one = {k[0]: n for k, n in c.items() if len(k) == 1 and k[0] != "<s>"}
    n, v = sum(one.values()), len(one)
    n1, n2 = sum(x == 1 for x in one.values()), sum(x == 2 for x in one.values())
    d_ = min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))

    def p(w, before):
        if not before:
            return ((one[w] - d_) if w in one else d_ * v) / n if n else 1
        k = len(before) - 1
        lam = lm.RELY[k] * c[before] / (c[before] + lm.EASE[k])
        return (lam * c[(*before, w)] / c[before] if c[before] else 0) + (1 - lam) * p(w, before[1:])

    out = []
    for d, t in rows:
        ts = tokens(t)
        known = ["<s>", *ts]
        score = sum(math.log10(p(w, tuple(known[max(0, i - 1) : i + 1]))) for i, w in enumerate(ts))
        base = sum(math.log10((one.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ts)
        out.append((d, held[d], len(ts), sum(w in one for w in ts), n, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9)


def test_scores_match_brute_force_in_many_chunks(spark):
    df = docs(spark).repartition(3)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    same(lm.lm_scores(df, chunk_bytes=3000).collect(), brute(rows))
    same(lm.lm_scores(df).collect(), brute(rows))


def automaton(texts, held=()):
    """The automaton of texts in one chunk, and their tokens."""
    t = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts), "held_out": pa.array([k in held for k in range(len(texts))])})
    w = lm.Words(t.column("text"), lower=True)
    hashes = np.r_[w.hashes(), lm.Words(pa.array(["x"])).hashes(1)]
    g = lm.Grams(lm.pack(codes=w.codes.astype(np.uint32), lengths=np.diff(w.starts), hashes=hashes, held=t.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8), ids=np.arange(len(texts)), none=np.zeros(len(texts), np.uint8)))
    told, facts = lm._add(g.keys, g.counts, np.arange(len(g.keys)))
    return lm.Automaton(g, told, *facts), g


def test_weights_that_leave_each_state_sum_to_one():
    a, g = automaton(["a b c a b d a", "b c b c d", "a zz b"], held={2})
    words = np.arange(g.n_words)  # the held-out text has the one unknown word
    assert len(a.fail) > 12
    for state in range(len(a.fail)):
        weight, after = a.step(np.full(len(words), state), words)
        assert math.isclose((10**weight).sum(), 1)
        assert (after[a.token == 0] == 0).all() and (after[a.token > 0] > 0).all()


def test_stretches_carry_the_state_of_a_reading_from_the_start():
    rng = np.random.default_rng(1)
    a, g = automaton([" ".join(rng.choice(list("abcdefg"), n)) for n in (700, 3, 0, 257, 258)], held={3})
    for stretch in (2, 3, 256):
        assert np.allclose(a.read(g.tokens, g.begin, stretch), a.read(g.tokens, g.begin, 10_000))


def test_edges(spark):
    schema = "doc_id long, text string, score string"
    rows = [(1, "a B b", "x"), (1, "a B b", "x"), (2, None, None), (None, "a c", None), (3, "", None)]
    same(lm.lm_scores(spark.createDataFrame(rows, schema)).collect(), brute([r[:2] for r in rows]))
    assert lm.lm_scores(spark.createDataFrame([], schema)).collect() == []
    long = [(1, "p q " * 20_000), (2, "p q r"), (5, " ".join(f"u{k}" for k in range(3000)))]
    same(lm.lm_scores(spark.createDataFrame(long, "doc_id long, text string").withColumn("_tm_doc", F.lit(1)), chunk_bytes=1000).collect(), brute(long))
    alone = [(None, "q r", None)]
    same(lm.lm_scores(spark.createDataFrame(alone, schema)).collect(), brute([r[:2] for r in alone]))
