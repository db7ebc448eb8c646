import math

import numpy as np
import pytest

from tidemark.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, id string, q int, score double"


def brute(rows, positives=5, negatives=3):
    """Every score of every anchor."""
    first = {}
    for r in rows:
        i, v, label = r[:3]
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in v) < 1 << 53 and (i not in first or (label, v) < first[i]):
            first[i] = (label, v)
    out = []
    for a, (label, q) in first.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, k) for i, (k, v) in first.items() if i != a and len(v) == len(q))
        best = [(i, -s) for s, i, k in scored if k == label][:positives]
        for i, p in best:
            fits = [(j, -s) for s, j, k in scored if k != label and 50 * p <= -100 * s <= 95 * p][:negatives]
            out += [(a, i, r, j, p, n) for r, (j, n) in enumerate(fits, 1)]
    return sorted(out)


def found(df, **kw):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in N.hard_negatives(df, **kw).collect())


def sample(n=700, d=6, seed=1, hot=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d))
    rows = []
    for k in range(n):
        v = centres[k % 4] + rng.normal(size=d) * 0.6
        label = 3 if hot and k % 3 else int(rng.integers(0, 10))
        rows.append((k * 5, [float(np.float32(x)) for x in v], label, "a", 1, 0.5))
    return rows


@pytest.mark.parametrize("block", [40, 100_000])
def test_equals_all_scores(spark, block):
    rows = sample()
    want = brute(rows)
    assert want and found(spark.createDataFrame(rows, SCHEMA), block=block) == want


def test_equal_vectors_and_ties(spark):
    rows = [(k, [0.5, 0.25], k % 2, None, None, None) for k in range(300)] + [(k, [0.5, 0.125], 2, None, None, None) for k in range(300, 340)]
    want = brute(rows)
    assert want and found(spark.createDataFrame(rows, SCHEMA).repartition(5), block=50) == want


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = sample(150, 3, hot=False)
    odd = [(10_000, None, 1), (10_050, [1.0, None, 2.0], 1), (10_100, [1.0, inf, 0.0], 1), (10_150, [nan, 0.0, 0.0], 1), (10_200, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 2)]
    odd += [(20_000, [1.0], 1), (20_001, [0.9], 1), (20_003, [0.6], 2), (30_000, [], 4), (30_001, [], 4), (30_002, [], 5), (40_000, [1e20, 0.0, 0.0], 1), (50_000, [0.0, 0.0, 0.0], 1)]
    odd += [(60_000, [1.0, 0.5, 0.1], 6), (60_000, [1.0, 0.5, 0.2], 6), (60_000, [1.0, 0.5, 0.1], 2), (60_002, [1.0, 0.5, 0.1], 2), (60_002, [1.0, 0.5, 0.1], 2), (-50, [0.5, 0.5, 0.5], -3)]
    rows += [(*r, None, None, None) for r in odd]
    assert found(spark.createDataFrame(rows, SCHEMA), block=64) == brute(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(50, [1.0], 1, None, None, None)], SCHEMA)) == []


def test_bounds_leave_rows_out():
    rng = np.random.default_rng(3)
    x = np.floor(np.concatenate([rng.normal(c, 0.05, (2_000, 8)) for c in rng.normal(size=(6, 8))]) * 256)
    tree = N.BallTree.unpack(N.BallTree.build(x, np.arange(len(x)), np.zeros(len(x), np.int64)).pack())
    q = x[::1200]
    inf = np.full(len(q), np.inf)
    scores, ids, seen = tree.best(q, np.full(len(q), -1), np.zeros(len(q), np.int64), True, -inf, inf, 5)
    want = -np.sort(-(q @ x.T), axis=1)[:, :5]
    assert np.array_equal(scores, want) and seen < len(q) * len(x) / 3
    top = want[:, 0]
    scores, ids, seen = tree.best(q, np.full(len(q), -1), np.ones(len(q), np.int64), False, top * 0.5, top * 0.6, 3)
    for k, row in enumerate(q @ x.T):
        inside = -np.sort(-row[(row >= top[k] * 0.5) & (row <= top[k] * 0.6)])[:3]
        assert np.array_equal(scores[k][np.isfinite(scores[k])], inside)
    assert seen < len(q) * len(x) / 2
