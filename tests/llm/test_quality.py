import random

import numpy as np

from tests.llm.fixtures import docs, texts
from tidemark.llm import quality as Q


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n1 = y.sum()
    return (rank[y > 0].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def labelled(spark, n=700):
    rng = random.Random(11)
    rows, marks = [], []
    for k, t in enumerate(texts(n, 3)):
        bad = rng.random() < 0.3
        if bad:
            t = rng.choice([t.upper() + "!!", " ".join([w + "###" for w in t.split()]), (t.split()[0] + " ") * 30])
        rows.append((k, t, "en", "s", 0))
        marks.append((k, int(not bad), 0))
    df = spark.createDataFrame(rows, docs(spark).schema)
    return df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {k: q for k, q, _ in marks}


def test_held_out_rows_are_told_apart(spark):
    df, labels, truth = labelled(spark)
    rows = Q.quality_scores(df, labels).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert 0.1 < len(held) / len(rows) < 0.3
    y = np.array([truth[r.doc_id] for r in held])
    assert auc(np.array([r.score for r in held]), y) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    kept = Q.keep_good(df, labels)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit(x, y)
    assert model.pairs[0][:2] == (1, 0)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.95


def test_edges(spark):
    schema = "doc_id long, text string, score string, predicted string"
    df = spark.createDataFrame([(1, None, "", ""), (1, "", "", ""), (None, "a b", "", ""), (2, "x" * 100_000, "", None)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = Q.quality_scores(df, none).collect()
    assert [r.score for r in rows] == [0.5] * 4 and all(r.predicted == 1 for r in rows)
    one = spark.createDataFrame([(1, 1), (7, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert all(r.score is not None for r in Q.quality_scores(df, one).collect())
    assert Q.quality_scores(df.limit(0), one).collect() == []
    assert Q.score_texts(df, Q.fit(np.empty((0, 20)), np.empty(0))).columns == ["doc_id", "text", "score", "predicted"]


def naive_tree(g, h, cuts=2):
    """Every cut tried in turn by plain loops."""
    gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    edges = [0, len(g)]
    for _ in range(cuts):
        tried = []
        for a, b in zip(edges, edges[1:]):
            for m in range(a + 1, b):
                if sum(h[a:m]) > 1 and sum(h[m:b]) > 1:
                    tried.append((gain(a, m) + gain(m, b) - gain(a, b), -m))
        if not tried or max(tried)[0] <= 1e-9:
            break
        edges = sorted([*edges, -max(tried)[1]])
    return [sum(g[a:b]) / (sum(h[a:b]) + 1) for a, b in zip(edges, edges[1:]) for _ in range(a, b)]


def test_trees_match_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 9, 17):
        for _ in range(10):
            g, h = rng.normal(size=n) * 5, rng.random(n) * 3
            assert np.allclose(Q._tree(g, h), naive_tree(g.tolist(), h.tolist()))


def test_pair_tables_match_brute_force():
    rng = np.random.default_rng(4)
    for shape in ((2, 2), (3, 5), (6, 4)):
        g, h = rng.normal(size=shape) * 5, 1.1 + rng.random(shape) * 4
        cells = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
        best = max(
            (sum(g[c].sum() ** 2 / (h[c].sum() + 1) for c in cells(i, j)) - g.sum() ** 2 / (h.sum() + 1), i, j)
            for i in range(1, shape[0]) for j in range(1, shape[1]) if all(h[c].sum() > 1 for c in cells(i, j))
        )
        want = np.zeros(shape)
        for c in cells(*best[1:]):
            want[c] = g[c].sum() / (h[c].sum() + 1)
        gain, table = Q._quarters(g, h)
        assert np.isclose(gain, best[0]) and np.allclose(table, want)


def test_scores_match_a_naive_reading_of_the_tables(spark):
    df, labels, _ = labelled(spark, 200)
    model = Q.fit_quality(df, labels)
    got = {r.doc_id: r.score for r in Q.quality_scores(df, labels).collect()}
    for r in df.collect():
        x = Q.text_features(r.text)
        b = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges)]
        total = model.start + sum(float(t[k]) for t, k in zip(model.tables, b)) + sum(float(t[b[j], b[k]]) for j, k, t in model.pairs)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-total))) < 1e-9


def test_features_match_plain_counts():
    text = "One two two.\nTHREE 4 ## two two.\nOne two two."
    x = dict(zip(Q.TEXT_FEATURES, Q.text_features(text)))
    words, solid = text.split(), "".join(text.split())
    assert np.isclose(x["log_words"], np.log(1 + len(words))) and np.isclose(x["distinct_words"], len(set(words)) / len(words))
    assert np.isclose(x["digits"], 1 / len(solid)) and np.isclose(x["symbols"], 2 / len(solid)) and np.isclose(x["letters"], sum(c.isalpha() for c in solid) / len(solid))
    assert np.isclose(x["same_lines"], 1 / 3) and np.isclose(x["end_marks"], 3 / len(words)) and np.isclose(x["top_word"], 3 / len(words))
