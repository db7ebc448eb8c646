import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.vector import nearest
from tidemark.operators.timing import explain_analyze
from tidemark.operators.vector_index import VectorIndex
from tidemark.session import new_path, prepare

DIM = 16


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    middle = rng.standard_normal((20, DIM))
    rows = [(k, (middle[k % 20] + rng.standard_normal(DIM) * 0.4).astype("float32").tolist()) for k in range(1500)]
    rows += [(2000, None), (2001, [0.0] * DIM), (2002, [math.nan] * DIM), (2003, [1.0, 2.0]), (2004, []), (2005, rows[7][1])]
    return spark.createDataFrame(rows, "id int, v array<float>").repartition(4)


def test_searches_equal_a_full_search_and_read_few_cells(spark, vectors):
    prepare(spark)
    index = VectorIndex.build(vectors, new_path(spark, "index"), "id", "v", sample=600)
    assert sum(n for _, n in index.cells.values()) == 1501
    clean = vectors.where("id < 2000 or id = 2005")
    hits = 0
    queries = [r.v for r in clean.where("id % 50 = 0").orderBy("id").limit(8).collect()]
    for q in queries:
        at = F.array(*(F.lit(float(x)) for x in q))
        want = [(r.id, r.distance) for r in nearest(clean, "v", at, 10, "id").collect()]
        assert [tuple(r) for r in index.search(q, 10).collect()] == want
        hits += len({r.id for r in index.search(q, 10, exact=False).collect()} & {i for i, _ in want})
    assert hits >= 0.9 * 10 * len(queries)
    plan = explain_analyze(index.search(queries[0], 10, probes=2, exact=False))
    assert plan.rows == 10 and plan.seconds > 0
    assert "PartitionFilters: [cell" in plan.plan
    with pytest.raises(ValueError):
        index.search([0.0] * DIM, 3)


def test_more_neighbours_than_rows_and_an_empty_table(spark, vectors):
    few = vectors.where("id < 3 or id >= 2000").where("id <> 2005")
    index = VectorIndex.build(few, new_path(spark, "index"), "id", "v", cells=2)
    assert {r.id for r in index.search([1.0] * DIM, 9, probes=1).collect()} == {0, 1, 2}
    empty = VectorIndex.build(vectors.limit(0), new_path(spark, "index"), "id", "v")
    assert empty.search([1.0], 3).collect() == []


def labelled(spark, n, seed, first=0):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(4).standard_normal((20, DIM))
    rows = [(first + k, (middle[k % 20] + rng.standard_normal(DIM) * 0.3).astype("float32").tolist(), f"l{k % 20 // 4}") for k in range(n)]
    return spark.createDataFrame(rows, "id int, v array<float>, kind string").repartition(4)


def test_another_session_opens_it_and_inserts_split_full_cells(spark):
    path = new_path(spark, "index")
    first = labelled(spark, 150, 1)
    VectorIndex.build(first, path, "id", "v", cells=6, label="kind", full=120)
    index = VectorIndex.open(spark.newSession(), path)
    seen = first
    for k in range(3):  # ten times the rows, no rebuild
        more = labelled(spark, 450, 2 + k, 1000 * (k + 1))
        index.insert(more)
        seen = seen.unionByName(more)
    seen = seen.unionByName(spark.createDataFrame([(9000, None, "l1"), (9001, [0.0] * DIM, None)], seen.schema))
    index.insert(seen.where("id >= 9000"))
    index = VectorIndex.open(spark, path)
    assert len(index.cells) > 8 and max(n for _, n in index.cells.values()) <= 120 and sum(n for _, n in index.cells.values()) == 1500
    q = first.first().v
    at = F.array(*(F.lit(float(x)) for x in q))
    clean = seen.where("id < 9000")
    assert [tuple(r) for r in index.search(q, 10, probes=2).collect()] == [(r.id, r.distance) for r in nearest(clean, "v", at, 10, "id").collect()]
    for labels in (["l2"], ["l0", "l4"]):
        want = nearest(clean.where(F.col("kind").isin(labels)), "v", at, 10, "id").collect()
        assert [tuple(r) for r in index.search(q, 10, probes=2, labels=labels).collect()] == [(r.id, r.distance) for r in want]
        assert len(index._names(labels)) < 0.8 * len(index.cells)
    assert index.search(q, 3, labels=["none"]).collect() == []
    equal = VectorIndex.build(spark.createDataFrame([(99, q)], "id int, v array<float>"), new_path(spark, "index"), "id", "v", full=5)
    equal.insert(spark.createDataFrame([(k, q) for k in range(20)], "id int, v array<float>"))
    assert len(equal.cells) == 1 and len(equal.search(q, 30).collect()) == 21  # equal vectors can't be told apart


def test_many_queries_in_one_job_with_high_recall(spark):
    rows = labelled(spark, 2000, 7)
    index = VectorIndex.build(rows, new_path(spark, "index"), "id", "v", cells=40)
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("q"), "v")
    queries = queries.unionByName(spark.createDataFrame([(-1, None), (-2, [0.0] * DIM)], queries.schema))
    got = index.search_many(queries, "q", "v", 10, probes=8)
    hits = 0
    by = {}
    for r in got.collect():
        by.setdefault(r.query, []).append((r["rank"], r.id, r.distance))
    everything = {r.id: np.array(r.v, float) for r in rows.collect()}
    ids, x = np.array(list(everything)), np.array([v / np.linalg.norm(v) for v in everything.values()])
    for q, found in by.items():
        d = 1 - x @ x[ids == q][0]
        best = [int(ids[k]) for k in np.lexsort((ids, d))[:10]]
        hits += len(set(best) & {i for _, i, _ in found})
        assert sorted(r for r, _, _ in found) == list(range(1, 11)) and all(math.isclose(dist, float(d[ids == i][0]), abs_tol=1e-9) for _, i, dist in found)
    assert sorted(by) == list(range(0, 2000, 50)) and hits >= 0.9 * 400
    few = index.probes_for(queries, "q", "v", 10, 0.9)
    found = index.search_many(queries, "q", "v", 10, probes=few).join(index.search_many(queries, "q", "v", 10, probes=40), ["query", "id"]).count()
    less = index.search_many(queries, "q", "v", 10, probes=few - 1).join(index.search_many(queries, "q", "v", 10, probes=40), ["query", "id"]).count() if few > 1 else 0
    assert less < 360 <= found
    plain = index.search(everything[50].tolist(), 10, exact=False)
    assert {r.id for r in plain.collect()} == {i for _, i, _ in by[50]}


def test_radius_on_the_spheroid(spark):
    prepare(spark)
    rng = np.random.default_rng(2)
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-103, -101, 800), rng.uniform(30, 32, 800)))]
    metres = geo.vincenty_metres([r[1] for r in rows], [r[2] for r in rows], [-102.0] * 800, [31.0] * 800)
    df = spark.createDataFrame(rows, "id int, lon double, lat double")
    for limit in (float(np.sort(metres)[200]), 50_000.0, 0.0):
        got = {r.id: r.metres for r in geo.within_spheroid(df, F.col("lon"), F.col("lat"), -102, 31, limit).collect()}
        assert set(got) == set(np.flatnonzero(metres <= limit).tolist())
        assert all(math.isclose(got[k], metres[k], rel_tol=1e-12) for k in got)


def test_many_queries_meet_bins_of_cells_and_equal_rows_go_by_key(spark, monkeypatch):
    from tidemark.operators import vector_index

    monkeypatch.setattr(vector_index, "BIN", 100)
    rows = labelled(spark, 700, 3)
    q = rows.first().v
    rows = rows.unionByName(spark.createDataFrame([(5000 + k, q, "l0") for k in range(250)], rows.schema))  # a cell of over two bins
    index = VectorIndex.build(rows, new_path(spark, "index"), "id", "v", cells=12)
    queries = rows.where("id % 3 = 0").select(F.col("id").alias("q"), "v")
    assert any(parts > 1 for _, _, parts in index._bins(index._names(None)))
    got = index.search_many(queries, "q", "v", 10, probes=len(index.cells))
    by = {}
    for r in got.collect():
        by.setdefault(r.query, []).append((r["rank"], r.id))
    known = rows.collect()
    ids, x = np.array([r.id for r in known]), np.array([np.array(r.v, float) / np.linalg.norm(r.v) for r in known])
    assert len(by) == queries.count()
    for r in queries.collect():
        y = np.array(r.v, float) / np.linalg.norm(r.v)
        d = 1 - (x * y).sum(1)
        assert [i for _, i in sorted(by[r.q])] == ids[np.lexsort((ids, d))[:10]].tolist()
