import hashlib

from tests.llm.fixtures import docs
from tidemark.llm import substrings as S


def brute(rows, window=13):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if least[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_digests_match_brute_force(spark):
    df = docs(spark, 160).repartition(5)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for window in (13, 2, 6, 27):
        want = brute(rows, window)
        assert sorted(map(tuple, S.substring_digests(df, window).collect()), key=str) == want
        assert window == 27 or any(r[2] for r in want)


def test_small_chunks_and_texts(spark):
    df = docs(spark, 80)
    want = {r[0]: r for r in brute([(r.doc_id, r.text) for r in df.collect()])}
    for least in (7, 4, 2):
        assert {r[0]: tuple(r) for r in S.substring_digests(df, 13, least, chunk_bytes=500).collect()} == want
    out = S.drop_repeats(df)
    assert out.columns == df.columns
    for r in out.collect():
        kept = " ".join((r.text or "").split())
        assert want[r.doc_id][2] == 0 or hashlib.sha256(kept.encode()).hexdigest() == want[r.doc_id][3]
        assert r.text is None or r.n_chars == len(r.text)
    assert out.count() == sum(r[1] == 0 or r[1] > r[2] for r in want.values())


def test_edges(spark):
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(4, line, "a"), (4, "x " + line, "b"), (None, line, "c"), (9, line + " " + line, None), (2, None, None), (3, "short", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _tm_runs string")
    for clash in ("_tm_runs", "_tm_text", "_tm_0", "a.b"):
        other = df.withColumnRenamed("_tm_runs", clash)
        assert sorted(map(tuple, S.substring_digests(other).collect()), key=str) == brute([r[:2] for r in rows])
        kept = S.drop_repeats(other)
        assert kept.columns == other.columns and {(r[0], r[2]) for r in kept.collect()} == {(4, "a"), (4, "b"), (None, "c"), (2, None), (3, None)}
    long = df.limit(0).union(spark.createDataFrame([(1, "y " * 30_000 + line, None), (5, "z " * 40_000 + line, None)], df.schema))
    assert sorted((r.doc_id, r.n_removed) for r in S.substring_digests(long, chunk_bytes=1000).collect()) == [(1, 0), (5, 20)]
    got = sorted(map(tuple, S.substring_digests(df).collect()), key=str)
    assert got == brute([r[:2] for r in rows])
    assert S.substring_digests(df.limit(0)).collect() == []


def test_levels_double_until_nothing_repeats(spark):
    words = [f"w{i}" for i in range(30)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[:15]))], "doc_id long, text string")
    got = {(r.length, r.doc_id): r.n for r in S.repeat_levels(df).collect()}
    assert got == {(13, 2): 18, (13, 3): 3, (26, 2): 5}
