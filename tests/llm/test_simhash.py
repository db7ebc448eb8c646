import itertools

import numpy as np
import xxhash

from tidemark.llm import simhash as S


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    rows = list(fps)
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if (x ^ y).bit_count() <= 2:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d, _ in rows}


def test_trie_finds_every_pair_in_budget():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    rows = {int(b) for b in base}
    for b in base:
        for _ in range(30):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(k)
            rows.add(x)
    fp = np.array(sorted(rows), np.uint64)
    i, j = S.trie_links(np.zeros(len(fp), np.int64), fp, 2)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if (int(fp[a]) ^ int(fp[b])).bit_count() <= 2}
    assert got == want and len(i) == len(got)


def test_groups_match_brute_force(spark):
    from tests.llm.fixtures import docs

    df = docs(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in S.simhash_groups(df).collect()}
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    parts = brute_components(fps)
    assert got == {(d, f, parts[d]) for d, f in fps}
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, c in parts.items() if d == c}


def test_edges(spark):
    schema = "doc_id long, text string, fp long, component_id string"
    df = spark.createDataFrame([(5, None, 1, "a"), (3, " ", 1, "b"), (7, "one two", 2, "c"), (7, "one two", 2, "c"), (None, "ONE two", 3, None)], schema)
    got = sorted((r.doc_id or 0, r.component_id) for r in S.simhash_groups(df).collect())
    assert got == [(0, 7), (3, 3), (5, 3), (7, 7), (7, 7)]
    assert sorted(r.doc_id or 0 for r in S.drop_near_duplicates(df).collect()) == [0, 3, 7]
    assert S.simhash_groups(df.limit(0)).collect() == []


def test_unlike_rows_of_a_doc_id_stay(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (2, c), (2, c), (None, c)], "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in S.drop_near_duplicates(df).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (2, c), (None, c)], key=str)


def test_roots_of_long_fingerprints_equal_brute_force():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (12, 2), dtype=np.uint64)
    rows = set()
    for b in base:
        for _ in range(40):
            x = b.copy()
            for k in rng.integers(0, 128, rng.integers(0, 9)):
                x[k // 64] ^= np.uint64(1) << np.uint64(k % 64)
            rows.add((int(rng.integers(0, 2)), *map(int, x)))
    rows = sorted(rows)
    group, words = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], np.uint64)
    for budget in (3, 6, 44):
        near = (np.bitwise_count(words[:, None] ^ words[None]).sum(2) <= budget) & (group[:, None] == group[None])
        assert (S.trie_roots(group, words, budget) == S.find_roots(len(rows), *np.nonzero(near))).all()
