import itertools
import random
from pathlib import Path

import numpy as np

import corpus_pipeline as P
from tests.llm.fixtures import SCHEMA
from tidemark.llm import near as N
from tidemark.llm.common import shared_dir


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similarity(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def edited(rng, text, least):
    """A copy with single words replaced as long as the similarity stays at least so high."""
    words, k = text.split(), 0
    while True:
        new = list(words)
        new[rng.randrange(len(new))] = f"new{rng.randrange(10**6)}"
        if similarity(text, " ".join(new)) < least:
            return " ".join(words)
        words, k = new, k + 1


def rows(rng):
    bodies = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(80, 300))) for _ in range(60)]
    out = [(k, t) for k, t in enumerate(bodies)]
    out += [(1000 + k, edited(rng, t, 0.8)) for k, t in enumerate(bodies)]
    out += [(2000 + k, edited(rng, t, 0.6)) for k, t in enumerate(bodies[:30])]  # near the threshold, on either side
    out += [(3000 + k, edited(rng, bodies[0], 0.9)) for k in range(25)]  # one large group, linked in part
    return out + [(4000, None), (4001, " "), (4002, "one two"), (4003, "One  TWO"), (4004, "one two three")]


def test_the_stage_equals_brute_force_on_edited_copies(spark):
    data = rows(random.Random(5))
    root = {d: d for d, _ in data}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(data, 2):
        if similarity(x, y) >= 0.8:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in data], SCHEMA).repartition(3)
    kept = P.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    got = sorted(r.doc_id for r in kept.collect())
    assert got == sorted(d for d in root if find(d) == d) and not set(got) & set(range(1000, 1060))


def test_shingle_sets_and_bands_follow_similarity():
    rng = random.Random(3)
    missed = 0
    for _ in range(200):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(200))
        copy = edited(rng, text, 0.8)
        a, b = (N.shingle_set(N.plain_words(t)) for t in (text, copy))
        assert abs(len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist())) - similarity(text, copy)) < 1e-12
        missed += not (N.band_keys(a) == N.band_keys(b)).any()
    assert not missed


def test_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.drop_near_copies(df).collect() == []


def test_rows_are_told_apart_by_their_text(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(f"w{rng.randrange(3000)}" for _ in range(120)) for _ in range(3))
    near = edited(rng, a, 0.9)
    data = [(1, a), (2, near), (2, b), (2, c), (None, near.upper()), (None, c + " more"), (None, "alone"), (None, "alone"), (3, "own"), (3, "own")]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in data], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in N.drop_near_copies(df).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (2, c), (None, "alone"), (3, "own")], key=str)


def counted(monkeypatch):
    pairs = []
    real = N.alike

    def alike(asked, texts):
        pairs.append(asked.count())
        return real(asked, texts)

    monkeypatch.setattr(N, "alike", alike)
    return pairs


def test_documents_of_a_template_cost_a_few_pairs_each(spark, monkeypatch):
    rng = random.Random(8)
    n, shared = 300, [f"t{k}" for k in range(82)]
    texts = []
    for k in range(n):  # 78 of 103 shingles in common: a similarity of about 0.65
        texts.append(" ".join([*shared, *(f"own{k}x{j}" for j in range(25))]))
    assert 0.59 < similarity(texts[0], texts[1]) < 0.7
    texts += [edited(rng, t, 0.85) for t in texts[:20]]
    pairs = counted(monkeypatch)
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in N.drop_near_copies(df).collect()) == list(range(n))
    assert sum(pairs) < 20 * len(texts)


def test_a_large_group_of_near_copies_costs_a_few_pairs_each(spark, monkeypatch):
    rng = random.Random(9)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(150))
    texts = [edited(rng, base, 0.84) for _ in range(250)]  # two copies are often less alike than the base is with either
    pairs = counted(monkeypatch)
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = sorted(r.doc_id for r in N.drop_near_copies(df).collect())
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == [k for k in range(len(texts)) if find(k) == k]
    assert sum(pairs) < len(texts) * len(texts) / 4


def test_columns_of_any_name_come_through(spark):
    rng = random.Random(2)
    a = " ".join(f"w{rng.randrange(3000)}" for _ in range(120))
    names = ["_tm_id", "_tm_none", "_tm_raw", "id", "none", "raw", "row", "node", "key", "keys", "size", "c", "component", "first"]
    data = [(1, a, *([7] * len(names))), (2, edited(rng, a, 0.9), *([8] * len(names))), (3, "else", *([9] * len(names)))]
    df = spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = N.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [data[0], data[2]]


def test_very_long_texts_are_processed_whole(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    twin = [w if rng.random() > 0.005 else "x" for w in words]
    half = words[:150_000] + [f"v{rng.randrange(10**6)}" for _ in range(150_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(twin)), (3, " ".join(half))], "doc_id long, text string")
    assert sorted(r.doc_id for r in N.drop_near_copies(df).collect()) == [1, 3]


def test_candidates_come_from_tries_of_fingerprints(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 40, 200]))) for _ in range(40)]
    sets = [N.shingle_set(N.plain_words(t)) for t in base]
    for own in sets[:5]:
        bits = np.unpackbits(N.mix(own ^ N._SALTS[0]).view(np.uint8).reshape(-1, 8), axis=1).astype(int)
        assert (N.votes(own)[:64] == (2 * bits - 1).sum(0)).all()
    texts = base + [edited(rng, t, 0.8) for t in base]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = N.signatures(df)
    told = {r.doc_id: r for r in rows.collect()}
    bands = {}
    for r in N.trie_bands(rows.dropDuplicates(["node"])).collect():
        bands.setdefault(r.key, set()).add(r.node)
    far = lambda x, y: sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x, y))
    for k in range(40):
        a, b = told[k], told[40 + k]
        assert a.node == b.node or far(a.fp, b.fp) <= N.BUDGET
        assert a.node == b.node or any({a.node, b.node} <= band for band in bands.values())
    fps = {r.node: r.fp for r in told.values()}
    for band in bands.values():  # nobody is in a band without a near one
        assert all(any(far(fps[x], fps[y]) <= N.BUDGET for y in band - {x}) for x in band)


def test_keys_grow_with_the_log_of_the_nodes():
    assert [N.places_for(n) for n in (0, 500_000, 2_000_000, 13_000_000)] == [64, 64, 128, 512]
    assert [len(N.turns(n)) for n in (64, 128, 512)] == [56, 72, 104]
    assert N.whole_key(np.array([5], np.uint64)) < 0 <= N.band_keys(np.arange(1, 9, dtype=np.uint64)).min()


def nodes_of(spark, fps):
    signed = lambda x: [int(v) for v in np.array(x, np.uint64).view(np.int64)]
    return spark.createDataFrame([(k, 50, signed(fp), [5]) for k, fp in enumerate(fps)], "node long, size int, fp array<long>, keys array<long>")


def flipped(rng, fp, bits):
    fp = list(fp)
    for word, n in enumerate(bits):
        for b in rng.sample(range(64), n):
            fp[word] ^= 1 << b
    return fp


def test_unlike_nodes_of_a_crowded_key_are_in_no_band(spark):
    rng = random.Random(7)
    fps = [[rng.getrandbits(64) for _ in range(8)] for _ in range(1200)]
    first = np.array([fp[:2] for fp in fps], np.uint64)
    close = sum(int((np.bitwise_count(first[k + 1 :] ^ first[k]).sum(1) <= 44).sum()) for k in range(len(fps)))
    assert close > 50  # pairs that the first 128 bits don't tell apart
    fps += [flipped(rng, fps[0], [10] * 8), [*flipped(rng, fps[1][:2], [10] * 2), *(rng.getrandbits(64) for _ in range(6))]]
    got = {r.node: r for r in N.trie_bands(nodes_of(spark, fps)).collect()}
    assert set(got) == {0, 1200} and {(r.hub, r.size) for r in got.values()} == {(0, 50)} and got[1200].bits == 80


def test_only_what_is_kept_stays_in_the_shared_folder(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(100)) for _ in range(20)]
    texts += [edited(rng, t, 0.85) for t in texts]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    folder = Path(shared_dir(spark).removeprefix("file://"))
    folder.mkdir(parents=True, exist_ok=True)
    before = {p.name for p in folder.iterdir()}
    kept = N.drop_near_copies(df)
    assert [name.split("-")[0] for name in {p.name for p in folder.iterdir()} - before] == ["kept"]
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
