import functools
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.fixtures import docs, texts
from tidemark.llm import decontaminate as D
from tidemark.llm.words import unpack


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for k, y in enumerate(b, 1):
            old, row[k] = row[k], old + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_common_length_equals_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(-1, 6) for _ in range(rng.randint(0, 90))] for _ in range(2))
        a = [max(x, 0) for x in a]
        assert D.common_length(a, b) == lcs(a, b)


def planted(spark):
    rng = random.Random(4)
    syllables = ["ka", "lo", "mi", "ru", "se", "to", "vu", "xe", "zi", "qa"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(3))
    common = ["the", "of", "and", "is", "in", "to"]
    items = [(k, " ".join(rng.choice(common) if rng.random() < 0.4 else word() for _ in range(rng.randint(12, 60)))) for k in range(60)]
    clean = [(k, " ".join(rng.choice(common) if rng.random() < 0.5 else w for w in t.split())) for k, t in enumerate(texts(200, 8))]
    leaks = {}
    rows = list(clean)
    for k in range(60):
        w = items[k][1].split()
        kind = k % 4
        if kind == 1:
            w = [x.upper() + "," for x in w]
        elif kind == 2:
            w = [x for x in w if rng.random() > 0.2]
        elif kind == 3:
            w = [word() if rng.random() < 0.2 else x for x in w]
        body = clean[k][1].split()
        at = rng.randrange(len(body) + 1)
        body[at:at] = w
        rows.append((1000 + k, " ".join(body)))
        leaks[1000 + k] = k
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs(spark).schema)
    return df, spark.createDataFrame(items, "item_id long, text string"), leaks


def test_planted_passages_are_found_and_clean_documents_left(spark):
    df, benchmark, leaks = planted(spark)
    rows = {r.doc_id: r for r in D.contamination(df.repartition(3), benchmark).collect()}
    found = {d: r.item_id for d, r in rows.items() if r.contaminated}
    assert set(found) <= set(leaks)
    assert all(leaks[d] == i for d, i in found.items())
    assert len(found) >= 0.95 * len(leaks) and all(d in found for d in leaks if d % 4 < 2)
    small = {r.doc_id: r.contaminated for r in D.contamination(df, benchmark, block=7, rank=16).collect()}
    assert sum(small[d] for d in leaks) >= 0.95 * len(leaks) and not any(small[d] for d in small if d not in leaks)
    kept = D.drop_contaminated(df, benchmark)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(rows) - set(found)


def test_candidates_hold_what_brute_force_accepts(spark):
    df, benchmark, _ = planted(spark)
    items = D.Items.of([(r.item_id, r.text) for r in benchmark.collect()], 6)
    items.weigh(*D._frequencies(df.select("text"), items))
    got = {(r.doc_id, r.item_id) for r in D.leaks(df, benchmark).collect()}
    want = set()
    for r in df.collect():
        codes = [items.vocabulary.get(D.plain(w), -1) for w in r.text.split()]
        for k, own in enumerate(items.words):
            for a in range(0, max(1, len(codes)), 8):
                part = codes[a : a + len(own) + 8]
                if len(items.answers[k] & set(part)) >= 0.5 * len(items.answers[k]) and D.common_length(own, part) >= 0.5 * len(own):
                    want.add((r.doc_id, items.ids[k]))
    assert len(got & want) >= 0.9 * len(want)


def test_edges(spark):
    schema = "doc_id long, text string, item_id string, word string"
    text = "alpha beta gamma delta epsilon zeta eta theta"
    df = spark.createDataFrame([(1, None, "", ""), (None, text, "", ""), (2, text, "", None), (2, "clean", "", ""), (3, "nothing here at all but words", "", "")], schema)
    some = spark.createDataFrame([(5, text), (6, None), (7, "too short"), (5, text), (None, "")], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.contaminated, r.item_id) for r in D.contamination(df, some).collect()), key=str)
    assert got == [(0, True, 5), (1, False, None), (2, True, 5), (2, True, 5), (3, False, None)]
    assert D.contamination(df.limit(0), some).collect() == []
    assert not any(r.contaminated for r in D.contamination(df, some.limit(0)).collect())


def test_a_long_item_does_not_hide_short_ones(spark):
    df, benchmark, _ = planted(spark)
    rng = random.Random(9)
    own = {r.item_id: r.text.split() for r in benchmark.collect()}
    filler = [w for t in own.values() for w in t]
    long = " ".join(rng.choice(filler) if rng.random() < 0.5 else f"long{rng.randrange(3000)}" for _ in range(2000))
    rows = []
    for k in range(0, 60, 2):  # verbatim copies amid words of the long item
        body = [rng.choice(long.split()) for _ in range(3000)]
        body[1500:1500] = own[k]
        rows.append((2000 + k, " ".join(body), "en", "s", 0))
    rows.append((3000, "before " + long + " after", "en", "s", 0))
    both = benchmark.unionByName(spark.createDataFrame([(900, long)], benchmark.schema))
    found = {(r.doc_id, r.item_id) for r in D.leaks(df.unionByName(spark.createDataFrame(rows, df.schema)), both).collect()}
    assert {(2000 + k, k) for k in range(0, 60, 2)} | {(3000, 900)} <= found


def test_items_under_six_words_match_as_exact_sequences(spark):
    some = spark.createDataFrame([(1, "Grand total?"), (2, "one"), (3, " ,. "), (4, "alpha beta gamma delta epsilon")], "item_id long, text string")
    texts = ["the grand, -- total is", "grand the total", "Total grand", "say ONE.", "someone", "alpha beta gamma delta epsilons", "x alpha beta gamma delta epsilon", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(20, "end with grand"), (21, "total first")], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id, r.item_id) for r in D.leaks(df, some).collect()) == [(0, 1), (3, 2), (6, 4)]


def test_only_rows_with_the_leaking_text_are_dropped(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    clean = ["clean words of one", "clean words of two", None]
    df = spark.createDataFrame([(d, t) for d in (None, 2) for t in [text, f"so {text}", *clean]] + [(3, text)], "doc_id long, text string")
    kept = D.drop_contaminated(df.repartition(3), spark.createDataFrame([(5, text)], "item_id long, text string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str((d, t)) for d in (None, 2) for t in clean)


def test_thousands_of_items_in_a_bounded_block(spark):
    rng = random.Random(12)
    zipf = lambda n: [f"w{int(30_000 ** rng.random())}" for _ in range(n)]
    items = [(k, " ".join(zipf(24))) for k in range(4096)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(D._blocks(benchmark, 4096, 8000))
    assert [r for b in blocks for r in b] == items and 1 < len(blocks)
    assert all(len(D.Items.of(b, 6).vocabulary) <= 8000 for b in blocks)
    rows = [(k, " ".join([*zipf(150), *items[k * 20][1].split(), *zipf(150)])) for k in range(200)] + [(1000 + k, " ".join(zipf(300))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {(r.doc_id, r.item_id) for r in D.leaks(df, benchmark).collect()}
    assert len({(k, k * 20) for k in range(200)} & found) >= 0.95 * 200
    assert not any(d >= 1000 for d, _ in found)


def test_the_basis_comes_from_all_documents(spark):
    df, benchmark, _ = planted(spark)
    parts = [df.withColumn("doc_id", F.col("doc_id") + 10_000 * k) for k in range(9)]  # 2,340 documents
    many = functools.reduce(type(df).unionByName, parts).repartition(3)
    items = D.Items.of([(r.item_id, r.text) for r in benchmark.collect()], 6)
    coded, _ = D.code_texts(many, items)
    items.weigh(*D._frequencies(coded, items))
    size = len(items.vocabulary)
    want = np.zeros((size, size))
    for r in df.collect():
        codes = np.array([-2 if not D.plain(w) else items.vocabulary.get(D.plain(w), -1) for w in r.text.split()], np.int64)
        row, word, weight = D._tfidf(codes, np.array([0, len(codes)]), items)
        a = np.zeros((-(-len(codes) // D.WINDOW), size))
        a[row, word] = weight
        want += 9 * a.T @ a
    for dense, held, strip in ((2048, 1 << 22, 1 << 23), (5, 200, 200 * size), (0, 10, 1000 * size)):
        products, _, words = D.word_products(coded, items, dense, held, strip, 3)
        got = np.zeros((size, size))
        for r in products.collect():
            some = unpack(r.data)
            got.reshape(-1)[some["key"] + r.part * words * size] += some["value"]
        assert words == min(strip // size, -(-size // 3)) and np.allclose(got, want, rtol=1e-4, atol=1e-4)
        q = D.fit_basis(products, words, items, 32, rounds=6)
        row, word, weight = items.sparse()
        own = np.zeros((len(items.ids), size))
        own[row, word] = weight
        whole = want + own.T @ own
        assert np.trace(q.T @ whole @ q) > 0.97 * np.linalg.eigvalsh(whole)[-32:].sum()
