import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import variants as V


def brute_counts(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        up, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            up, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, up + (x != y))
    return d[-1]


def brute(rows):
    n = brute_counts(rows)
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and edits(a, b) == 1:
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), c, len(near[w]), n[form[w]] if form[w] else -1) for w, c in n.items())


def found(df, **kw):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in V.spelling_variants(df, **kw).collect())


def texts(seed=4, n=300, letters="abcdé"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "ababab", "bababa", "aaaaa"]
    rows = []
    for k in range(n):
        words = []
        for _ in range(rng.randint(1, 60)):
            w = base[min(rng.randrange(len(base)), rng.randrange(len(base)))]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice(letters), rng.choice(letters) + w[at]]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((k, rng.choice([" ", "-", "1", " ×"]).join(words)))
    return rows


@pytest.mark.parametrize("crowd", [3, 4096])
def test_equals_brute_force(spark, crowd):
    rows = texts()
    want = brute(rows)
    assert len(want) > 200 and any(r[1] and r[1] != r[2] for r in want)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), crowd=crowd) == want


def test_edges(spark):
    schema = "doc_id long, text string, word string, n int, key string"
    long = "mañana manana Ñandúes " * 20_000
    rows = [(None, "hello hello, HELLO hellos hellos hellos"), (None, "hello hello, HELLO hellos hellos hellos"), (1, None), (2, ""), (3, " 1 2 "), (4, long), (4, "Grüße GRüße grüße grüsse grüsse grüsse")]
    df = spark.createDataFrame([(*r, "w", 1, None) for r in rows], schema)
    want = brute(rows)
    assert want and found(df) == want
    assert found(df.limit(0)) == [] and found(df.where("doc_id = 3")) == []


def test_the_index_keeps_all_pairs_above_the_bound():
    for start, end in ((0, 3), (2, 4), (4, 6), (3, 4)):
        inside = ["".join(p) for p in itertools.product("ab", repeat=end - start)]
        words = ["abbaba"[:start] + x + "abbaba"[end:] for x in inside]
        index = V.PositionalIndex(words, start, end)
        for w in words:
            assert [words[k] for k in index.near(w, False)] == [x for x in words if edits(w, x) == 1]
        for x in itertools.product("ab", repeat=end - start - 1):
            w = "abbaba"[:start] + "".join(x) + "abbaba"[end:]
            assert [words[k] for k in index.near(w, True)] == [x for x in words if edits(w, x) == 1 and start <= V.first_difference(w, x) < end]

def test_one_edit_is_exact():
    rng = random.Random(3)
    for _ in range(3_000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in "xy")
        assert (V.first_difference(a, b) >= 0) == (edits(a, b) == 1)


def test_roots_follow_long_chains(spark):
    steps = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)] + [("x", "w20")], "word string, to string")
    assert {r.to for r in V.roots(steps).collect()} == {"w37"}
