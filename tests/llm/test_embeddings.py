import math

import numpy as np

from tidemark.llm import embeddings as E


def vectors(n=260, d=24, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    for k in range(n):
        kind = k % 5
        if kind == 1:
            base[k] = base[rng.integers(0, k)]
        elif kind == 2:
            base[k] = base[rng.integers(0, k)] * rng.uniform(0.5, 2) + rng.standard_normal(d) * rng.uniform(0.02, 0.4)
        elif kind == 3 and k > 150:
            base[k] = base[7] + rng.standard_normal(d) * 0.2
    return base.astype(np.float32)


def brute(rows, threshold=0.95):
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[a].add(b)
                    near[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        c = min(ids) if ids else None
        out.append((i, len(near[k]), c, i is not None and i == c))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, cls string")


def test_links_match_brute_force(spark, monkeypatch):
    rows = [(k * 2 + 5, v.tolist()) for k, v in enumerate(vectors())]
    rows += [(900, None), (901, [0.0] * 24), (902, [math.nan] * 24), (903, [None] + [1.0] * 23), (904, [math.inf] * 24), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (5, rows[7][1]), (None, rows[3][1]), (908, [1e-30] * 24), (909, [1e30] * 24)]
    want = brute(rows)
    df = frame(spark, rows).repartition(3)
    assert sorted(map(tuple, E.embedding_groups(df).collect()), key=str) == want
    wide = df.selectExpr("vec_id", "cast(embedding as array<double>) embedding", "1 weight", "2 d", "3 code", "4 h1")
    assert sorted(map(tuple, E.embedding_groups(wide).collect()), key=str) == want
    monkeypatch.setattr(E, "BLOCK", 5)  # crowded codes are dealt over blocks
    assert sorted(map(tuple, E.embedding_groups(df).collect()), key=str) == want
    assert E.embedding_groups(df.limit(0)).collect() == []


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + rng.standard_normal((200, 64)) * rng.uniform(0.05, 0.6, (200, 1))
    i, j = slice(0, 200), slice(200, 400)
    unit = E._unit(x)
    exact = unit[i] @ unit[j].T
    errors, ruled_out = [], []
    for seed in range(40):
        codes = E.Codes(E.encode(unit, seed))
        error = codes.estimate(i, j) - exact
        errors.append(error)
        f = codes.f[i, None]
        bound = 5 * np.sqrt((1 - f**2) / (f**2 * 63)) * np.sqrt(1 - exact**2) + 2.5 * codes.step[None, j] / f + 1e-5
        assert (np.abs(error) <= bound).all()
        maybe = codes.undecided(i, j, 0.95, 5.0)
        assert maybe[exact >= 0.95].all()
        ruled_out.append(1 - maybe[exact < 0.5].mean())
    assert abs(np.mean(np.diagonal(errors, axis1=1, axis2=2))) < 0.003
    assert abs(np.mean(errors)) < 0.003
    assert np.mean(ruled_out) > 0.99
    a, b = np.nonzero(exact > -2)
    assert (E.exactly_close(x, a, b + 200, 0.95) == (exact >= 0.95).ravel()).all()


def test_codes_of_short_and_odd_lengths():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 7, 9, 24):
        unit = E._unit(rng.standard_normal((60, d)))
        data = E.encode(unit)
        assert data.shape == (60, E.HEAD + -(-d // 8) + -(-d // 2))
        everything = slice(0, 60)
        maybe = E.Codes(data).undecided(everything, everything, 0.95, 5.0)
        assert maybe[np.triu(unit @ unit.T >= 0.95, 1)].all() and not np.tril(maybe).any()
