"""Small documents with copies, near copies, shared passages and odd texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n=120, seed=7):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["an", "er", "ti", "on", "the", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    shared = " ".join(rng.choice(vocab) for _ in range(60))
    out = []
    for k in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 160))]
        kind = k % 8
        if kind == 1 and out:
            words = out[rng.randrange(len(out))].split()
            words[rng.randrange(len(words)) :][:1] = [rng.choice(vocab)]
        elif kind == 2 and out:
            out.append(out[rng.randrange(len(out))])
            continue
        elif kind == 3:
            at = rng.randrange(len(words))
            words[at:at] = shared.split()
        elif kind == 4:
            words = [rng.choice(vocab)] * rng.randint(1, 40)
        text = " ".join(w.capitalize() if rng.random() < 0.1 else w for w in words)
        out.append(text.replace(" ", "\n", 1) if k % 5 == 0 else text)
    return out


def docs(spark, n=120, seed=7):
    rows = [(k * 3 + 1, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts(n, seed))]
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, " \n\t ", "en", "s", 4), (1003, "é ñandú  Ärger x", "es", "s", 16)]
    return spark.createDataFrame(rows, SCHEMA)
