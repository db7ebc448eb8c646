import hashlib
import random

from tidemark.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\e", "\\ls>", "<s", "<<s>>", "[[INST]]", "a\nb", "", None, "ünï 日本 🙂", "<\\s>", "\\\\bINST]", "[/INST]</s><s>"]


def brute(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{t[3]}\n{t[5]}\n" for t in turns)
        loss = "".join(t[5] for t in turns if t[3] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha(told), len(loss), sha(loss))
    return out


def test_digests_read_back_nasty_texts(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "[INST]</s>", None]), rng.choice(NASTY)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(3, 0, "assistant", "again"), (3, 0, "assistant", "again"), (None, None, "user", "x"), (None, 2, "assistant", "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(4)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.chat_digests(df).collect()}
    assert got == brute(rows)
    assert C.chat_digests(df.limit(0)).collect() == []


def test_mask_covers_the_string_and_marks_are_only_the_template(spark):
    df = spark.createDataFrame([(1, k, "assistant", t, "") for k, t in enumerate(NASTY)], SCHEMA)
    r = C.render(C.fold_events(C.events_of(df))).first()
    assert sum(x.chars for x in r["mask"]) == len(r.formatted)
    n = len(NASTY)
    assert [r.formatted.count(x) for x in (C.BEGIN, C.HEAD, C.BODY, C.END)] == [n] * 4


def fold(events):
    messages = {}
    for _, event, m, role, text in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        if event == "regenerate":
            messages = {k: v for k, v in messages.items() if k <= m}
        old = messages.setdefault(m, [None, ""])
        old[0] = old[0] or role
        old[1] = (old[1] if event == "delta" else "") + (text or "")
    return {(m, v[0], v[1]) for m, v in messages.items()}


def test_fold_of_deltas_edits_and_regenerations(spark):
    rng = random.Random(9)
    events, want = [], set()
    for c in range(40):
        own = [(s, rng.choice(["delta", "delta", "delta", "message", "edit", "regenerate"]), rng.randint(0, 4), "user", rng.choice(["a", "b ", None, "cd"])) for s in range(rng.randint(1, 25))]
        events += [(c, *e) for e in own]
        want |= {(c, *x) for x in fold(own)}
    rng.shuffle(events)
    df = spark.createDataFrame(events, "conv_id long, seq long, event string, message long, role string, text string").repartition(5)
    assert {tuple(r) for r in C.fold_events(df).collect()} == want


def test_digests_need_a_right_fold(spark, monkeypatch):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {t} of {c} " * 5) for c in range(4) for t in range(7)] + [(9, 0, "user", "long \u00e9 " * 200_000)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    want = brute(rows)
    digests = lambda: {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.chat_digests(df).collect()}
    kinds = {r.event: r["count"] for r in C.streamed_events_of(df).groupBy("event").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and kinds["delta"] > 2 * len(rows)
    assert digests() == want
    right = C.fold_events
    for gone in ("edit", "regenerate", "delta"):
        monkeypatch.setattr(C, "fold_events", lambda events, gone=gone: right(events.where(f"event <> '{gone}'")))
        assert all(digests()[c] != want[c] for c in range(4))
