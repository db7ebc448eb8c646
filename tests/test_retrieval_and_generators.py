from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.retrieval.models import EchoChat, HashingEmbedder, Patient, Vectorizer, answer, chunk_texts, embed, search, split_text
from tidemark.session import new_path
from tidemark.sources import generators as G

AS_OF = datetime(2024, 3, 1, 10, 30)


def test_pieces_fit_and_join_to_the_text():
    text = "One. Two words here.\n\nA second part\nwith lines. " + "x" * 95
    for size in (10, 20, 47, 1000):
        parts = split_text(text, size)
        assert all(len(p) <= size for p in parts) and "".join(parts) == text
    assert split_text(None) == [] == split_text("")
    assert split_text("aa bb cc dd", 6, overlap=3)[1].startswith("bb ")


def test_only_missing_rows_are_embedded_and_search_finds_them(spark):
    rows = [(1, "cable broken at the charger"), (2, "screen is dark"), (3, "payment failed twice"), (4, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    v = Vectorizer(new_path(spark, "v"), "id", "text", HashingEmbedder(256), size=40)
    v.run(df.where("id < 3"))
    assert {r.id for r in v.pending(df).collect()} == {3, 4}
    v.run(df)
    stored = v.stored(df)
    assert sorted(r.id for r in stored.collect()) == [1, 2, 3]
    found = search(stored, "broken cable", v.model, 2)
    assert found.first().id == 1
    told = answer(found, "chunk", ["distance", "id"], "Sum up.", "What broke?", EchoChat())
    assert told.startswith("Sum up.\nWhat broke?\ncable broken")


def test_changed_and_deleted_rows_are_replaced(spark):
    schema = "id long, text string"
    rows = {1: "one two. three four. five six seven", 2: "a b. c d", 3: "same as ever", 4: None, 5: "", 6: "will be empty"}
    v = Vectorizer(new_path(spark, "v"), "id", "text", HashingEmbedder(32), size=12)
    df = lambda: spark.createDataFrame(sorted(rows.items()), schema)
    kinds = lambda: {r.id: r.change for r in v.changes(df()).collect()}
    assert kinds() == dict.fromkeys(rows, "new")

    def check():
        got = {}
        for r in v.stored(df()).orderBy("id", "chunk_seq").collect():
            got[r.id] = got.get(r.id, "") + r.chunk
            assert np.allclose(r.embedding, v.model.embed([r.chunk])[0])
        assert got == {k: t for k, t in rows.items() if t}

    v.run(df())
    check()
    assert kinds() == {4: "new", 5: "new"}  # nothing is stored of them
    rows |= {1: "another text", 4: "no longer null", 6: "", 7: "new"}
    del rows[2]
    assert kinds() == {1: "changed", 2: "gone", 4: "new", 5: "new", 6: "changed", 7: "new"}
    v.run(df())
    check()
    assert kinds() == {5: "new", 6: "new"}
    rows[2] = "back again"
    v.run(df())
    check()
    v.compact(df())
    check()
    assert kinds() == {5: "new", 6: "new"} and len(v._runs(spark)) == 1


class Flaky:
    """Fails every third call, refuses large batches."""

    dimensions = 16

    def __init__(self):
        self.calls, self.inner = 0, HashingEmbedder(16)

    def _fails(self):
        self.calls += 1
        if self.calls % 3 == 0:
            raise ConnectionError("busy")

    def embed(self, texts):
        self._fails()
        assert 0 < len(texts) <= 5
        return self.inner.embed(texts)

    def complete(self, system, user):
        self._fails()
        return f"{system}|{user}"


def test_a_model_that_fails_is_asked_again_in_batches(spark):
    model = Patient(Flaky(), batch=5, attempts=2, pause=0.0)
    texts = [f"text {k}" for k in range(23)]
    assert np.array_equal(model.embed(texts), HashingEmbedder(16).embed(texts)) and model.model.calls == 7
    assert model.embed([]).shape == (0, 16)
    assert [model.complete("s", str(k)) for k in range(4)] == [f"s|{k}" for k in range(4)]
    with pytest.raises(ConnectionError):
        impatient = Patient(Flaky(), attempts=1)
        for _ in range(3):
            impatient.complete("s", "u")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").coalesce(1)
    got = {r.id: r.e for r in df.select("id", embed(F.col("text"), Patient(Flaky(), batch=5, pause=0.0)).alias("e")).collect()}
    assert all(np.allclose(got[k], HashingEmbedder(16).embed([t])[0]) for k, t in enumerate(texts))


def test_generated_tables_keep_their_shapes(spark):
    w = G.wearable_readings(spark, AS_OF, days=1)
    r = w.agg(F.min("heart_rate").alias("a"), F.max("heart_rate").alias("b"), F.min("spo2").alias("c"), F.max("body_temperature").alias("d"), F.countDistinct("activity_level").alias("e")).first()
    assert (r.a, r.b, r.e) == (60, 100, 4) and r.c >= 95 and r.d < 37.2
    o = G.oee_readings(spark, AS_OF, days=1)
    bad = o.where("runtime_seconds < 0 or abs(availability - runtime_seconds / planned_time_seconds) > 1e-9 or (hour(time) between 6 and 13 and shift <> 1)")
    assert bad.count() == 0 and o.agg(F.countDistinct("shift")).first()[0] == 3
    wells = G.well_readings(spark, AS_OF)
    r = wells.agg(F.count("*").alias("n"), F.min("wellhead_pressure").alias("p"), F.min("downhole_pressure").alias("d"), F.collect_set("choke_size").alias("c"), F.max("time").alias("t")).first()
    assert r.n == 172_800 and r.p >= 8000 and r.d >= 12_000 and sorted(r.c) == [16.0 + 4 * k for k in range(8)] and r.t == datetime(2024, 2, 29, 23, 45)
    stages = G.frac_stages(spark, AS_OF)
    out = {x.job_id: x.n for x in stages.where("stage_result = 'Screenout'").groupBy("job_id").agg(F.count("*").alias("n")).collect()}
    assert out == {1: 1, 2: 1, 3: 6, 4: 1, 5: 6} and sorted(x.id for x in stages.collect()) == list(range(1, 126))
    t = G.frac_telemetry(stages)
    assert t.where("treating_pressure_psi < 500 or slurry_rate_bpm < 0").count() == 0 and t.count() == 179_328
    assert t.agg(F.max("proppant_concentration_ppg")).first()[0] < 2.1 and t.where("proppant_concentration_ppg > 2").count() > 0
    c = G.climate_readings(spark, AS_OF, days=1)
    assert c.where("humidity < 20 or humidity > 80").count() == 0 and c.count() == 28_800
    assert G.room_readings(spark, AS_OF, days=1, step=timedelta(hours=1)).count() == 100
    again = G.wearable_readings(spark, AS_OF, days=1)
    assert again.agg(F.sum("heart_rate")).first() == w.agg(F.sum("heart_rate")).first()


def test_texts_are_embedded_some_at_a_time(spark):
    class Watching(HashingEmbedder):
        def embed(self, texts):
            if sum(map(len, texts)) > 3 << 20:
                raise MemoryError("too many texts at once")
            return super().embed(texts)

    texts = [("word%d " % k) * 40_000 for k in range(30)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r.id: list(r.v) for r in df.select("id", embed(F.col("text"), Watching(8)).alias("v")).collect()}
    want = HashingEmbedder(8).embed([t or "" for t in texts])
    assert all(np.allclose(got[k], want[k]) for k in range(len(texts))) and len(got) == len(texts)
    pieces = chunk_texts(df, "id", "text", 50_000, model=Watching(8)).groupBy("id").agg(F.sum(F.length("chunk")).alias("n")).collect()
    assert {r.id: r.n for r in pieces} == {k: len(t) for k, t in enumerate(texts) if t}
