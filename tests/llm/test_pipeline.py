import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_decontaminate import planted
from tidemark.llm.common import new_path


def test_stages_follow_each_other_and_keep_clean_documents(spark):
    df, benchmark, leaks = planted(spark)
    path = new_path(spark, "tables")
    copy = spark.createDataFrame([(5000 + r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.limit(40).collect()], df.schema)
    df.unionByName(copy).repartition(3).write.parquet(f"{path}/documents.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        ids.append({r.doc_id for r in docs.collect()})
    assert len(ids[0]) == 300 and not ids[1] & set(range(5000, 6000)) and ids[3] <= ids[2] <= ids[1] <= ids[0]
    assert not ids[3] & {d for d in leaks if d % 4 < 2}
    packed = P.run(spark, path).collect()
    assert {r.doc_id for r in packed} == ids[3] and all(r.offset + r.length <= 1024 for r in packed)


def tables(spark, docs, benchmark, labels):
    path = new_path(spark, "tables")
    for name, df in (("documents", docs), ("benchmark", benchmark), ("labels", labels)):
        df.write.parquet(f"{path}/{name}.parquet")
    return path


def test_nulls_ties_repeats_long_texts_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _tm_text string, data string, score string, key string"
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["river", "stone", "cloud", "paper", "light", "green", "under", "seven"]) + rng.choice(["s", "y", "er", ""]) + str(rng.randrange(90)) for _ in range(n))
    one, two, long, question = prose(60), prose(70), prose(30_000), prose(12)
    rows = [(3, one), (1, one), (1, one), (None, two), (7, None), (8, ""), (9, long), (None, None), (11, two + " more words here"), (12, prose(40) + " " + question), (13, "short"), (None, prose(50))]
    df = spark.createDataFrame([(d, t, None, "s", None if t is None else len(t), "a", "b", "c", "d") for d, t in rows], schema)
    path = tables(spark, df.repartition(3), spark.createDataFrame([(1, question), (2, None), (None, "")], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == df.columns, name
        kept.append(sorted(((r.doc_id, (r.text or "")[:40]) for r in docs.collect()), key=str))
    assert len(kept[0]) == len(rows)  # without labels every score is one half
    assert [d for d, t in kept[1] if t == one[:40]] == [1] and sum(t == two[:40] for _, t in kept[1]) == 1
    assert 12 in {d for d, _ in kept[2]} and 12 not in {d for d, _ in kept[3]} and {9, 13} <= {d for d, _ in kept[3]}
    packed = P.run(spark, path).collect()
    assert sorted((r.doc_id for r in packed if r.piece == 0), key=str) == sorted((d for d, _ in kept[3]), key=str)
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(long, add_special_tokens=False).ids
    assert sum(r.length for r in packed if r.doc_id == 9) == len(ids) + 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    path = tables(spark, empty, spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert P.run(spark, path).collect() == []
