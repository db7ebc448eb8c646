import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tests.llm.fixtures import docs
from tidemark.llm import token_files as T
from tidemark.llm.common import new_path


def test_segment_gives_any_id_back():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 5), (511, 256), (512, 70000), (5000, 1 << 31)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        ids[: n // 2] >>= 4
        ends = np.sort(rng.integers(0, n + 1, 4))
        ends[-1] = n
        s = T.Segment(T.write_segment(np.arange(4), ends, ids))
        assert len(s) == n and s.slice(0, n).tolist() == ids.tolist()
        for i in rng.integers(0, n, 50) if n else []:
            assert s.id(int(i)) == ids[i]
        for _ in range(30):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert s.slice(a, b).tolist() == ids[a:b].tolist()
        assert [s.document(k).tolist() for k in range(4)] == [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


def test_files_read_back_in_order(spark):
    path = P.path("word_bpe_49k.json")
    df = docs(spark).unionByName(spark.createDataFrame([(4, "again", "en", "s", 1), (None, "no id", "en", "s", 1)], docs(spark).schema)).repartition(3)
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    tokenizer = Tokenizer.from_file(path)
    want, start = [], 0
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    out = new_path(spark, "tokens")
    T.write_token_files(df, out, path, segment_bytes=2000)
    got = sorted(map(tuple, T.read_token_files(spark, out).collect()), key=lambda r: r[1])
    assert got == want
    short = T.read_token_files(spark, out, with_ids=False)
    assert sorted(map(tuple, short.collect()), key=lambda r: r[1]) == [w[:4] for w in want]
    out = new_path(spark, "tokens")
    T.write_token_files(df.limit(0), out, path)
    assert T.read_token_files(spark, out).collect() == []


def test_any_id_of_the_set_by_a_few_bytes(spark):
    out, path = new_path(spark, "tokens"), P.path("word_bpe_49k.json")
    df = docs(spark).drop("lang").withColumnsRenamed({"source": "part", "n_chars": "file"}).repartition(3)  # clashing names
    T.write_token_files(df, out, path, segment_bytes=4000, file_bytes=9000)
    ids = [x for r in T.read_token_files(spark, out).orderBy("start").collect() for x in r.ids]
    files = T.TokenFiles(spark, out)
    assert len(files) == len(ids) and T.token_index(spark, out).select("file").distinct().count() > 2
    rng = np.random.default_rng(5)
    for i in [0, len(ids) - 1, *rng.integers(0, len(ids), 8).tolist()]:
        files.bytes_read = 0
        assert files.token(i) == ids[i] and files.bytes_read < 300
    for _ in range(4):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert files.slice(a, b).tolist() == ids[a:b]
    for i in (-1, len(ids)):
        with pytest.raises(IndexError):
            files.token(i)


def test_a_very_long_text(spark):
    out, path = new_path(spark, "tokens"), P.path("word_bpe_49k.json")
    long = "some words " * 50_000
    T.write_token_files(spark.createDataFrame([(2, long), (1, "x")], "doc_id long, text string"), out, path, segment_bytes=1000)
    got = {r.doc_id: (r.start, r.n_tokens) for r in T.read_token_files(spark, out, with_ids=False).collect()}
    assert got == {1: (0, 2), 2: (2, 100_001)}
