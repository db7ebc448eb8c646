import random

import numpy as np
import pytest

from tidemark.llm import exchange as X


@pytest.mark.parametrize("bits", [64, 56])
def test_cuts_part_the_keys_in_the_same_places_for_all(bits):
    rng = random.Random(5)
    top = (1 << bits) - 1
    for ranges in (1, 7, 1000, (1 << 31) - 1):
        where = {}
        for n in (0, 1, 3, 500):
            keys = np.unique(np.array([rng.randint(0, top) for _ in range(n)] + [0, top] * (n > 1), np.uint64))
            number, cuts = X.cut(keys, ranges, bits)
            assert len(number) <= max(1, min(ranges, len(keys))) and cuts[0] == 0 and cuts[-1] == len(keys)
            assert number == sorted(set(number)) and 0 <= number[0] and number[-1] < ranges
            for r, i, j in zip(number, cuts, cuts[1:]):
                assert all((k * ranges >> bits) - r in (0, 1) for k in map(int, keys[i:j]))  # by 32 bits, not all
                where.setdefault(r, []).extend(map(int, keys[i:j]))
        ends = [(min(k), max(k)) for _, k in sorted(where.items()) if k]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def asked(spark, chunks, ranges, per_chunk=20):
    def question(row):
        rng = np.random.default_rng(row["chunk"])
        n = per_chunk if row["chunk"] % 5 else 0
        return np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)), np.ones(n, np.int64)

    return X.ask(spark.range(chunks).withColumnRenamed("id", "chunk"), question, ranges)


def test_rows_grow_with_the_input_and_not_with_its_square(spark):
    rows = [asked(spark, n, 50 * n).count() for n in (40, 160)]
    assert rows[0] <= 40 * 20 and rows[1] <= 4.5 * rows[0]


def test_chunks_without_keys_are_answered_with_nothing(spark):
    def total(keys, values, first):
        return np.repeat(np.add.reduceat(values, first) if len(first) else values, np.diff(np.r_[first, len(keys)])), [len(first)]

    chunks = spark.range(20).withColumnRenamed("id", "chunk")
    told = X.answer(asked(spark, 20, 5000), total, ("n",))
    got = {r.chunk: X.unpacked(r.answers)[0] for r in X.with_answers(chunks, told).collect()}
    assert {k: len(v) for k, v in got.items()} == {k: 20 if k % 5 else 0 for k in range(20)}
    assert sum(r.n or 0 for r in told.select("n").collect()) == 16 * 20
