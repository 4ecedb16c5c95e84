"""op13 against all products, and its cases."""

import math
import random

import numpy as np
import pytest

from rallyframe.llm import max_score

KIND = "vec_id long, embedding array<double>, score string"


def brute(rows, k=5, every=50, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j or 0) for n, (j, v) in enumerate(kept) if n != at]
        out += [(i, rank, None if missing else j, -s) for rank, (s, missing, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], KIND)
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in max_score.top_k(df, **settings).collect()), key=str)


def rows_of(n, seed, length=12, spread=1.0, zeros=0.0):
    rng = random.Random(seed)
    return [(i, [0.0 if rng.random() < zeros else rng.gauss(0, spread) for _ in range(length)]) for i in range(n)]


@pytest.mark.parametrize("zeros", [0.0, 0.7, 0.97])
def test_equals_all_products(spark, zeros):
    rows = rows_of(700, 5, zeros=zeros)
    assert run(spark, rows, every=10, shard_rows=128, block=16) == brute(rows, every=10)


def test_ties_go_to_the_smaller_vec_id(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(200)]
    assert run(spark, rows, every=20, shard_rows=64) == brute(rows, every=20)


def test_few_candidates_negative_scores_and_no_terms(spark):
    rows = [(0, [1.0, 1.0]), (1, [-1.0, -2.0]), (2, [-1.0, -1.0]), (50, [0.0, 0.0]), (100, [])]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [3.0, 1.0]), (1, None), (2, [math.nan, 1.0]), (3, [math.inf, 1.0]), (4, [None, 1.0]), (-50, [1.0]), (5, [0.5, 0.5, 7.0]), (6, [9e9, 1.0])]
    assert run(spark, rows) == brute([r for r in rows if r[0] != 6])


def test_one_very_common_vector(spark):
    rows = rows_of(300, 8) + [(1000 + i, [1.0] * 12) for i in range(300)]
    assert run(spark, rows, shard_rows=100) == brute(rows)


def test_empty_table_and_no_query(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_weak_terms_are_not_traversed():
    """A shard with one strong component: others' postings are never touched in full."""
    values = np.ones((1000, 6), np.int64)
    values[:10, 0] = 1000
    shard = max_score.Shard(np.arange(1000), np.arange(1000), values)

    class Once(dict):
        seen = set()

        def __getitem__(self, key):
            at, sizes = super().__getitem__(key)
            return Noted(at, key), sizes

    class Noted(np.ndarray):
        def __new__(cls, at, key):
            out = np.asarray(at).view(cls)
            out.key = key
            return out

        def __array_finalize__(self, other):
            self.key = getattr(other, "key", None)

    shard.postings = Once(shard.postings)
    found, scores = shard.search(-1, np.array([10, 1, 1, 1, 1, 1]), 5)
    assert sorted(found.tolist()) == [0, 1, 2, 3, 4] and set(scores.tolist()) == {10005}
