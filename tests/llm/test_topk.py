import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import topk
from graphloom.llm.vectors import LONG

INF, NAN = float("inf"), float("nan")


def brute(rows, every=50, k=5, factor=256):
    """All pairs in Python's integers."""
    cut = lambda x: min(max(x, -LONG - 1), LONG)
    kept = [(i, [cut(math.floor(factor * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(kept):
        if i % every == 0:
            found = sorted((-cut(sum(x * y for x, y in zip(v, w))), j) for b, (j, w) in enumerate(kept) if b != a)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def search(spark, rows, kind="array<double>", **more):
    t = spark.createDataFrame([(i, v, 7, 8, 9) for i, v in rows], f"vec_id long, embedding {kind}, node int, vec int, side int")
    return sorted(map(tuple, topk.search(t, F.col("vec_id") % 50 == 0, **more).collect()))


def test_postings_and_scores():
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (40, 9)) * (rng.random((40, 9)) < 0.4)
    lists = topk.postings(x.ravel(), np.full(40, 9), np.int64)
    assert any(rows is None for rows, _ in topk.postings(np.ones(6, np.int64), np.full(3, 2), np.int64).values())
    score, room = np.zeros(40, np.int64), np.zeros(40, np.int64)
    for q in x:
        some = np.flatnonzero(q)
        topk.accumulate(some.tolist(), q[some].tolist(), lists, score, room)
        assert (score == x @ q).all()
        for k in (1, 5, 40, 99):
            assert topk.best(score, k).tolist() == sorted(range(40), key=lambda i: (-score[i], i))[:k]


@pytest.mark.parametrize(("block", "query_bytes"), [(16_384, 8 << 20), (7, 4096)])
def test_whole_table(spark, sf, monkeypatch, block, query_bytes):
    """Also with blocks of 7 candidates, queries in several blocks and candidates in several groups."""
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(topk, "GROUP", 16 * block)
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in t.collect()]
    assert sorted(map(tuple, topk.search(t, F.col("vec_id") % 50 == 0).collect())) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, -0.5, 0.0]), (50, [1.0, -0.5, 0.0]), (50, [0.25]), (1, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 2.0]), (3, []), (100, []), (4, None), (150, None), (5, [None, 1.0]),
            (200, [NAN]), (6, [INF, 1.0]), (None, [1.0]), (-50, [-1.0, 0.001]), (7, [0.0] * 40), (8, [-1e-9] * 40)]
    want = brute(rows)
    assert search(spark, rows) == want and len(want) == 25
    assert search(spark, rows, "array<float>") == brute([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert search(spark, rows[:1]) == [] and search(spark, []) == [] and search(spark, rows[3:5]) == []
    assert [r[2] for r in search(spark, rows[:1] + rows[3:5])] == [1, 2]  # fewer than k; ties to the smaller id


def test_scores_beyond_fast_types(spark):
    rows = [(0, [1e6, -1e7, 3.0]), (50, [1e15, 1e14, -1e15]), (100, [1e300, -1e300, 1.0]), (1, [2e9, 2e9, 2e9]), (2, [-1e16, 1.0, 1.0]), (3, [1e9, 1e9, 1e9])]
    assert search(spark, rows) == brute(rows)


def test_hot_vector(spark):
    """A third of all rows are one vector: all their ties are told by the id, and a query has its k."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 1.0] if i % 3 else rng.normal(size=2).tolist()) for i in range(600)]
    assert search(spark, rows) == brute(rows)
