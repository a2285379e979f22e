import hashlib
import math

import numpy as np

from graphloom.llm import centroids
from graphloom.llm.vectors import LONG

INF, NAN = float("inf"), float("nan")


def brute(rows, k=40, rounds=5, dim=64, factor=256):
    """Lloyd over all rows one by one, in Python's integers."""
    cut = lambda x: min(max(x, -LONG - 1), LONG)
    kept = [(i, [cut(math.floor(factor * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in start[:k]]
    if not c:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, a) in zip(kept, at) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    by = {j: cut(sum(cut(d) for d, a in at if a == j)) for j in range(len(c))}
    total = cut(sum(cut(d) for d, _ in at))
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, cut(d), by[j], total, digest[j]) for (i, _), (d, j) in zip(kept, at)), key=str)


def cluster(spark, rows, kind="array<double>", **more):
    t = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], f"vec_id long, embedding {kind}, n int, cluster int, vec int")
    return sorted(map(tuple, centroids.cluster(t, **more).collect()), key=str)


def test_whole_table(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in t.collect()]
    assert sorted(map(tuple, centroids.cluster(t).collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(12, 3)).tolist()
    rows = [(i, v[i % 9]) for i in range(14)] + [(2, v[10]), (2, v[11]), (None, v[3]), (None, v[9])]
    rows += [(90, None), (91, [None, 1.0, 1.0]), (92, [NAN, 0.0, 0.0]), (93, [INF, 0.0, 0.0]), (94, []), (95, [1.0] * 4)]
    for k, rounds in ((4, 3), (40, 5), (1, 1), (5, 0)):
        assert cluster(spark, rows, k=k, rounds=rounds, dim=3) == brute(rows, k=k, rounds=rounds, dim=3)
    assert cluster(spark, [], dim=3) == [] and cluster(spark, rows[18:], dim=3) == [] and cluster(spark, rows[16:18], dim=3) == []


def test_hot_vector_and_negative_means(spark):
    """A third of the rows are one vector, and a sum of -1 over 3 rows goes down to -1."""
    rng = np.random.default_rng(7)
    rows = [(i, [0.5, -0.5] if i % 3 == 0 else np.round(rng.normal(size=2), 1).tolist()) for i in range(300)]
    assert cluster(spark, rows, k=6, dim=2) == brute(rows, k=6, dim=2)
    thirds = [(1, [-1 / 256, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0])]
    got = cluster(spark, thirds, k=1, rounds=1, dim=2)
    assert {r[5] for r in got} == {hashlib.sha256(b"-1,0").hexdigest()}


def test_large_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 10.0 ** (i % 25)).tolist()) for i in range(60)]
    assert cluster(spark, rows, k=7, rounds=3, dim=4) == brute(rows, k=7, rounds=3, dim=4)


def test_shared_hashes_fall_back_to_vectors(spark, monkeypatch):
    """Where two distinct vectors share both hashes, the join compares the vectors themselves."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(centroids.F, "xxhash64", lambda *a: F.lit(5).cast("long"))
    rows = [(i, [float(i % 4), 1.0]) for i in range(30)]
    assert cluster(spark, rows, k=3, dim=2) == brute(rows, k=3, dim=2)
