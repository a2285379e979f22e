"""Joins for graphs of any size against the kernels, which hold a graph in one task."""

import numpy as np
import pytest

from graphloom.operators import algorithms as A
from graphloom.operators import large


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """The fixtures are small, and rounds are many."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def graphs(spark, seed=1):
    """Trees, rings, cliques, sparse and several-component graphs, a path, a lone node and repeated links."""
    rng = np.random.default_rng(seed)
    e = [(1, i, i + 1) for i in range(24)]
    e += [(2, i, (i + 1) % 12) for i in range(12)] + [(2, 12, 3), (2, 12, 13)]
    e += [(3, a, b) for a in range(5) for b in range(a)] + [(3, 4, 5)] + [(3, 5 + a, 5 + b) for a in range(4) for b in range(a)]
    e += [(4, int(a), int(b)) for a, b in rng.integers(0, 30, (34, 2)) if a != b]
    e += [(5, 100 + i, int(rng.integers(0, i)) + 100) for i in range(1, 16)] + [(5, 1, 2), (5, 2, 1), (5, 1, 2)]
    e += [(6, 7, None), (7, 1, 2), (8, 1, 2), (8, 9, None)]
    return spark.createDataFrame(e, "graph_id long, node long, nbr long")


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_bridges_and_forest(spark):
    e = graphs(spark)
    want = rows(A.bridges(e))
    assert rows(large.bridges(e)) == want and {r[0] for r in want} >= {1, 2, 3, 4, 5, 7}
    both = large.simple(e)
    A.checkpoints(spark)
    tree = large.spanning_forest(both)
    found = {r.graph_id: r["count"] for r in tree.groupBy("graph_id").count().collect()}
    parts = {r.graph_id: r["count"] for r in A.components(e.filter("nbr is not null")).filter("node <> component").groupBy("graph_id").count().collect()}
    assert found == parts  # one edge fewer than nodes in every component
    assert large.bridges(e.limit(0)).count() == 0


def test_hops_and_betweenness(spark):
    e = graphs(spark)
    assert rows(large.all_pairs(e)) == rows(A.all_pairs(e))
    want = rows(A.betweenness(e))
    assert rows(large.betweenness(e)) == want and rows(large.betweenness(e, blocks=3)) == want


def test_eigenvalues(spark):
    """Spaces of up to nine dimensions, which a few steps use up, and the cases that need none."""
    e = [(1, i, i + 1, 1.0 + i % 2) for i in range(7)] + [(2, a, b, 1.0) for a in range(5) for b in range(a)] + [(3, 0, i, 2.0) for i in range(1, 6)] + [(3, 3, 4, 1.0), (3, 77, None, 0.0)]
    e += [(4, 1, 2, 1.0), (4, 3, 4, 1.0), (5, 1, None, 0.0), (6, 1, None, 0.0), (6, 2, None, 0.0), (7, 1, 2, 1.0), (7, 2, 1, 3.0)]
    e = spark.createDataFrame(e, "graph_id long, node long, nbr long, w double")
    want = {r.graph_id: r.l2 for r in A.lambda2(e).collect()}
    got = {r.graph_id: r for r in large.lambda2(e, most=10).collect()}
    assert set(got) == set(want)
    for g, r in got.items():
        assert r.l2 == pytest.approx(want[g], abs=1e-6) and r.residual <= 1e-6, g


def test_large_graphs_leave_the_kernels(spark, monkeypatch):
    """With a small bound the same rows come from the joins for some graphs and from the kernels for the others."""
    e = graphs(spark)
    want = [rows(f(e)) for f in (A.bridges, A.all_pairs, A.betweenness, A.components)]
    monkeypatch.setattr(A, "LARGEST", 20)
    monkeypatch.setattr(A, "DENSE", 20)
    assert [rows(f(e)) for f in (A.bridges, A.all_pairs, A.betweenness, A.components)] == want
