import numpy as np
import pytest

from graphloom.llm import embed


def brute(rows, threshold=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = len(ok)
    links, up = [0] * n, list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[a] += 1
                links[b] += 1
                up[max(root(a), root(b))] = min(root(a), root(b))
    comp = {}
    for k in range(n):
        r = root(k)
        comp[r] = min(comp.get(r, ok[k][0]), ok[k][0])
    out = [(ok[k][0], links[k], comp[root(k)]) for k in range(n)]
    left = list(rows)
    for i, v in ok:
        left.remove(next(x for x in left if x[0] == i and x[1] is not None and len(x[1]) == len(v) and np.allclose(np.array(x[1], float), v)))
    return sorted(out + [(i, 0, i) for i, _ in left], key=str)


def test_bound_is_rigorous():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64))
    y = x + rng.normal(size=x.shape) * 0.33
    i, j, again = embed.tile_links(x, y, 0.95, False)
    u, v = (z / np.linalg.norm(z, axis=1)[:, None] for z in (x, y))
    assert {*zip(i.tolist(), j.tolist())} == {*map(tuple, np.argwhere(u @ v.T >= 0.95).tolist())}
    assert len(i) <= again < 300 * 300 // 20


def test_bound_holds_in_long_vectors():
    """Flat vectors of 1,536 components, whose integer products pass 2^24, at the threshold of their own cosine."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        x = rng.choice([-1.0, 1.0], (2, 1536))
        x[1, 40:] = x[0, 40:]
        cos = float(x[0] @ x[1] / (np.sqrt(x[0] @ x[0]) * np.sqrt(x[1] @ x[1])))
        i, j, _ = embed.tile_links(x[:1], x[1:], cos, False)
        assert len(i) == 1
    big = rng.normal(size=(3, 8)) * np.array([[1e-200], [1.0], [1e200]])
    big[1], big[2] = big[0] * 1e200, big[0] * 1e300
    assert len(embed.tile_links(big, big, 0.999, True)[0]) == 3


def test_many_lengths(spark):
    rows = [(100 * d + k, [1.0 + k] * d) for d in range(1, 71) for k in range(2)]
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 140 and all(r.n_links == 1 and r.component_id == r.vec_id // 100 * 100 for r in got)


def test_clusters_are_pruned_without_loss(spark, monkeypatch):
    """Tight clusters over several cells and parts: fewer rows are dealt than tiles would take, and no link is lost."""
    monkeypatch.setattr(embed, "BLOCK", 16)
    monkeypatch.setattr(embed, "SIDE_BYTES", 16 * 8 * 32)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(12, 32))
    x = centre[rng.integers(0, 12, 300)] + rng.normal(size=(300, 32)) * 0.15
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("block", [2048, 40])
def test_whole_table(spark, sf, monkeypatch, block):
    monkeypatch.setattr(embed, "BLOCK", block)
    monkeypatch.setattr(embed, "SIDE_BYTES", block * 8 * 64)
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in t.collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embed.near_duplicates(t).collect()), key=str)
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]),
            (9, []), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0, 0.001]), (12, [1.0, 0.001])]
    t = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, node int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embed.near_duplicates(t).collect()), key=str)
    assert got == sorted([(1, 4, 1), (2, 4, 1), (3, 4, 1), (12, 4, 1), (12, 4, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (None, 0, None), (10, 0, 10), (11, 0, 11)], key=str)
    assert embed.near_duplicates(t.limit(0)).count() == 0
