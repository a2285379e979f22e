import hashlib
import math

import numpy as np
import pytest

from graphloom.llm import codes
from graphloom.llm.vectors import LONG, distance_type

INF, NAN = float("inf"), float("nan")


def brute(rows, parts=4, entries=256, rounds=4, factor=1024):
    """All entries of all parts, in Python's integers; rows (vec_id, vector, label) of one length."""
    cut = lambda x: min(max(x, -LONG - 1), LONG)
    kept = [(i, [cut(math.floor(factor * x)) for x in v], b) for i, v, b in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], c)), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(first)):
                own = [v[p * width : (p + 1) * width] for (_, v, _), a in zip(kept, at) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    at = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    error = [cut(sum(d for d, _ in a)) for a in at]
    by = {}
    for (_, _, label), e in zip(kept, error):
        by[label] = by.get(label, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in a), err, cut(by[b]), digest) for (i, _, b), a, err in zip(kept, at, error)), key=str)


def compress(spark, rows, kind="array<double>", **more):
    t = spark.createDataFrame([(i, v, b, 1, 2, 3) for i, v, b in rows], f"vec_id long, embedding {kind}, label int, vec int, code int, part int")
    return sorted(map(tuple, codes.compress(t, **more).collect()), key=str)


@pytest.mark.parametrize("scale", [300, 10**8, 10**12])
def test_search_is_exact_and_skips(scale):
    """From any start the nearest entry with the smallest index, in doubles, longs and Python's integers; near starts compute fewer distances."""
    rng = np.random.default_rng(2)
    book = rng.integers(-scale, scale, (60, 4))
    book[31] = book[7]
    x = book[rng.integers(0, 60, 500)] + rng.integers(-scale // 50, scale // 50 + 1, (500, 4))
    x[:30] = (book[7] + book[8]) // 2
    kind = distance_type(x, book)
    assert kind is {300: np.float64, 10**8: np.int64, 10**12: object}[scale]
    d = ((x.astype(object)[:, None] - book.astype(object)[None]) ** 2).sum(2)
    want, least = d.argmin(1), d.min(1)
    entries = book.astype(kind)
    ready = (entries, *codes.neighbours(entries))
    found = [codes.nearest(x.astype(kind), start.astype(np.int32), *ready) for start in (rng.integers(0, 60, 500), want)]
    for entry, error, _ in found:
        assert (entry == want).all() and [int(v) for v in error] == least.tolist()
    assert found[1][2] <= found[0][2]


def test_scan_ends_at_the_radius():
    """Starting at the entry of its own cluster, a part far from the other clusters is compared with one step of entries only."""
    rng = np.random.default_rng(6)
    book = (rng.integers(-3, 4, (256, 2)) + np.repeat([[0, 0], [10_000, 0], [0, 10_000], [10_000, 10_000]], 64, axis=0)).astype(float)
    x = book[rng.integers(0, 256, 1000)] + rng.integers(-2, 3, (1000, 2))
    start = ((x[:, None] - book[None]) ** 2).sum(2).argmin(1).astype(np.int32)
    entry, _, done = codes.nearest(x, start, book, *codes.neighbours(book))
    assert (entry == start).all() and done <= 1000 * (1 + codes.STEP)


def test_whole_table(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in t.collect()]
    small = dict(entries=12, rounds=2)
    assert sorted(map(tuple, codes.compress(t, **small).collect()), key=str) == brute(rows, **small)


def test_odd_rows(spark):
    v = [[1.0, -0.001, 0.3, 0.25], [1.0, -0.001, 0.3, 0.25], [0.0] * 4, [5.0, 4.0, 3.0, 2.0], [-7.0, 4.0, 3.5, 2.0], [0.1, 0.2, 0.3, 0.4]]
    rows = [(3, v[0], 1), (3, v[1], None), (3, v[5], None), (1, v[2], 1), (2, v[3], 2), (None, v[4], None), (9, v[4], 2)]
    bad = [(0, None, 1), (4, [None, 1.0, 1.0, 1.0], 1), (5, [NAN, 1.0, 1.0, 1.0], 2), (6, [INF, 1.0, 1.0, 1.0], 2)]
    length = [(0, [1.0] * 3, 1), (0, [], 1), (0, [1.0] * 8, 5)]
    for more in (dict(), dict(entries=3), dict(entries=2, rounds=0)):
        assert compress(spark, rows + bad + length, **more) == brute(rows + bad, **more)
    assert compress(spark, []) == [] and compress(spark, bad) == [] and compress(spark, length[:2]) == [] and compress(spark, rows[5:6]) == []


def test_large_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * 10.0 ** (i % 25)).tolist(), i % 2) for i in range(60)]
    assert compress(spark, rows, entries=9, rounds=2) == brute(rows, entries=9, rounds=2)
