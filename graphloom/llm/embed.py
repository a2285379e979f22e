"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with one scale each, and the norm of what that loses is kept. Blocks
of vectors of one length meet in tiles; a tile's integer product gives every cosine up to a bound made of
the two losses, and only pairs that may reach the threshold are computed again in double precision. Where a
length has more vectors than a block holds, blocks are cells around pivots, and a vector goes only to tiles
of cells whose cone it may reach: with a link to a member, its angle to the pivot is at most the
cell's radius and the threshold's angle. Data without clusters leave every tile to be formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, prepare, stage, trim

BLOCK = 2048  # rows of a tile's side, at least
SIDE_BYTES = 16 << 20  # of a tile's side, in double precision, at most (or one row)
PIVOTS = 1024  # of one length, at most: more only prune better
PIVOT_BYTES = 16 << 20  # of the pivots of all lengths; lengths beyond it are not pruned
STRIP = 512  # rows of a tile's product held at once
EXACT = 1024  # int8 products that float32 sums exactly: 1024 * 127 * 127 is under 2^24
SLACK = 1e-9  # covers the rounding of the bounds themselves


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, loss, size): unit ~ scale * q with q int8; loss = |unit - scale * q|, size = |scale * q|."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None])
    near = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(unit - near, axis=1) + SLACK, np.linalg.norm(near, axis=1) + SLACK


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The exact integer products of int8 rows, as floats: sums of at most EXACT terms in float32, more of them in float64."""
    if left.shape[1] <= EXACT:
        return left.astype(np.float32) @ right.astype(np.float32).T
    out = np.zeros((len(left), len(right)))
    for k in range(0, left.shape[1], EXACT):
        out += left[:, k : k + EXACT].astype(np.float32) @ right[:, k : k + EXACT].astype(np.float32).T
    return out


def tile_links(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j, recomputed): pairs of rows with cosine >= threshold in double precision; j > i if both sides are the same block.

    A pair's cosine is at most product * scales + the two losses. Most pairs fail already where the strip's largest
    scale and losses stand for each row's own; for the rest the bound of the pair decides.
    """
    left, right = scaled(left), scaled(right)
    lu, ru = (x / np.linalg.norm(x, axis=1)[:, None] for x in (left, right))
    lq, ls, le, ln = quantise(lu)
    rq, rs, re, rn = quantise(ru)
    del lu, ru
    order = np.argsort(ls)  # rows of a strip have like scales
    goal = threshold - SLACK
    found_i, found_j, again = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for at in range(0, len(left), STRIP):
        rows = order[at : at + STRIP]
        dot = products(lq[rows], rq)
        room = goal - le[rows].max() * (rn + re) - ln[rows].max() * re
        least = room / (np.where(room > 0, ls[rows].max(), ls[rows].min()) * rs)
        i, j = np.nonzero(dot >= np.nextafter(least.astype(dot.dtype), dot.dtype.type(-np.inf)))
        part = dot[i, j].astype(np.float64)
        i = rows[i]
        ok = part * ls[i] * rs[j] + le[i] * (rn[j] + re[j]) + ln[i] * re[j] >= goal
        if same:
            ok &= j > i
        i, j = i[ok], j[ok]
        again += len(i)
        for k in range(0, len(i), 1 << 14):
            a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            x, y = left[a], right[b]
            cos = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            ok = cos >= threshold
            found_i.append(a[ok])
            found_j.append(b[ok])
    return np.concatenate(found_i), np.concatenate(found_j), again


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that links lead to, for each of n positions, by repeated minima."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _matrix(vec: pa.ListArray, rows: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of some rows, all of length dim."""
    flat, at = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
    return flat[at[rows][:, None] + np.arange(dim)]


def _columns(batch: pa.RecordBatch, *at: int) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in at]


def _tiles(threshold: float):
    """mapInArrow over partitions sorted by tile: (dim, p, q, side, node, copies, vec) -> (node, links, root)."""

    def close(key, held) -> pa.RecordBatch | None:
        side, node, copies = (np.concatenate([h[k] for h in held]) for k in range(3))
        vec = np.concatenate([h[3] for h in held]).astype(np.float64)
        held.clear()
        same = key[1] == key[2]
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return None
        i, j, _ = tile_links(vec[left], vec[right], threshold, same)
        if not len(i):
            return None
        i, j = left[i], right[j]
        links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        root = node[_roots(len(node), i, j)]
        hit = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, p, q, side, node, copies = _columns(batch, *range(6))
            new = np.flatnonzero((dim[1:] != dim[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            for lo, hi in zip([0, *new], [*new, len(dim)], strict=True):
                own = (dim[lo], p[lo], q[lo])
                if own != key:
                    if held and (out := close(key, held)) is not None:
                        yield out
                    key, held = own, []
                held.append((side[lo:hi].copy(), node[lo:hi].copy(), copies[lo:hi].copy(), _matrix(batch.column(6), np.arange(lo, hi), dim[lo])))
        if held and (out := close(key, held)) is not None:
            yield out
        trim()

    return run


def _angles(vec: pa.ListArray, rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = scaled(_matrix(vec, rows, pivots.shape[1]).astype(np.float64))
    return np.arccos(np.clip((x / np.linalg.norm(x, axis=1)[:, None]) @ pivots.T, -1, 1))


def _cells(pivots: dict[int, np.ndarray]):
    """mapInArrow: (dim, vec) -> (dim, cell, angle): the nearest pivot and the angle to it; cell 0 where there are no pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (dim,) = _columns(batch, 0)
            cell, angle = np.zeros(len(dim), np.int32), np.zeros(len(dim))
            for d in pivots.keys() & set(dim.tolist()):
                rows = np.flatnonzero(dim == d)
                far = _angles(batch.column(1), rows, pivots[d])
                cell[rows] = far.argmin(1)
                angle[rows] = far.min(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array(angle)], ["dim", "cell", "angle"])

    return run


def _dealt(pivots: dict[int, np.ndarray], parts: dict[int, np.ndarray], radius: dict[int, np.ndarray], reach: float):
    """mapInArrow: (dim, node, copies, vec) -> (dim, p, q, side, node, copies, vec), a row for each tile that a vector takes part in.

    Block (cell << 20 | part) p meets q >= p; a cell's vectors are dealt to its parts by their node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, node = _columns(batch, 0, 1)
            for d in sorted(set(dim.tolist())):
                rows = np.flatnonzero(dim == d)
                if d in pivots:
                    far = _angles(batch.column(3), rows, pivots[d])
                    cell, own = far.argmin(1), far.min(1)
                    # A partner in cell q is as near to q's pivot as to any other.
                    meets = (far <= radius[d] + reach) & (far - own[:, None] <= 2 * reach)
                    meets[np.arange(len(rows)), cell] = True
                else:
                    cell, meets = np.zeros(len(rows), np.int64), np.ones((len(rows), 1), bool)
                mixed = node[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                block = cell.astype(np.int64) << 20 | ((mixed >> np.uint64(33)) % parts[d][cell].astype(np.uint64)).astype(np.int64)
                at, other = np.nonzero(meets)
                times = parts[d][other]
                at, other = np.repeat(at, times), np.repeat(other.astype(np.int64) << 20, times)
                other |= np.arange(len(other)) - np.repeat(np.cumsum(times) - times, times)
                mine = block[at]
                for lo in range(0, len(at), 4096):
                    a, b = mine[lo : lo + 4096], other[lo : lo + 4096]
                    take = pa.array(rows[at[lo : lo + 4096]])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array((a > b).astype(np.int32)), *[batch.column(k).take(take) for k in (1, 2, 3)]],
                        ["dim", "p", "q", "side", "node", "copies", "vec"],
                    )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Classes of vectors linked by a cosine of `threshold` or more in double precision.

    Returns (vec_id, n_links, component_id, kept) for every row; n_links counts other rows linked
    directly, equal rows too. Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing (0 links, their own class), and so do rows with a null id; vectors of different
    lengths do not link, and any number of lengths may occur. Equal vectors (told by 128 bits of hashes) are
    compared once, and no pair is sampled or capped. Other columns are ignored; an empty table gives an empty result.
    """
    spark = prepare(vectors.sparkSession)
    single = "array<float>" in vectors.schema[vec_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"))
    usable = F.expr(
        "vec_id is not null and coalesce(size(vec), 0) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(vec, x -> x <> 0)"
    )
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    # The hashes may tell 0.0 from -0.0; such vectors are two nodes then, which link by their cosine.
    good = rows.filter("ok").select("vec_id", F.xxhash64("vec").alias("k1"), F.xxhash64("vec", F.lit(7)).alias("k2"), "vec")
    distinct = good.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.first("vec").alias("vec"))
    # Numbers are given once, where the table is written.
    distinct = stage(distinct.select(F.monotonically_increasing_id().alias("node"), "*", F.size("vec").alias("dim")), "distinct")
    links = stage(_links(distinct, threshold), "links")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = stage(
        distinct.select("node", "k1", "k2", "copies", "low").join(counted, "node", "left").join(comp, "node", "left")
        .select("k1", "k2", F.expr("coalesce(links, 0) + copies - 1").alias("n_links"), F.coalesce("comp", "node").alias("comp"), "low"), "named")
    # Written first, so that the join below reads two plain exchanges, of which a hot class can be split.
    first = stage(named.groupBy("comp").agg(F.min("low").alias("component_id")), "first")
    named = stage(named.join(first, "comp").select("k1", "k2", "n_links", "component_id"), "classes")
    out = good.select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(distinct: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) of all tiles. The driver sees counts by length and cell, and the pivots."""
    spark = distinct.sparkSession
    counts = {r["dim"]: r["count"] for r in distinct.groupBy("dim").count().collect()}
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    # Blocks as large as memory allows cost the least shuffle, as long as there are some tiles for every core.
    even = -(-sum(counts.values()) // int(np.ceil(np.sqrt(6 * tasks))))
    block = {d: max(1, min(SIDE_BYTES // (8 * d), max(BLOCK, even))) for d in counts}
    pivots, room = {}, PIVOT_BYTES
    for d, n in sorted(counts.items(), key=lambda x: -x[1]):
        k = min(PIVOTS, -(-n // block[d]), room // (8 * d))
        if k > 1:
            chosen = distinct.filter(F.col("dim") == d).filter(F.expr(f"pmod(xxhash64(k1), 1000000007) < {2 * k / n * 1000000007}"))
            chosen = np.array([r.vec for r in chosen.select("vec").limit(4 * k).collect()][:k], np.float64)
            if len(chosen):
                chosen = scaled(chosen)
                pivots[d] = chosen / np.linalg.norm(chosen, axis=1)[:, None]
                room -= pivots[d].nbytes
    found = distinct.select("dim", "vec").mapInArrow(_cells(pivots), "dim int, cell int, angle double") if pivots else distinct.select("dim", F.lit(0).alias("cell"), F.lit(0.0).alias("angle"))
    parts = {d: np.zeros(len(pivots.get(d, "1")), np.int64) for d in counts}
    radius = {d: np.full(len(x), -np.inf) for d, x in parts.items()}
    for r in found.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():
        parts[r.dim][r.cell] = -(-r.n // block[r.dim])
        radius[r.dim][r.cell] = r.radius
    tiles = sum(int(x.sum()) * (int(x.sum()) + 1) // 2 for x in parts.values())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(3 * tiles, 20_000))
    dealt = distinct.select("dim", "node", "copies", "vec").mapInArrow(
        _dealt(pivots, parts, radius, float(np.arccos(threshold)) + 1e-6), f"dim int, p long, q long, side int, node long, copies long, vec {distinct.schema['vec'].dataType.simpleString()}"
    )
    return dealt.repartition(n, "dim", "p", "q").sortWithinPartitions("dim", "p", "q").mapInArrow(_tiles(threshold), "node long, links long, root long")
