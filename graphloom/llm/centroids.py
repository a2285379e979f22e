"""Clustering around integer centroids by weighted deduplication.

Identical quantised vectors are grouped into one with a multiplicity. Lloyd's rounds run over the distinct vectors, whose
weighted integer sums and weights give exact centroids, and the assignments are joined back to the vec_ids at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop, prepare, stage, trim
from graphloom.llm.vectors import LONG, as_long, distance_type, flat, grouped_sums, integers, squared

ROWS = 4096  # vectors whose distances are held at once


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each row; ties go to the smaller number."""
    kind = distance_type(x, centroids)
    d = squared(x.astype(kind), centroids.astype(kind))
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of up to ROWS rows, and their vectors as a matrix."""

    def cut(held):
        t = pa.Table.from_batches(held).combine_chunks()
        return t, flat(t.column(column).chunk(0))[0].reshape(-1, dim)

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ROWS:
            yield cut(held)
            held, rows = [], 0
    if held:
        yield cut(held)


def _sums(centroids: np.ndarray):
    """mapInArrow: (n, vec) -> (cluster, n, sums): a row for each cluster that a task's vectors are nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = {}, {}
        for t, x in _blocks(batches, 1, centroids.shape[1]):
            at, _ = nearest(x, centroids)
            for c, w, s in zip(*grouped_sums(x, at, t.column(0).to_numpy()), strict=True):
                n[c] = n.get(c, 0) + int(w)
                total[c] = [a + b for a, b in zip(total.get(c, [0] * len(s)), s, strict=True)]
        keys = sorted(n)
        sums = pa.array([total[c] for c in keys], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([n[c] for c in keys], pa.int64()), sums], ["cluster", "n", "sums"])
        trim()

    return run


def _assigned(centroids: np.ndarray):
    """mapInArrow: (k1, k2, n, vec) -> the same and (cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, x in _blocks(batches, 3, centroids.shape[1]):
            at, d = nearest(x, centroids)
            t = t.append_column("cluster", pa.array(at.astype(np.int32))).append_column("distance", pa.array(as_long(d)))
            yield from t.to_batches(1024)
        trim()

    return run


def updated(centroids: np.ndarray, rows: list) -> np.ndarray:
    """The centroids with those of `rows` (cluster, j, n, total) replaced by floor(total / n); the others stay."""
    out = centroids.copy()
    for r in rows:
        out[r.cluster, r.j] = int(r.total) // r.n
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, factor: int = 256, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Clusters of floor(factor * component) around k centroids, exact in integers.

    Kept are vectors with `dim` components, none of them null or non-finite. Centroids 0, 1, ... start as the k kept vectors with the
    smallest sha256 of "<seed>:<vec_id>" (ties, of repeated ids: by the vector). Returns for every kept row (vec_id, cluster, distance (squared), cluster_inertia,
    inertia, centroid_sha256). Fewer than k kept vectors with an id make as many centroids; rows with a null id are clustered but
    start none, and without any id there are no centroids and no rows. Repeated ids are rows of their own. Components, distances and inertias
    are cut to a long's range. Other columns are ignored; an empty table gives an empty result.
    """
    spark = prepare(vectors.sparkSession)
    rows = integers(vectors, factor, vec_col, id_col).filter(F.size("vec") == dim)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.xxhash64("vec").alias("k1"), F.xxhash64("vec", F.lit(7)).alias("k2"), "vec")
    first = rows.filter("vec_id is not null").select("vec", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h")).orderBy("h", "vec").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r.vec for r in first], np.int64)
    distinct = stage(rows.groupBy("k1", "k2", "vec").agg(F.count("*").alias("n")).select("k1", "k2", "n", "vec"), "distinct")
    for _ in range(rounds):
        parts = distinct.select("n", "vec").mapInArrow(_sums(centroids), "cluster int, n long, sums array<decimal(38,0)>")
        parts = parts.select("cluster", "n", F.posexplode("sums").alias("j", "part"))
        centroids = updated(centroids, parts.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect())
    found = stage(distinct.mapInArrow(_assigned(centroids), "k1 long, k2 long, n long, vec array<long>, cluster int, distance long"), "assigned")
    drop(distinct)
    # One row a centroid: small enough for the driver and for a broadcast.
    spread = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).alias("total")).collect()}
    named = [(c, min(t, LONG), min(sum(spread.values()), LONG), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, t in spread.items()]
    named = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # Two hashes stand for a vector as long as no two distinct vectors share them.
    key = ["k1", "k2"] + ["vec"] * bool(found.groupBy("k1", "k2").count().filter("count > 1").limit(1).count())
    out = rows.select("vec_id", *key).join(found.select(*key, "cluster", "distance"), key)
    return out.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, dim: int = 64, factor: int = 256, seed: str = "2") -> str:
    """The same in SQL: every round joins the kept vectors with all centroids."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    near{r} as materialized (
        select v.node, min(cast(list_dot_product(v.v, v.v) - 2 * list_dot_product(v.v, c.c) + list_dot_product(c.c, c.c) as bigint) * {k} + c.cluster) as best
        from kept v cross join centroids{r} c group by v.node)""")
        if r < rounds:
            steps.append(f"""
    sums{r} as (
        select cluster, j, sum(cast(x as hugeint)) as s, count(*) as n
        from (select n.best % {k} as cluster, generate_subscripts(v.v, 1) as j, unnest(v.v) as x from near{r} n join kept v using (node)) group by cluster, j),
    means{r} as (select cluster, list(cast((s - ((s % n) + n) % n) // n as double) order by j) as c from sums{r} group by cluster),
    centroids{r + 1} as materialized (select o.cluster, coalesce(m.c, o.c) as c from centroids{r} o left join means{r} m using (cluster))""")
    return f"""
    with kept as materialized (
        select row_number() over () as node, vec_id, list_transform(embedding, lambda x: floor({factor} * cast(x as double))) as v
        from embeddings
        where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    centroids0 as materialized (
        select row_number() over (order by sha256('{seed}:' || cast(vec_id as varchar)), v) - 1 as cluster, v as c
        from kept where vec_id is not null qualify cluster < {k}),{",".join(steps)},
    assigned as (select v.vec_id, cast(n.best % {k} as integer) as cluster, n.best // {k} as distance from near{rounds} n join kept v using (node))
    select a.vec_id, a.cluster, a.distance,
        cast(sum(a.distance) over (partition by a.cluster) as bigint) as cluster_inertia,
        cast(sum(a.distance) over () as bigint) as inertia,
        sha256(array_to_string(list_transform(c.c, lambda x: cast(cast(x as bigint) as varchar)), ',')) as centroid_sha256
    from assigned a join centroids{rounds} c using (cluster)"""
