"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A vector of integers is a sparse row: its non-zero components are postings (row, weight) under their position, the term.
Queries in blocks meet candidates in groups, one tile a pair. A task holds a tile's queries, reads its candidates
in blocks, turns each into postings lists by term, and for every query adds weight * posting into a dense array of scores, term
after term. The k best of the array are selected by partition and merged with the k best so far; Spark merges the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import prepare, stage, trim
from graphloom.llm.vectors import as_long, flat, integers, largest, whole

BLOCK = 16_384  # rows of a block of candidates, at most
BLOCK_TERMS = 2 << 20  # components of a block, at most (or one row)
QUERY_BYTES = 8 << 20  # of a tile's queries, on average at most
GROUP = 1 << 18  # candidates of a tile, on average at most: what a lost executor has to do again


def postings(values: np.ndarray, lengths: np.ndarray, kind: type) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    """term -> (rows, weights) of the non-zero components; a list with more than half of all rows is kept as (None, all weights)."""
    n = len(lengths)
    row = np.repeat(np.arange(n), lengths)
    term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = np.flatnonzero(values)
    order = some[np.argsort(term[some], kind="stable")]
    terms, first = np.unique(term[order], return_index=True)
    lists = {}
    for t, at in zip(terms.tolist(), np.split(order, first[1:]), strict=True):
        rows, weights = row[at], values[at].astype(kind)
        if 2 * len(rows) > n:
            every = np.zeros(n, kind)
            every[rows] = weights
            rows, weights = None, every
        lists[t] = (rows, weights)
    return lists


def accumulate(terms: list[int], weights: list[int], lists: dict, score: np.ndarray, room: np.ndarray) -> None:
    """Add a query's weighted postings lists into the scores, term after term. room: an array like score, for products."""
    score[:] = 0
    for t, w in zip(terms, weights, strict=True):
        if (found := lists.get(t)) is None:
            continue
        rows, weight = found
        if rows is None:
            np.multiply(weight, w, out=room)
            score += room
        else:
            score[rows] += weight * w  # a row is in a list once


def best(score: np.ndarray, k: int) -> np.ndarray:
    """The positions of the k highest scores in falling order, ties to the smaller position."""
    at = np.arange(len(score))
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > least)
        at = np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])
    return at[np.lexsort((at, ~score[at]))]


class _Tile:
    """A tile's queries with their k best so far, and the candidates that wait to be a block."""

    def __init__(self, k: int):
        self.k, self.queries, self.waiting, self.rows, self.terms, self.top = k, [], [], 0, 0, 1

    def ask(self, node: np.ndarray, vec_id: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> None:
        self.top = max(self.top, largest(values))
        for n, i, v in zip(node.tolist(), vec_id.tolist(), np.split(values, np.cumsum(lengths)[:-1]), strict=True):
            some = np.flatnonzero(v)
            none = np.zeros(0, np.int64)
            self.queries.append([n, i, some.astype(np.int32), v[some].copy(), none, none])

    def add(self, *block: np.ndarray) -> None:
        self.waiting.append([x.copy() for x in block])
        self.rows += len(block[3])
        self.terms += len(block[2])
        if self.rows >= BLOCK or self.terms >= BLOCK_TERMS:
            self.close()

    def close(self) -> None:
        """Score the waiting block, whose rows come in the order of their ids, for every query."""
        if not self.waiting or not self.queries:
            self.waiting, self.rows, self.terms = [], 0, 0
            return
        node, vec_id, values, lengths = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.rows, self.terms = [], 0, 0
        kind = whole(self.top * largest(values) * max(1, int(lengths.max())))
        lists = postings(values, lengths, kind)
        score, room = np.zeros(len(node), kind), np.zeros(len(node), kind)
        for q in self.queries:
            accumulate(q[2].tolist(), q[3].tolist(), lists, score, room)
            scores = as_long(score) if kind is object else score
            at = best(scores, self.k + 1)
            at = at[node[at] != q[0]][: self.k]  # every row but the query's own
            ids, sums = np.concatenate([q[4], vec_id[at]]), np.concatenate([q[5], scores[at].astype(np.int64)])
            order = np.lexsort((ids, ~sums))[: self.k]
            q[4], q[5] = ids[order], sums[order]

    def results(self) -> Iterator[pa.RecordBatch]:
        self.close()
        for lo in range(0, len(self.queries), 4096):
            some = self.queries[lo : lo + 4096]
            times = [len(q[4]) for q in some]
            columns = [np.repeat(np.array([q[c] for q in some], np.int64), times) for c in (0, 1)] + [np.concatenate([q[c] for q in some]) for c in (4, 5)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "query_id", "vec_id", "score"])


def _scores(k: int):
    """mapInArrow over partitions sorted by tile, queries first: (block, grp, side, node, vec_id, vec) -> (node, query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, _Tile(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            block, group, side, node, vec_id = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            cut = np.flatnonzero((block[1:] != block[:-1]) | (group[1:] != group[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(block)], strict=True):
                if (block[lo], group[lo]) != key:
                    yield from tile.results()
                    key, tile = (block[lo], group[lo]), _Tile(k)
                (tile.add if side[lo] else tile.ask)(node[lo:hi], vec_id[lo:hi], *flat(batch.column(5), lo, hi))
        yield from tile.results()
        trim()

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, factor: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k highest inner products of floor(factor * component) of each query with every other row, ties to the smaller vec_id.

    is_query is a condition on vec_id. Returns (query_id, rank from 1, vec_id, score); all other rows where there are fewer than k.
    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id. A component that
    one vector lacks counts as 0, so vectors of several lengths meet, and empty ones score 0. Rows with a repeated id
    are rows of their own: each is a query and a candidate for the others. Scores are exact and then cut to a long's range, components
    to it before. Other columns are ignored; an empty table gives an empty result.
    """
    spark = prepare(vectors.sparkSession)
    rows = integers(vectors, factor, vec_col, id_col).select(F.col(id_col).cast("long").alias("vec_id"), "vec").filter("vec_id is not null")
    # Numbers are given once, where the table is written.
    rows = stage(rows.select(F.monotonically_increasing_id().alias("node"), "vec_id", is_query.alias("asks"), "vec"), "integers")
    asked = F.coalesce(F.col("asks"), F.lit(False))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.when(asked, 128 + 12 * F.size("vec"))).alias("bytes"), F.count(F.when(asked, 1)).alias("queries")).first()
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    blocks = max(1, min(-(-(size.bytes or 0) // QUERY_BYTES), size.queries))
    groups = max(1, -(-size.n // GROUP), min(-(-3 * tasks // blocks), size.n // 1024))

    def dealt(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    queries = rows.filter(asked).select(dealt(blocks, 1).alias("block"), every(groups).alias("grp"), F.lit(0).alias("side"), "node", "vec_id", "vec")
    candidates = rows.select(every(blocks).alias("block"), dealt(groups, 2).alias("grp"), F.lit(1).alias("side"), "node", "vec_id", "vec")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks * groups, 20_000))
    tiles = queries.union(candidates).repartition(n, "block", "grp").sortWithinPartitions("block", "grp", "side", "vec_id", "node")
    found = tiles.mapInArrow(_scores(k), "node long, query_id long, vec_id long, score long")
    order = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 50, k: int = 5, factor: int = 256) -> str:
    return f"""
    with kept as materialized (
        select row_number() over () as node, vec_id,
            list_transform(embedding, lambda x: floor({factor} * cast(x as double))) as v
        from embeddings
        where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (
        select q.node, q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
        from kept q join kept c on q.vec_id % {every} = 0 and q.node <> c.node),
    ranked as (select *, cast(row_number() over (partition by node order by score desc, vec_id) as integer) as rank from scored)
    select query_id, rank, vec_id, score from ranked where rank <= {k}"""
