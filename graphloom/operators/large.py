"""Graph algorithms over the link table alone, for graphs of any size (GA02, GA03, GA06, M05, L09).

Rounds of joins and aggregates, each written as a checkpoint; no task and no driver holds a graph. The kernels of
`algorithms` use these for the graphs that are too large for one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import checkpoints, share_code


def simple(links: DataFrame) -> DataFrame:
    """Both directions of the distinct links (graph_id, node, nbr) without loops and without rows that only name a node."""
    e = links.filter("nbr is not null and node <> nbr").select("graph_id", "node", "nbr")
    return e.union(e.select("graph_id", "nbr", "node")).distinct()


def settled(pointers: DataFrame) -> DataFrame:
    """(graph_id, node, up) with every pointer moved to the root it leads to, by pointer jumping; roots point to themselves."""
    now = pointers.checkpoint()
    while True:
        far = now.select("graph_id", F.col("node").alias("up"), F.col("up").alias("far"))
        new = now.join(far, ["graph_id", "up"]).select("graph_id", "node", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")).checkpoint()
        now = new.select("graph_id", "node", "up")
        if new.filter("moved").isEmpty():
            return now


def spanning_forest(both: DataFrame) -> DataFrame:
    """(graph_id, a, b): a spanning tree of every component of links in both directions.

    Rounds after Boruvka: every tree takes its least edge to another tree, so that their number at least halves.
    """
    edges = both.filter("node < nbr").select("graph_id", F.col("node").alias("a"), F.col("nbr").alias("b")).checkpoint()
    label = both.select("graph_id", "node").distinct().withColumn("tree", F.col("node")).checkpoint()
    chosen = []
    while True:
        of = lambda end, name: label.select("graph_id", F.col("node").alias(end), F.col("tree").alias(name))  # noqa: E731, B023
        cross = edges.join(of("a", "ta"), ["graph_id", "a"]).join(of("b", "tb"), ["graph_id", "b"]).filter("ta <> tb").checkpoint()
        if cross.isEmpty():
            break
        edges = cross.select("graph_id", "a", "b")
        pick = F.min(F.struct("a", "b", "other"))
        out = cross.select("graph_id", "a", "b", F.col("ta").alias("tree"), F.col("tb").alias("other")).union(cross.select("graph_id", "a", "b", F.col("tb").alias("tree"), F.col("ta").alias("other")))
        out = out.groupBy("graph_id", "tree").agg(pick.alias("e")).select("graph_id", "tree", "e.*").checkpoint()
        chosen.append(out.select("graph_id", "a", "b").distinct())
        # Two trees that take the same edge point to each other: the smaller one is a root.
        back = out.select("graph_id", F.col("tree").alias("other"), F.col("other").alias("their"))
        up = F.when((F.col("their") == F.col("tree")) & (F.col("tree") < F.col("other")), F.col("tree")).otherwise(F.col("other"))
        root = settled(out.join(back, ["graph_id", "other"]).select("graph_id", F.col("tree").alias("node"), up.alias("up")))
        label = label.join(root.select("graph_id", F.col("node").alias("tree"), "up"), ["graph_id", "tree"], "left")
        label = label.select("graph_id", "node", F.coalesce("up", "tree").alias("tree")).checkpoint()
    if not chosen:
        return edges.limit(0)
    forest = chosen[0]
    for c in chosen[1:]:
        forest = forest.union(c)
    return forest.distinct()


def bridges(links: DataFrame) -> DataFrame:
    """GA06: (graph_id, a, b), the edges whose loss parts their component.

    Every edge outside a spanning forest has a random label of 128 bits, every node the exclusive or of its edges' labels. Cutting a
    tree edge leaves no other edge between the sides if the labels of one side's nodes cancel out. A walk around each tree, as a list of
    arcs that pointer jumping sums up, has the nodes of a side between the edge's two arcs.
    """
    checkpoints(links.sparkSession)
    both = simple(links).checkpoint()
    tree = spanning_forest(both).checkpoint()
    rest = both.filter("node < nbr").select("graph_id", F.col("node").alias("a"), F.col("nbr").alias("b")).join(tree, ["graph_id", "a", "b"], "left_anti")
    rest = rest.select("graph_id", "a", "b", F.xxhash64("graph_id", "a", "b").alias("x"), F.xxhash64(F.lit(7), "b", "graph_id", "a").alias("y"))
    node = rest.select("graph_id", F.col("a").alias("node"), "x", "y").union(rest.select("graph_id", F.col("b").alias("node"), "x", "y"))
    node = node.groupBy("graph_id", "node").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    arcs = tree.select("graph_id", F.col("a").alias("u"), F.col("b").alias("v")).union(tree.select("graph_id", F.col("b").alias("u"), F.col("a").alias("v")))
    # Behind the arc u -> v comes the arc from v to its next neighbour after u, the first one after the last.
    by = Window.partitionBy("graph_id", "v").orderBy("u")
    arcs = arcs.withColumn("w", F.coalesce(F.lead("u").over(by), F.first("u").over(by))).withColumn("lands", F.row_number().over(by) == 1)
    arcs = arcs.join(node.withColumnRenamed("node", "v"), ["graph_id", "v"], "left")
    value = lambda c: F.when(F.col("lands"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    first = settled_components(tree).withColumnRenamed("node", "u")
    # The list of a tree ends before the least arc that leaves its root.
    arcs = arcs.join(first, ["graph_id", "u"]).select("graph_id", "u", "v", "w", "tree", value("x"), value("y")).checkpoint()
    head = arcs.filter("u = tree").groupBy("graph_id", "tree").agg(F.min("v").alias("hv"))
    ends = (F.col("v") == F.col("tree")) & (F.col("w") == F.col("hv"))
    now = arcs.join(head, ["graph_id", "tree"]).select("graph_id", "u", "v", F.when(~ends, F.col("v")).alias("nu"), F.when(~ends, F.col("w")).alias("nv"), "x", "y").checkpoint()
    while not now.filter("nu is not null").isEmpty():
        then = now.select("graph_id", F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("mu"), F.col("nv").alias("mv"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        add = lambda c: F.col(c).bitwiseXOR(F.coalesce(F.col(f"{c}2"), F.lit(0).cast("long"))).alias(c)
        now = now.join(then, ["graph_id", "nu", "nv"], "left").select("graph_id", "u", "v", F.col("mu").alias("nu"), F.col("mv").alias("nv"), add("x"), add("y")).checkpoint()
    one = now.filter("u < v").select("graph_id", F.col("u").alias("a"), F.col("v").alias("b"), "x", "y")
    two = now.filter("u > v").select("graph_id", F.col("v").alias("a"), F.col("u").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return one.join(two, ["graph_id", "a", "b"]).filter("x = x2 and y = y2").select("graph_id", "a", "b")


def settled_components(edges: DataFrame) -> DataFrame:
    """(graph_id, node, tree): the smallest node that a node's edges (graph_id, a, b) lead to."""
    from graphloom.operators.algorithms import components_large

    return components_large(edges.select("graph_id", F.col("a").alias("node"), F.col("b").alias("nbr"))).withColumnRenamed("component", "tree")


def levels(both: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Breadth-first search from all sources (graph_id, src) at once: per level (graph_id, src, node, paths), the number of shortest paths."""
    front = sources.select("graph_id", "src", F.col("src").alias("node"), F.lit(1.0).alias("paths")).checkpoint()
    out, seen = [], front.select("graph_id", "src", "node")
    while not front.isEmpty():
        out.append(front)
        step = front.join(both, ["graph_id", "node"]).groupBy("graph_id", "src", F.col("nbr").alias("node")).agg(F.sum("paths").alias("paths"))
        # A neighbour of a level is on it, on the one before or on the next: older levels need not be looked at.
        near = out[-1].select("graph_id", "src", "node")
        near = near.union(out[-2].select("graph_id", "src", "node")) if len(out) > 1 else near.union(seen)
        front = step.join(near, ["graph_id", "src", "node"], "left_anti").checkpoint()
    return out


def _sources(both: DataFrame, block: int, blocks: int) -> DataFrame:
    own = both.select("graph_id", F.col("node").alias("src")).distinct()
    return own.filter(F.pmod(F.xxhash64("graph_id", "src"), F.lit(blocks)) == block) if blocks > 1 else own


def all_pairs(links: DataFrame) -> DataFrame:
    """GA02: (graph_id, a, b, hops) of all pairs that reach each other, a <> b."""
    checkpoints(links.sparkSession)
    both = simple(links).checkpoint()
    found = [f.select("graph_id", F.col("src").alias("a"), F.col("node").alias("b"), F.lit(k).cast("long").alias("hops")) for k, f in enumerate(levels(both, _sources(both, 0, 1))) if k]
    out = both.select("graph_id", F.col("node").alias("a"), F.col("nbr").alias("b"), F.lit(1).cast("long").alias("hops")).limit(0)
    for f in found:
        out = out.union(f)
    return out


def betweenness(links: DataFrame, blocks: int = 1) -> DataFrame:
    """GA03: (graph_id, node, bc) over (n - 1)(n - 2) / 2; 0 for graphs under three nodes. A null nbr only names a node.

    Sources go out in `blocks` parts by hash, level by level; on the way back each node gets its share of what its successors carry. The
    work is that of nodes times links, which no exact way avoids; blocks bound what is held at a time.
    """
    checkpoints(links.sparkSession)
    both = simple(links).checkpoint()
    nodes = links.select("graph_id", "node").union(links.filter("nbr is not null").select("graph_id", "nbr")).distinct()
    total = None
    for b in range(blocks):
        front = levels(both, _sources(both, b, blocks))
        carry, parts = None, []
        for k in reversed(range(1, len(front))):
            own = front[k] if carry is None else front[k].join(carry, ["graph_id", "src", "node"], "left")
            share = F.lit(0.0) if carry is None else F.coalesce("share", F.lit(0.0))
            own = own.select("graph_id", "src", "node", share.alias("share"), ((1 + share) / F.col("paths")).alias("each")).checkpoint()
            parts.append(own.select("graph_id", "node", "share"))
            before = own.join(both, ["graph_id", "node"]).select("graph_id", "src", F.col("nbr").alias("node"), "each")
            carry = before.join(front[k - 1], ["graph_id", "src", "node"]).groupBy("graph_id", "src", "node").agg(F.sum(F.col("each") * F.col("paths")).alias("share"))
        for p in parts:
            total = p if total is None else total.union(p)
        if total is not None:
            total = total.groupBy("graph_id", "node").agg(F.sum("share").alias("share")).checkpoint()
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    out = nodes.join(size, "graph_id")
    out = out.withColumn("share", F.lit(0.0)) if total is None else out.join(total, ["graph_id", "node"], "left")
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    return out.select("graph_id", "node", F.when(F.col("n") > 2, F.coalesce("share", F.lit(0.0)) / pairs).otherwise(0.0).alias("bc"))


def lambda2(links: DataFrame, most: int = 120, within: float = 1e-7) -> DataFrame:
    """(graph_id, l2, residual): the second smallest eigenvalue of the normalised Laplacian of links (graph_id, node, nbr, w).

    Weights of a pair add up in both directions; nodes without a link have an identity row; a null nbr names a node. A graph
    of several components with links has 0. Else Lanczos steps span a space, one sparse product a step as join and aggregate, orthogonal to
    the known first vector and to all steps before, twice. The residual bounds the distance to the nearest eigenvalue; steps end where it is below
    `within` in all graphs, or after `most`.
    """
    spark = links.sparkSession
    checkpoints(spark)
    share_code(spark)
    e = links.filter("nbr is not null").select("graph_id", "node", "nbr", F.col("w").cast("double").alias("w"))
    both = e.union(e.select("graph_id", "nbr", "node", "w")).groupBy("graph_id", "node", "nbr").agg(F.sum("w").alias("w")).checkpoint()
    degree = both.groupBy("graph_id", "node").agg(F.sum("w").alias("d")).checkpoint()
    root = degree.select("graph_id", F.col("node").alias("nbr"), (1 / F.sqrt(F.col("d") + 1e-8)).alias("q"))
    near = both.join(root, ["graph_id", "nbr"]).join(root.select("graph_id", F.col("nbr").alias("node"), F.col("q").alias("p")), ["graph_id", "node"])
    near = near.select("graph_id", "node", "nbr", (F.col("w") * F.col("p") * F.col("q")).alias("w")).checkpoint()
    names = links.select("graph_id", "node").union(links.filter("nbr is not null").select("graph_id", "nbr")).distinct()
    size = names.groupBy("graph_id").agg(F.count("*").alias("n"))
    from graphloom.operators.algorithms import components_large

    trees = components_large(both.select("graph_id", "node", "nbr")).groupBy("graph_id").agg(F.countDistinct("component").alias("trees"), F.count("*").alias("linked"))
    whole = size.join(trees, "graph_id", "left").checkpoint()
    one = whole.filter("trees = 1").select("graph_id")

    def scaled(rows: DataFrame, vector: Column) -> DataFrame:
        """(graph_id, node, v) of length 1, with its former length."""
        rows = rows.select("graph_id", "node", vector.alias("v"), *[c for c in rows.columns if c == "b"])
        length = rows.groupBy("graph_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
        # A space that is used up leaves rounding errors only: the vector ends there.
        return rows.join(length, "graph_id").withColumn("v", F.when(F.col("length") > 1e-9, F.col("v") / F.col("length")).otherwise(0.0))

    def orthogonal(rows: DataFrame, k: int) -> DataFrame:
        """v less its parts along the k vectors of b; `h`: these parts."""
        parts = rows.groupBy("graph_id").agg(F.array(*[F.sum(F.col("b")[j] * F.col("v")) for j in range(k)]).alias("h"))
        rest = F.col("v") - F.aggregate(F.zip_with("b", "h", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return rows.join(parts, "graph_id").withColumn("v", rest)

    # b[0] is the vector of the smallest eigenvalue; the start is a vector by hash.
    first = scaled(degree.join(one, "graph_id", "left_semi"), F.sqrt("d")).select("graph_id", "node", F.array("v").alias("b"))
    start = first.withColumn("v", F.xxhash64("graph_id", "node", F.lit(3)) / F.lit(2.0**63)).checkpoint()
    now = scaled(orthogonal(orthogonal(start, 1).drop("h"), 1), F.col("v")).checkpoint()
    steps: list[DataFrame] = []
    found = None
    for k in range(1, most + 1):
        now = now.select("graph_id", "node", F.concat("b", F.array("v")).alias("b"), "v")
        w = near.join(now.select("graph_id", F.col("node").alias("nbr"), F.col("v").alias("x")), ["graph_id", "nbr"]).groupBy("graph_id", "node").agg(F.sum(F.col("w") * F.col("x")).alias("v"))
        rows = now.drop("v").join(w, ["graph_id", "node"])
        rows = orthogonal(rows, k + 1).withColumnRenamed("h", "h1").checkpoint()
        again = orthogonal(rows.drop("h1"), k + 1).drop("h")
        after = scaled(again, F.col("v")).checkpoint()
        line = rows.groupBy("graph_id").agg(F.first("h1").alias("h")).join(after.groupBy("graph_id").agg(F.first("length").alias("beta")), "graph_id")
        steps.append(line.select("graph_id", F.lit(k).alias("k"), F.slice("h", k + 1, 1)[0].alias("alpha"), "beta").checkpoint())
        now = after.select("graph_id", "node", "b", "v")
        if k % 10 == 0 or k == most:
            found = _ritz(steps).checkpoint()
            if found.filter(F.col("residual") > within).isEmpty():
                break
    out = whole.join(found, "graph_id", "left")
    lone = F.col("n") > F.coalesce("linked", F.lit(0))
    value = F.when(F.col("n") < 2, 0.0).when(F.col("trees").isNull(), 1.0).when(F.col("trees") > 1, 0.0).when(F.col("linked") < 2, 1.0).when(lone, F.least(F.lit(1.0), F.col("l2"))).otherwise(F.col("l2"))
    return out.select("graph_id", value.alias("l2"), F.coalesce("residual", F.lit(0.0)).alias("residual"))


def _ritz(steps: list[DataFrame]) -> DataFrame:
    """(graph_id, l2, residual) of the small matrices that the steps have made; a graph's ends where its space is used up."""
    rows = steps[0]
    for s in steps[1:]:
        rows = rows.union(s)
    kind = dict(rows.dtypes)["graph_id"]

    def solve(t: pa.Table) -> pa.Table:
        at = np.argsort(t.column("k").to_numpy())
        alpha, beta = t.column("alpha").to_numpy()[at], t.column("beta").to_numpy()[at]
        end = int(np.argmax(beta <= 1e-9)) + 1 if (beta <= 1e-9).any() else len(beta)
        m = np.diag(alpha[:end]) + np.diag(beta[: end - 1], 1) + np.diag(beta[: end - 1], -1)
        values, vectors = np.linalg.eigh(m)
        left = 0.0 if beta[end - 1] <= 1e-9 else float(beta[end - 1] * abs(vectors[-1, -1]))
        return pa.table([t.column("graph_id").slice(0, 1).combine_chunks(), pa.array([1 - float(values[-1])]), pa.array([left])], names=["graph_id", "l2", "residual"])

    return rows.groupBy("graph_id").applyInArrow(solve, f"graph_id {kind}, l2 double, residual double")


def by_size(links: DataFrame, largest: int, small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """small() over the graphs of up to `largest` nodes, large() over the others, where there are any.

    Links number a graph's nodes at least once from either end, so that only graphs with more rows than half of `largest` are counted.
    """
    many = links.groupBy("graph_id").count().filter(F.col("count") > largest // 2).select("graph_id")
    if many.isEmpty():
        return small(links)
    ends = links.select("graph_id", "node").union(links.filter("nbr is not null").select("graph_id", "nbr"))
    big = ends.join(many, "graph_id", "left_semi").distinct().groupBy("graph_id").count().filter(F.col("count") > largest).select("graph_id")
    checkpoints(links.sparkSession)
    big = big.checkpoint()
    if big.isEmpty():
        return small(links)
    rest, those = small(links.join(big, "graph_id", "left_anti")), large(links.join(big, "graph_id", "left_semi"))
    return rest.unionByName(those.select(*rest.columns))
