"""Graph algorithms (GA01-GA18).

Collections hold many small graphs, so algorithms that iterate over a graph run as one Arrow kernel a
graph: one shuffle on graph_id, no driver loop. Graphs of more than `LARGEST` nodes go to the joins of `large`, which work on the
link table alone.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import large
from graphloom.session import checkpoints, share_code

LARGEST = 20_000  # nodes of a graph that one task holds
DENSE = 5_000  # nodes of a graph whose matrix one task holds
_MARKS = ("room_type", "noise", "tolerance")


def kernel(links: DataFrame, fn: Callable, schema: str, node: str = "node", nbr: str = "nbr", more: tuple[str, ...] = ()) -> DataFrame:
    """Apply fn(ids, adjacency lists) -> columns after graph_id to every graph of (graph_id, node, nbr); a null nbr
    only names a node. ids are sorted. With `more` columns fn also gets the rows that name a node: their positions in ids, and the rows."""
    share_code(links.sparkSession)
    kind = dict(links.dtypes)["graph_id"]
    names = ["graph_id", *[x.split()[0] for x in schema.split(", ")]]

    def run(t: pa.Table) -> pa.Table:
        a, b = t.column(1).to_numpy(), t.column(2)
        has = b.is_valid().to_numpy(zero_copy_only=False)
        b = b.drop_null().to_numpy()
        ids = np.unique(np.concatenate((a, b)))
        adj = [set() for _ in ids]
        for x, y in zip(np.searchsorted(ids, a[has]).tolist(), np.searchsorted(ids, b).tolist(), strict=True):
            if x != y:
                adj[x].add(y)
                adj[y].add(x)
        named = (np.searchsorted(ids, a[~has]), t.filter(pa.array(~has))) if more else ()
        cols = fn(ids, [sorted(s) for s in adj], *named)
        n = len(cols[0])
        return pa.table([pa.array([t.column(0)[0].as_py()] * n, t.schema.field(0).type), *cols], names=names)

    return links.select("graph_id", F.col(node).alias("node"), F.col(nbr).alias("nbr"), *more).groupBy("graph_id").applyInArrow(run, f"graph_id {kind}, {schema}")


def bfs(adj: list[list[int]], *starts: int) -> list[int]:
    """Hops from the nearest start, -1 where none reaches."""
    d = [-1] * len(adj)
    for x in starts:
        d[x] = 0
    q = deque(starts)
    while q:
        x = q.popleft()
        for y in adj[x]:
            if d[y] < 0:
                d[y] = d[x] + 1
                q.append(y)
    return d


def all_pairs(links: DataFrame) -> DataFrame:
    """GA02: (graph_id, a, b, hops) of all pairs that reach each other, a <> b."""

    def fn(ids, adj):
        d = np.array([bfs(adj, i) for i in range(len(ids))]).reshape(len(ids), len(ids))
        i, j = np.nonzero(d > 0)
        return [pa.array(ids[i]), pa.array(ids[j]), pa.array(d[i, j].astype(np.int64))]

    return large.by_size(links, LARGEST, lambda e: kernel(e, fn, "a long, b long, hops long"), large.all_pairs)


def nearest(rows: DataFrame, kind: str) -> DataFrame:
    """(graph_id, room_id, room_type, hops): of every room to the nearest one of a type, null where none is reached.

    rows: links (graph_id, node, nbr, room_type), and a row without nbr for every room. One search a graph; no row is made for a pair."""

    def fn(ids, adj, at, rooms):
        is_kind = pc.fill_null(pc.equal(rooms.column("room_type"), kind), False).to_numpy(zero_copy_only=False)
        d = bfs(adj, *set(at[is_kind].tolist()))
        hops = np.array(d, np.int64)[at]
        return [pa.array(ids[at]), rooms.column("room_type"), pa.array(hops, mask=hops < 0)]

    def joins(those: DataFrame) -> DataFrame:
        rooms = those.filter("nbr is null").select("graph_id", F.col("node").alias("room_id"), "room_type")
        src = rooms.filter(F.col("room_type") == kind).select("graph_id", F.col("room_id").alias("a"))
        near = large.all_pairs(those).join(src, ["graph_id", "a"], "left_semi").select("graph_id", F.col("b").alias("room_id"), "hops")
        near = near.unionByName(src.select("graph_id", F.col("a").alias("room_id"), F.lit(0).cast("long").alias("hops")))
        return rooms.join(near.groupBy("graph_id", "room_id").agg(F.min("hops").alias("hops")), ["graph_id", "room_id"], "left")

    return large.by_size(rows, LARGEST, lambda e: kernel(e, fn, "room_id long, room_type string, hops long", more=_MARKS), joins)


def hops_between(rows: DataFrame, noise: int = 2, tolerance: int = 1) -> DataFrame:
    """(graph_id, n, pairs, hops, lost): rooms, pairs of a room of at least `noise` with one of at most `tolerance`, the hops between them
    in all (none of a room with itself), and the pairs that do not reach each other. rows: as `nearest`, with noise and tolerance."""

    def fn(ids, adj, at, rooms):
        def marked(ok):
            return np.bincount(at[pc.fill_null(ok, False).to_numpy(zero_copy_only=False)], minlength=len(ids))

        a, b = marked(pc.greater_equal(rooms.column("noise"), noise)), marked(pc.less_equal(rooms.column("tolerance"), tolerance))
        hops = lost = 0
        for i in np.flatnonzero(a).tolist() if b.any() else ():
            d = np.array(bfs(adj, i))
            hops, lost = hops + int(a[i] * (d * b)[d > 0].sum()), lost + int(a[i] * b[d < 0].sum())
        return [pa.array([v], pa.int64()) for v in (len(at), int(a.sum() * b.sum()), hops, lost)]

    def joins(those: DataFrame) -> DataFrame:
        rooms = those.filter("nbr is null")
        p = rooms.filter(F.col("noise") >= noise).select("graph_id", F.col("node").alias("a")).join(rooms.filter(F.col("tolerance") <= tolerance).select("graph_id", F.col("node").alias("b")), "graph_id")
        p = p.join(large.all_pairs(those), ["graph_id", "a", "b"], "left").groupBy("graph_id")
        p = p.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("hops"), F.lit(0)).alias("hops"), F.count_if(F.col("hops").isNull() & (F.col("a") != F.col("b"))).alias("lost"))
        return rooms.groupBy("graph_id").agg(F.count("*").alias("n")).join(p, "graph_id")

    return large.by_size(rows, LARGEST, lambda e: kernel(e, fn, "n long, pairs long, hops long, lost long", more=_MARKS), joins)


def on_short_cycles(rows: DataFrame) -> DataFrame:
    """(graph_id, room_id, on): whether a room is on a cycle of three or four links. rows: as `nearest`."""

    def fn(ids, adj, at, rooms):
        on = np.zeros(len(ids), bool)
        for a in range(len(ids)):
            common = Counter(b for m in adj[a] for b in adj[m])
            near = set(adj[a])
            on[a] = any(b != a and (k >= 2 or b in near) for b, k in common.items())
        return [pa.array(ids[at]), pa.array(on[at])]

    def joins(those: DataFrame) -> DataFrame:
        e = large.simple(those)
        # A pair with two common neighbours closes a square; one that is also a link with any closes a triangle.
        wedge = e.select("graph_id", F.col("nbr").alias("a"), F.col("node").alias("m")).join(e.select("graph_id", F.col("node").alias("m"), F.col("nbr").alias("b")), ["graph_id", "m"]).filter("a < b")
        many = wedge.groupBy("graph_id", "a", "b").agg(F.count("*").alias("k"))
        tri = wedge.join(e.select("graph_id", F.col("node").alias("a"), F.col("nbr").alias("b")), ["graph_id", "a", "b"], "left_semi")
        sq = wedge.join(many.filter("k >= 2").select("graph_id", "a", "b"), ["graph_id", "a", "b"], "left_semi")
        hit = tri.unionByName(sq).select("graph_id", F.explode(F.array("a", "b", "m")).alias("room_id")).distinct().withColumn("on", F.lit(True))
        rooms = those.filter("nbr is null").select("graph_id", F.col("node").alias("room_id"))
        return rooms.join(hit, ["graph_id", "room_id"], "left").select("graph_id", "room_id", F.coalesce("on", F.lit(False)).alias("on"))

    return large.by_size(rows, LARGEST, lambda e: kernel(e, fn, "room_id long, on boolean", more=_MARKS), joins)


def component_paths(links: DataFrame) -> DataFrame:
    """(graph_id, component, pairs, hops, diameter) of every component of two or more nodes, named by its smallest node: ordered pairs
    of its nodes, the hops between them in all, and the most of them."""

    def fn(ids, adj):
        pairs, hops, far = ([0] * len(ids) for _ in range(3))
        for i in range(len(ids)):
            d = np.array(bfs(adj, i))
            top = int(np.argmax(d >= 0))
            pairs[top], hops[top], far[top] = pairs[top] + int((d > 0).sum()), hops[top] + int(d[d > 0].sum()), max(far[top], int(d.max()))
        at = [i for i in range(len(ids)) if pairs[i]]
        return [pa.array(ids[at]), *[pa.array([c[i] for i in at], pa.int64()) for c in (pairs, hops, far)]]

    def joins(those: DataFrame) -> DataFrame:
        p = large.all_pairs(those).join(components_large(those).withColumnRenamed("node", "a"), ["graph_id", "a"])
        return p.groupBy("graph_id", "component").agg(F.count("*").alias("pairs"), F.sum("hops").alias("hops"), F.max("hops").alias("diameter"))

    return large.by_size(links, LARGEST, lambda e: kernel(e, fn, "component long, pairs long, hops long, diameter long"), joins)


def shortest_path(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """GA01: (graph_id, src, dst, hops, path) for the pairs wanted (one source a graph; dst may vary).

    Of equally short paths the one that is least by its nodes' ids, from the source on; hops is null and
    the path empty where there is none. Frontier joins with a visited anti-join; every round keeps one path a node.
    """
    checkpoints(wanted.sparkSession)
    seen = wanted.select("graph_id", "src").distinct().select("graph_id", "src", F.col("src").alias("node"), F.array("src").alias("path"))
    front = seen
    while True:
        step = front.join(links, ["graph_id", "node"]).select("graph_id", "src", F.col("nbr").alias("node"), F.concat("path", F.array("nbr")).alias("path"))
        step = step.groupBy("graph_id", "src", "node").agg(F.min("path").alias("path")).join(seen.select("graph_id", "src", "node"), ["graph_id", "src", "node"], "left_anti")
        front = step.checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front).checkpoint()
    out = wanted.join(seen.withColumnRenamed("node", "dst"), ["graph_id", "src", "dst"], "left")
    return out.select("graph_id", "src", "dst", (F.size("path") - 1).cast("long").alias("hops"), F.coalesce("path", F.array().cast("array<long>")).alias("path"))


def components(links: DataFrame) -> DataFrame:
    """GA05: (graph_id, node, component), the component named by its smallest node."""

    def fn(ids, adj):
        comp = [-1] * len(ids)
        for i in range(len(ids)):
            if comp[i] < 0:
                comp[i], todo = i, [i]
                while todo:
                    for y in adj[todo.pop()]:
                        if comp[y] < 0:
                            comp[y] = i
                            todo.append(y)
        return [pa.array(ids), pa.array(ids[comp])]

    return large.by_size(links, LARGEST, lambda e: kernel(e, fn, "node long, component long"), _components_and_lone)


def _components_and_lone(links: DataFrame) -> DataFrame:
    """components_large() and, as the kernel has them, the nodes without a link."""
    found = components_large(links)
    ends = links.select("graph_id", "node").union(links.filter("nbr is not null").select("graph_id", "nbr")).distinct()
    lone = ends.join(found.select("graph_id", "node"), ["graph_id", "node"], "left_anti")
    return found.unionByName(lone.withColumn("component", F.col("node")))


def components_large(links: DataFrame) -> DataFrame:
    """GA05 for graphs of any size: min-label propagation with pointer jumping over the link table, checkpointed."""
    checkpoints(links.sparkSession)
    both = links.filter("nbr is not null and node <> nbr").select("graph_id", "node", "nbr")
    both = both.union(both.select("graph_id", "nbr", "node")).distinct().checkpoint()
    lab = both.groupBy("graph_id", "node").agg(F.least("node", F.min("nbr")).alias("component")).checkpoint()
    while True:
        via = both.join(lab.withColumnRenamed("node", "nbr"), ["graph_id", "nbr"]).groupBy("graph_id", "node").agg(F.min("component").alias("via"))
        near = lab.join(via, ["graph_id", "node"]).select("graph_id", "node", F.col("component").alias("was"), F.least("component", "via").alias("near"))
        far = lab.select("graph_id", F.col("node").alias("near"), F.col("component").alias("far"))
        new = near.join(far, ["graph_id", "near"]).select("graph_id", "node", "was", F.least("near", "far").alias("component")).checkpoint()
        lab = new.select("graph_id", "node", "component")
        if new.filter("was <> component").isEmpty():
            return lab


def betweenness(links: DataFrame) -> DataFrame:
    """GA03: (graph_id, node, bc), shortest-path betweenness over (n - 1)(n - 2) / 2; 0 for graphs under three nodes."""

    def fn(ids, adj):
        n = len(ids)
        bc = np.zeros(n)
        for s in range(n):
            order, sigma, d, before = [], [0.0] * n, [-1] * n, [[] for _ in range(n)]
            sigma[s], d[s] = 1.0, 0
            q = deque([s])
            while q:
                x = q.popleft()
                order.append(x)
                for y in adj[x]:
                    if d[y] < 0:
                        d[y] = d[x] + 1
                        q.append(y)
                    if d[y] == d[x] + 1:
                        sigma[y] += sigma[x]
                        before[y].append(x)
            share = [0.0] * n
            for y in reversed(order):
                for x in before[y]:
                    share[x] += sigma[x] / sigma[y] * (1 + share[y])
                if y != s:
                    bc[y] += share[y]
        return [pa.array(ids), pa.array(bc / ((n - 1) * (n - 2)) if n > 2 else bc * 0)]

    return large.by_size(links, LARGEST, lambda e: kernel(e, fn, "node long, bc double"), lambda e: large.betweenness(e, blocks=64))


def bridges(links: DataFrame) -> DataFrame:
    """GA06: (graph_id, a, b), the edges whose loss parts their component, by depth-first low points."""

    def fn(ids, adj):
        n = len(ids)
        seen, low, out, t = [0] * n, [0] * n, [], 0
        for r in range(n):
            if seen[r]:
                continue
            t += 1
            seen[r] = low[r] = t
            stack = [(r, -1, iter(adj[r]))]
            while stack:
                x, up, it = stack[-1]
                for y in it:
                    if not seen[y]:
                        t += 1
                        seen[y] = low[y] = t
                        stack.append((y, x, iter(adj[y])))
                        break
                    if y != up:
                        low[x] = min(low[x], seen[y])
                else:
                    stack.pop()
                    if stack:
                        low[up] = min(low[up], low[x])
                        if low[x] > seen[up]:
                            out.append((min(up, x), max(up, x)))
        out.sort()
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return [pa.array(ids[a]), pa.array(ids[b])]

    return large.by_size(links, LARGEST, lambda e: kernel(e, fn, "a long, b long"), large.bridges)


def isolated(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """GA04: (graph_id, room_id) of rooms without a link."""
    return nodes.select("graph_id", "room_id").join(links.select("graph_id", F.col("node").alias("room_id")), ["graph_id", "room_id"], "left_anti")


def clustering(links: DataFrame) -> DataFrame:
    """GA18: (graph_id, node, c): closed pairs of neighbours over all; links in both directions. Triangles by a self-join on the wedge."""
    deg = links.groupBy("graph_id", "node").agg(F.count("*").alias("d"))
    low = links.filter("node < nbr").select("graph_id", F.col("node").alias("a"), F.col("nbr").alias("b"))
    tri = low.join(low.select("graph_id", F.col("a").alias("b"), F.col("b").alias("c")), ["graph_id", "b"]).join(low.select("graph_id", "a", F.col("b").alias("c")), ["graph_id", "a", "c"], "left_semi")
    t = tri.select("graph_id", F.explode(F.array("a", "b", "c")).alias("node")).groupBy("graph_id", "node").agg(F.count("*").alias("t"))
    out = deg.join(t, ["graph_id", "node"], "left")
    return out.select("graph_id", "node", F.when(F.col("d") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("c"))


def lambda2(links: DataFrame) -> DataFrame:
    """(graph_id, l2): second smallest eigenvalue of the normalised Laplacian, edges (graph_id, src, dst, w) summed into weights.

    Nodes without an edge have an identity row. links: (graph_id, node, nbr, w); a null nbr names a node."""
    share_code(links.sparkSession)
    kind = dict(links.dtypes)["graph_id"]

    def run(t: pa.Table) -> pa.Table:
        a, ok = t.column("node").to_numpy(), t.column("nbr").is_valid().to_numpy(zero_copy_only=False)
        b, w = t.column("nbr").drop_null().to_numpy(), t.column("w").to_numpy(zero_copy_only=False)[ok]
        ids = np.unique(np.concatenate((a, b)))
        n = len(ids)
        adj = np.zeros((n, n))
        np.add.at(adj, (np.searchsorted(ids, a[ok]), np.searchsorted(ids, b)), w)
        adj = adj + adj.T
        d = 1 / np.sqrt(adj.sum(1) + 1e-8)
        lap = np.eye(n) - d[:, None] * adj * d
        l2 = float(np.linalg.eigvalsh(lap)[1]) if n > 1 else 0.0
        return pa.table([pa.array([t.column("graph_id")[0].as_py()], t.schema.field("graph_id").type), pa.array([l2])], names=["graph_id", "l2"])

    def dense(rows: DataFrame) -> DataFrame:
        return rows.groupBy("graph_id").applyInArrow(run, f"graph_id {kind}, l2 double")

    return large.by_size(links.select("graph_id", "node", "nbr", "w"), DENSE, dense, large.lambda2)


def fire_mask(nodes: DataFrame, edges: DataFrame, threshold: int = 50) -> DataFrame:
    """GA07: (graph_id, a, b): a lacks exits by its multi-edge degree, b any other room."""
    ends = edges.select("graph_id", F.col("src").alias("room_id")).union(edges.select("graph_id", "dst"))
    deg = ends.groupBy("graph_id", "room_id").agg(F.count("*").alias("d"))
    bad = nodes.filter(F.col("occupancy") >= threshold).join(deg, ["graph_id", "room_id"], "left").filter(F.coalesce("d", F.lit(0)) < F.greatest(F.lit(1), F.col("exits")))
    return bad.select("graph_id", F.col("room_id").alias("a")).join(nodes.select("graph_id", F.col("room_id").alias("b")), "graph_id").filter("a <> b")


def acoustic_mask(nodes: DataFrame, gap: int = 2) -> DataFrame:
    """GA08: (graph_id, a, b) both ways for pairs of a graph whose noise exceeds the other's tolerance by gap either way."""
    s = lambda p: nodes.select("graph_id", F.col("room_id").alias(p), F.col("noise").alias(f"n{p}"), F.col("tolerance").alias(f"t{p}"))
    return s("a").join(s("b"), "graph_id").filter("a <> b").filter((F.col("na") - F.col("tb") >= gap) | (F.col("nb") - F.col("ta") >= gap)).select("graph_id", "a", "b")


def daylight_mask(nodes: DataFrame, env: DataFrame) -> DataFrame:
    """GA09: (graph_id, a, b): rooms of HIGH daylight with every environment node."""
    return nodes.filter("daylight >= 3").select("graph_id", F.col("room_id").alias("a")).join(env.select("graph_id", F.col("env_id").alias("b")), "graph_id")
