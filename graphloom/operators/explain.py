"""Subgraph search and counterfactuals (X01-X15, X33-X35): trees over packed graphs, whose states the graph network scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import hash_uniform
from graphloom.operators.network import Network, directed
from graphloom.session import share_code

KEEP = ("staircase", "corridor", "entrance_hall")
DEPTH = 20
EXPLORE = 1.414  # fixed value: weight of the exploration term
REWARD = (1.0, 0.3, 2.0)  # fixed values: weights of the score, of few rooms, of rooms out of reach


def uct(total: Column, visits: Column, parent_visits: Column, c: float = EXPLORE) -> Column:
    """Mean reward plus c * sqrt(ln(parent visits) / visits); unvisited is infinite."""
    q = total / F.greatest(F.lit(1), visits)
    return F.when(visits == 0, F.lit(float("inf"))).otherwise(q + c * F.sqrt(F.ln(F.greatest(F.lit(1), parent_visits)) / F.greatest(F.lit(1), visits)))


def root_state(links: DataFrame) -> DataFrame:
    """Distinct (graph_id, a, b, rel) keys of the room-room edges, a < b."""
    e = links.filter("dst_kind = 'room' and src <> dst")
    return e.select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "rel").distinct()


def drop_nodes(state: DataFrame, gone: DataFrame) -> DataFrame:
    """The state's edges without those at the nodes gone (graph_id, node)."""
    g = gone.select("graph_id", "node")
    return state.join(g.withColumnRenamed("node", "a"), ["graph_id", "a"], "left_anti").join(g.withColumnRenamed("node", "b"), ["graph_id", "b"], "left_anti")


def masked_features(features: DataFrame, kept: DataFrame) -> DataFrame:
    """Features of rooms that are not kept (graph_id, room_id) become zero; a graph that keeps none is left as it is."""
    k = kept.select("graph_id", "room_id").distinct().withColumn("_in", F.lit(True))
    some = kept.select("graph_id").distinct().withColumn("_some", F.lit(True))
    d = features.join(k, ["graph_id", "room_id"], "left").join(some, "graph_id", "left")
    zero = F.transform("features", lambda x: F.lit(0.0))
    return d.withColumn("features", F.when(F.col("_in").isNull() & F.col("_some").isNotNull(), zero).otherwise(F.col("features"))).drop("_in", "_some")


def induced(edges: DataFrame, kept: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Edges whose rooms are kept (environment ends always are), of the keys (graph_id, a, b, rel) if given."""
    k = kept.select("graph_id", "room_id").distinct()
    out = edges.join(k.withColumnRenamed("room_id", "src"), ["graph_id", "src"], "left_semi")
    rr = out.filter("dst_kind = 'room'").join(k.withColumnRenamed("room_id", "dst"), ["graph_id", "dst"], "left_semi")
    out = rr.unionByName(out.filter("dst_kind <> 'room'"))
    if keys is None:
        return out
    out = out.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    return out.join(keys, ["graph_id", "a", "b", "rel"], "left_semi").drop("a", "b")


def unreached(keys: list[tuple[int, int, str]], rooms: frozenset) -> float:
    """1 less the share of kept rooms that the smallest one reaches over physical edges; 1 without rooms or such edges."""
    near: dict[int, list[int]] = {}
    for a, b, rel in keys:
        if rel == "physical":
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    if not rooms or not near:
        return 1.0
    seen, todo = {min(rooms)}, [min(rooms)]
    while todo:
        for y in near.get(todo.pop(), ()):
            if y in rooms and y not in seen:
                seen.add(y)
                todo.append(y)
    return 1 - len(seen) / len(rooms)


class Tree:
    """One graph's search for the rooms and edges that a score rests on, by Monte Carlo tree search.

    types: a room's type by position; keys: the distinct room-room edges (a, b, relation); score: the kept rooms' score. A state keeps
    rooms and edges, an action drops one or keeps all. `compat` descends as soon as a node has a child, so that the tree is one
    chain, as in the original; else a node's actions are all tried first.
    """

    def __init__(self, types: list[str], keys: list[tuple[int, int, str]], score: Callable[[frozenset], float], weights: tuple[float, float, float] = REWARD, seed: int = 42, compat: bool = False):
        self.types, self.keys, self.score, self.weights, self.compat = types, keys, score, weights, compat
        self.rng = np.random.default_rng(seed)
        self.rooms, self.live = frozenset(range(len(types))), frozenset(range(len(keys)))
        self.loose = frozenset(i for i, t in enumerate(types) if not t.startswith(KEEP))
        self.at: list[set[int]] = [set() for _ in types]  # a room's edges
        self.near = [0] * len(types)  # a room's physical neighbours, as bits
        for i, (a, b, rel) in enumerate(keys):
            self.at[a].add(i)
            self.at[b].add(i)
            if rel == "physical":
                self.near[a] |= 1 << b
                self.near[b] |= 1 << a
        self.doors = frozenset(i for i, k in enumerate(keys) if k[2] == "physical")
        self.baseline = score(self.rooms)

    def actions(self, rooms: frozenset, live: frozenset, share: float) -> list[tuple[str, int]]:
        """Up to five rooms that may go, up to five edges, and keeping all."""
        out: list[tuple[str, int]] = []
        loose = sorted(rooms & self.loose)
        if len(rooms) > max(5, int(len(self.types) * share)):
            out += [("room", int(x)) for x in self.rng.permutation(loose)[:5]]
        if len(live) > len(rooms):
            out += [("edge", int(x)) for x in self.rng.permutation(sorted(live))[:5]]
        return [*out, ("keep", -1)]

    def apply(self, rooms: frozenset, live: frozenset, action: tuple[str, int]) -> tuple[frozenset, frozenset]:
        """A room goes with its edges."""
        kind, what = action
        if kind == "room":
            return rooms - {what}, live - self.at[what]
        return (rooms, live - {what}) if kind == "edge" else (rooms, live)

    def reward(self, rooms: frozenset, live: frozenset) -> float:
        """What the score gains, a bonus for few rooms, a fine for rooms out of reach."""
        fine = self.unreached(rooms, live) if self.weights[2] else 0.0
        return self.weights[0] * (self.score(rooms) - self.baseline) + self.weights[1] / (1 + len(rooms)) - self.weights[2] * fine

    def unreached(self, rooms: frozenset, live: frozenset) -> float:
        """X13, as `unreached` of the live keys, by sets of rooms as bits."""
        if not rooms or not self.doors & live:
            return 1.0
        near = self.near.copy()
        for i in self.doors - live:
            a, b = self.keys[i][:2]
            near[a] &= ~(1 << b)
            near[b] &= ~(1 << a)
        seen = todo = 1 << min(rooms)
        free = sum(1 << r for r in rooms)
        while todo:
            low = todo & -todo
            more = near[low.bit_length() - 1] & free & ~seen
            seen |= more
            todo = (todo ^ low) | more
        return 1 - seen.bit_count() / len(rooms)

    def search(self, sims: int = 200, sparsity: float = 0.5) -> tuple[frozenset, frozenset, float, int]:
        """(rooms, edges, reward, actions) of the best state; the whole graph with reward 0 where no state is better."""
        state = (self.rooms, self.live)
        root = {"s": state, "v": 0, "t": 0.0, "kids": [], "d": 0, "up": None, "todo": self.actions(*state, sparsity)}
        best = (*state, 0.0, 0)

        def worth(kid: dict) -> float:
            return kid["t"] / kid["v"] + EXPLORE * math.sqrt(math.log(max(1, kid["up"]["v"])) / kid["v"]) if kid["v"] else math.inf

        for _ in range(sims):
            x = root
            while x["kids"] and (self.compat or not x["todo"]):
                x = max(x["kids"], key=worth)
            if x["todo"]:
                kid = {"s": self.apply(*x["s"], x["todo"].pop(0)), "v": 0, "t": 0.0, "kids": [], "d": x["d"] + 1, "up": x, "todo": []}
                if kid["d"] < DEPTH:
                    kid["todo"] = self.actions(*kid["s"], max(0.3, 0.5 - 0.02 * kid["d"]))
                x["kids"].append(kid)
                x = kid
            r = self.reward(*x["s"])
            if r > best[2]:
                best = (*x["s"], r, x["d"])
            while x is not None:
                x["v"] += 1
                x["t"] += r
                x = x["up"]
        return best


def masked_scores(x: np.ndarray, means: dict, network: Network) -> Callable[[frozenset], np.ndarray]:
    """All heads' scores of a graph whose other rooms' features are zero, each set of rooms computed once; without a room, of the whole graph."""
    known: dict[frozenset, np.ndarray] = {}
    masked = network.scorer(x, means)

    def score(rooms: frozenset) -> np.ndarray:
        if rooms not in known:
            kept = np.zeros((len(x), 1))
            kept[list(rooms) or slice(None)] = 1
            known[rooms] = masked(kept)
        return known[rooms]

    return score


_FOUND = "metric string, rooms array<long>, edges array<struct<a:bigint,b:bigint,rel:string>>, reward double, baseline double, actions long"


def search_graphs(packed: DataFrame, network: Network, metrics: tuple[str, ...] = ("overall_quality",), sims: int = 100, sparsity: float = 0.4, weights: tuple[float, float, float] = REWARD, seed: int = 42, compat: bool = False) -> DataFrame:
    """For every packed graph and metric (graph_id, metric, kept rooms, kept edges, reward, baseline, actions), without a shuffle.

    The searches of a graph share the scores of the states that they meet, of which one pass gives all heads. Graphs
    without rooms have no row.
    """
    share_code(packed.sparkSession)
    kind = dict(packed.dtypes)["graph_id"]
    heads = [network.tasks.index(m) for m in metrics]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            graphs = zip(*(batch.column(c).to_pylist() for c in ("graph_id", "ids", "types", "x", "rel", "src", "dst")), strict=True)
            for graph, ids, types, x, rel, src, dst in graphs:
                keys = sorted({(min(a, b), max(a, b), r) for a, b, r in zip(src, dst, rel, strict=True) if a != b})
                links = {r: tuple(np.array([(a, b) for a, b, q in zip(src, dst, rel, strict=True) if q == r], np.int64).reshape(-1, 2).T) for r in network.relations}
                score = masked_scores(np.array(x).reshape(len(ids), -1), directed(len(ids), links, network.relations), network)
                for metric, head in zip(metrics, heads, strict=True):
                    tree = Tree([t or "" for t in types], keys, lambda rooms, h=head, s=score: float(s(rooms)[h]), weights, seed, compat)
                    rooms, live, reward, actions = tree.search(sims, sparsity)
                    row = (graph, metric, [ids[i] for i in sorted(rooms)], [{"a": ids[keys[i][0]], "b": ids[keys[i][1]], "rel": keys[i][2]} for i in sorted(live)], reward, tree.baseline, actions)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            edge = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("rel", pa.string())])
            kinds = [batch.schema.field("graph_id").type, pa.string(), pa.list_(pa.int64()), pa.list_(edge), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["graph_id", "metric", "rooms", "edges", "reward", "baseline", "actions"])

    return packed.select("graph_id", "ids", "types", "x", "rel", "src", "dst").mapInArrow(run, f"graph_id {kind}, {_FOUND}")


def found_graphs(found: DataFrame, edges: DataFrame) -> DataFrame:
    """X15 for every found state: (graph_id, metric) and the edges whose key it keeps. Edges that end at other nodes are none of a state's."""
    keys = found.select("graph_id", "metric", F.explode("edges").alias("e")).select("graph_id", "metric", "e.a", "e.b", "e.rel")
    both = edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    return both.join(keys, ["graph_id", "a", "b", "rel"]).drop("a", "b")


def counterfactual(packed: DataFrame, network: Network, metrics: tuple[str, ...] = ("overall_quality", "fire_safety_margin", "circulation_efficiency"), sims: int = 50, least: float = 0.02, seed: int = 42, compat: bool = False) -> DataFrame:
    """A test a graph and metric: (graph_id, metric, test_type, baseline_score, sub_score, delta_q, subgraph_nodes, subgraph_edges, significant).

    The search rewards the score alone. sub_score is that of the found rooms, delta_q how far it is below the whole graph's. As the
    whole graph is among the states, delta_q is never above 0, and no test is significant: the original's definition.
    """
    f = search_graphs(packed, network, metrics, sims, 0.5, (1.0, 0.0, 0.0), seed, compat)
    delta = F.col("baseline_score") - F.col("sub_score")
    f = f.select("graph_id", "metric", F.lit("remove").alias("test_type"), F.col("baseline").alias("baseline_score"), (F.col("reward") + F.col("baseline")).alias("sub_score"), F.size("rooms").cast("long").alias("subgraph_nodes"), F.size("edges").cast("long").alias("subgraph_edges"))
    return f.withColumn("delta_q", delta).withColumn("significant", F.col("delta_q") > least)


def counterfactual_report(tests: DataFrame, least: float = 0.02) -> DataFrame:
    """One row over (delta_q): tests, significant ones (over `least`) and their %, mean, population deviation and maximum."""
    d = F.col("delta_q")
    sig = F.count_if(d > least)
    return tests.agg(F.count("*").alias("total"), sig.alias("significant"), F.round(100 * sig / F.count("*"), 1).alias("sig_pct"), F.round(F.avg(d), 4).alias("mean_delta"), F.round(F.stddev_pop(d), 4).alias("std_delta"), F.round(F.max(d), 4).alias("max_positive"))


def candidate_actions(nodes: DataFrame, most: int = 5, seed: int = 42) -> DataFrame:
    """X06 as a relation: up to `most` droppable rooms a graph, by hash."""
    from pyspark.sql import Window

    w = Window.partitionBy("graph_id").orderBy(hash_uniform(seed, F.col("graph_id"), F.col("room_id"), "drop"), "room_id")
    return nodes.filter(~F.col("room_type").isin(*KEEP)).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).select("graph_id", "room_id", "k")
