"""The graph network by hand and by difference quotients, its training, and the searches that it scores."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import explain as X
from graphloom.operators import training as T
from graphloom.operators.network import EPS, Network, directed, ranking

FEATURES = "graph_id long, room_id long, room_type string, features array<double>"
EDGES = "graph_id long, rel string, src long, dst long"


def by_hand(net, x, edges):
    """The forward pass room by room; edges: (relation, source, destination)."""
    p, n = net.p, len(x)
    h = [x[i] @ p["room.w"] + p["room.b"] for i in range(n)]
    used = [(name, [(s, d) if not name.startswith("rev_") else (d, s) for r, s, d in edges if r == name.removeprefix("rev_")]) for r in net.relations for name in (r, f"rev_{r}")]
    used = [(name, e) for name, e in used if e]
    for k in range(net.layers if used else 0):
        out = []
        for i in range(n):
            row = np.zeros(net.hidden)
            for name, e in used:
                near = [h[s] for s, d in e if d == i]
                mean = sum(near) / len(near) if near else np.zeros(net.hidden)
                row = row + mean @ p[f"{k}.{name}.near"] + p[f"{k}.{name}.b"] + h[i] @ p[f"{k}.{name}.own"]
            out.append(row)
        flat = np.concatenate(out)
        mean, std = flat.mean(), flat.std()
        h = [h[i] + np.maximum(0, (out[i] - mean) / (std + EPS) * p[f"{k}.norm.w"] + p[f"{k}.norm.b"]) for i in range(n)]
    m = sum(h) / n
    return [1 / (1 + math.exp(-(np.maximum(0, m @ p[f"{t}.a"] + p[f"{t}.c"]) @ p[f"{t}.b"] + p[f"{t}.d"])[0])) for t in net.tasks]


def example(seed=0, n=5, **more):
    rng = np.random.default_rng(seed)
    net = Network(("one", "two"), dims=4, hidden=6, layers=2, head=3, seed=seed, **more)
    net.load(net.vector + rng.normal(size=net.size) * 0.1)
    edges = [("physical", 0, 1), ("physical", 0, 1), ("physical", 2, 1), ("sight", 3, 0), ("physical", 4 % n, 3)]
    links = {r: tuple(np.array([(s, d) for q, s, d in edges if q == r]).T) for r in {e[0] for e in edges}}
    return net, rng.normal(size=(n, 4)), edges, directed(n, links, net.relations)


def test_forward_is_the_definition():
    net, x, edges, means = example()
    assert net.forward(x, means) == pytest.approx(by_hand(net, x, edges), abs=1e-12)
    assert net.forward(x, {}) == pytest.approx(by_hand(net, x, []), abs=1e-12)
    assert set(means) == {"physical", "rev_physical", "sight", "rev_sight"}  # a relation without edges takes no part


@pytest.mark.parametrize("dropout", [0.0, 0.4])
def test_gradients_are_difference_quotients(dropout):
    net, x, _, means = example(3, dropout=dropout)
    slope = np.array([0.7, -1.3])
    f = lambda v: float(slope @ net.load(v).forward(x, means, np.random.default_rng(9)))
    at, kept, grad = net.vector.copy(), [], np.zeros(net.size)
    net.forward(x, means, np.random.default_rng(9), kept)
    net.backward(means, kept, slope, grad)
    unit = np.eye(net.size)
    found = np.array([(f(at + 1e-6 * u) - f(at - 1e-6 * u)) / 2e-6 for u in unit])
    assert np.abs(found - grad).max() < 1e-6 and np.abs(grad).max() > 1e-3


def test_ranking_slope():
    rng = np.random.default_rng(2)
    s, t = rng.random((6, 2)) * 0.1, rng.random((6, 2))
    t[0, 1] = np.nan
    loss, slope = ranking(s, t)
    want = [np.mean([max(0, 0.05 - (s[i, k] - s[j, k])) for i in range(6) for j in range(6) if t[i, k] - t[j, k] > 1e-6]) for k in range(2)]
    assert loss == pytest.approx(np.mean(want))
    for i, k in itertools.product(range(6), range(2)):
        up = s.copy()
        up[i, k] += 1e-7
        assert (ranking(up, t)[0] - loss) / 1e-7 == pytest.approx(slope[i, k], abs=1e-5)
    assert ranking(s, np.zeros((6, 2)))[0] == 0


def collection(spark, graphs=48, seed=1):
    """Graphs whose targets are the means of two features, which are high or low in a whole graph."""
    rng = np.random.default_rng(seed)
    rows, edges, goal = [], [], []
    for g in range(graphs):
        x = rng.random((int(rng.integers(3, 7)), 4))
        x[:, :2] = 0.8 * (rng.random(2) < 0.5) + 0.2 * x[:, :2]
        rows += [(g, 10 * i, "office", v.tolist()) for i, v in enumerate(x)]
        edges += [(g, ["physical", "sight"][i % 2], 10 * i, 10 * (i + 1)) for i in range(len(x) - 1)] + [(g, "physical", 0, 999)]
        goal.append((g, "one", float(x[:, 0].mean())))
        goal += [(g, "two", float(x[:, 1].mean()))] * (g % 5 > 0)
    packed = T.pack(spark.createDataFrame(rows, FEATURES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(goal, "graph_id long, task string, target double"), ("one", "two"))
    return packed.withColumn("split", F.when(F.col("graph_id") % 4 == 0, "val").otherwise("train")).cache()


def small(seed=5):
    return Network(("one", "two"), dims=4, hidden=8, layers=2, head=4, dropout=0.1, seed=seed)


def test_sums_of_tasks_are_the_sum_of_graphs(spark):
    packed, net = collection(spark), small()
    net.dropout = 0.0
    n, loss, grad = T.gradient(packed, net, rank=0.0)
    total, want = np.zeros(net.size), 0.0
    for r in packed.collect():
        rel = np.array(r.rel)
        means = directed(len(r.ids), {k: (np.array(r.src)[rel == k], np.array(r.dst)[rel == k]) for k in net.relations})
        kept = []
        out = net.forward(np.array(r.x).reshape(len(r.ids), 4), means, None, kept)
        one, slope = T.graph_loss(out, np.array([np.nan if v is None else v for v in r.targets], float))
        net.backward(means, kept, slope, total)
        want += one
    assert n == 48 and loss == pytest.approx(want) and np.abs(grad - total).max() < 1e-9
    assert T.gradient(packed, net, seed=None)[1] == pytest.approx(want)
    assert T.gradient(packed.limit(0), net)[:2] == (0, 0.0)
    scored = {(r.graph_id, r.task): r.score for r in T.score(packed, net).collect()}
    assert len(scored) == 96 and all(0 < v < 1 for v in scored.values())


def test_pack_leaves_out_unknown_ends_and_missing_targets(spark):
    r = {r.graph_id: r for r in collection(spark, 6).collect()}
    assert all(999 not in x.ids and max(x.src) < len(x.ids) for x in r.values())
    assert r[0].targets[1] is None and r[1].targets[1] is not None
    bare = T.pack(spark.createDataFrame([(1, 7, "office", [1.0] * 4)], FEATURES), spark.createDataFrame([(2, "physical", 1, 2)], EDGES)).collect()
    assert [(x.graph_id, x.ids, x.rel, x.targets) for x in bare] == [(1, [7], [], None)]


def test_training_falls_and_goes_on_from_a_checkpoint(spark, tmp_path):
    packed = collection(spark)
    whole = T.fit(packed, small(), epochs=6, batch=12, lr=0.05)
    losses = [h[1] for h in whole.history]
    assert len(losses) == 6 and losses[-1] < 0.75 * losses[0]
    assert whole.best_loss == min(h[2] for h in whole.history)
    path = f"file://{tmp_path}/run"
    T.fit(packed, small(), path, epochs=2, batch=12, lr=0.05)
    (tmp_path / "run" / "epoch-000009").mkdir()  # a checkpoint that was not finished
    net = small()
    again = T.fit(packed, net, path, epochs=6, batch=12, lr=0.05)
    assert again.epoch == 6 and again.step == whole.step and np.abs(again.weights - whole.weights).max() < 1e-9
    assert (net.vector == again.best).all() and np.allclose(again.history, whole.history)
    kept = sorted(p.name for p in (tmp_path / "run").iterdir() if (p / "_SUCCESS").exists())
    assert "epoch-000006" in kept and len(kept) <= 2
    observed = T.fit(packed, small(), epochs=1, batch=48, ranked=False)
    free = T.fit(packed, small(), epochs=1, batch=48, rank=0.0)
    assert np.abs(observed.weights - free.weights).max() < 1e-9 and observed.history[0][1] >= free.history[0][1]


def test_a_step_reads_the_partitions_of_its_batch(spark, monkeypatch):
    """a job a step without a shuffle, with the sums of the folders that stand in where these are too large for the driver."""
    packed = collection(spark)
    dealt = packed.withColumn("step", F.when(F.col("split") == "val", -1).otherwise(F.pmod("graph_id", F.lit(3)).cast("int"))).drop("split")
    args, counts = (3, 2, 4, 0.0, True), []
    (kept, close), (folders, drop) = T._kept(dealt, small(), *args), T._folders(dealt, small(), *args)
    for step, seed in ((0, 7), (1, 7), (2, 8), (-1, None)):
        (n, loss, grad), want = kept(step, small(), seed), folders(step, small(), seed)
        counts.append(n)
        assert n == want[0] and loss == pytest.approx(want[1]) and np.abs(grad - want[2]).max(initial=0) < 1e-9
    assert sum(counts) == 48 and counts[-1] == 12
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("one step", "")
    kept(1, small(), 7)
    sc.setLocalProperty("spark.jobGroup.id", None)
    (job,) = tracker.getJobIdsForGroup("one step")
    ran = [tracker.getStageInfo(i) for i in tracker.getJobInfo(job).stageIds]
    assert sum(x.numCompletedTasks for x in ran if x) == 2  # a task a shard
    close(), drop()
    whole = T.fit(packed, small(), epochs=2, batch=48, rank=0.0)
    monkeypatch.setattr(T, "SUMS", 0)
    assert np.allclose(T.fit(packed, small(), epochs=2, batch=48, rank=0.0).history, whole.history)


def test_schedule_and_step():
    s = T.State(np.array([1.0, -2.0]), np.zeros(2), np.zeros(2), np.zeros(2), 0.1)
    s = T.adam(s, np.array([3.0, 4.0]), decay=0.0)  # cut to 0.6, 0.8; the first step moves by the rate against the sign
    assert s.weights == pytest.approx([0.9, -2.1], abs=1e-6) and s.first == pytest.approx([0.06, 0.08], abs=1e-6)
    for val in (1.0, 0.5, *[0.6] * 11):
        s = T.after_epoch(s, 0.0, val)
    assert s.lr == 0.05 and s.bad == 0 and s.best_loss == 0.5 and len(s.history) == 13


def test_search_on_five_and_seven_rooms():
    """Five rooms keep all, as no more than the least number are there; of seven, the two that weigh on the score go."""
    ring = lambda n: [(i, (i + 1) % n, "physical") if i < n - 1 else (0, n - 1, "physical") for i in range(n)] + [(0, 2, "sight")]
    worth = [0.3, -0.2, 0.1, 0.4, -0.5, 0.2, 0.0]
    score = lambda rooms: sum(worth[i] for i in rooms)
    five = X.Tree(["office"] * 5, ring(5), score, (1.0, 0.0, 0.0))
    rooms, live, reward, steps = five.search(100)
    assert (rooms, len(live), reward, steps) == (frozenset(range(5)), 6, 0.0, 0) and five.baseline == pytest.approx(0.1)
    seven = X.Tree(["office"] * 7, ring(7), score, (1.0, 0.0, 0.0))
    rooms, live, reward, _ = seven.search(400, 0.5)
    assert rooms == {0, 2, 3, 5, 6} and reward == pytest.approx(0.7)
    assert {seven.keys[i] for i in live} <= {(2, 3, "physical"), (5, 6, "physical"), (0, 6, "physical"), (0, 2, "sight")}
    fixed = X.Tree(["office"] * 3 + ["corridor", "staircase", "entrance_hall", "corridor"], ring(7), lambda r: -len(r), (1.0, 0.0, 0.0)).search(400, 0.5)
    assert fixed[0] >= {3, 4, 5, 6} and len(fixed[0]) == 5


def test_reward_by_hand():
    t = X.Tree(["office"] * 6, [(0, 1, "physical"), (1, 2, "physical"), (3, 4, "physical"), (4, 5, "sight")], lambda rooms: 0.1 * len(rooms))
    # one room of six is gone: two fewer tenths of ten, 0.3 / 6, and of the five left 0, 1, 2 are reached
    rooms, live = t.apply(t.rooms, t.live, ("room", 5))
    assert len(live) == 3 and t.reward(rooms, live) == pytest.approx(1.0 * (0.5 - 0.6) + 0.3 / 6 - 2.0 * (1 - 3 / 5))
    assert X.unreached([(0, 1, "sight")], frozenset({0, 1})) == 1.0 and X.unreached([], frozenset()) == 1.0


def test_observed_descent_is_a_chain():
    chain = X.Tree(["office"] * 30, [(i, i + 1, "physical") for i in range(29)], lambda rooms: -len(rooms), (1.0, 0.0, 0.0), compat=True)
    assert chain.search(15, 0.1)[3] >= 8  # fifteen simulations go down one path
    wide = X.Tree(["office"] * 30, [(i, i + 1, "physical") for i in range(29)], lambda rooms: -len(rooms), (1.0, 0.0, 0.0))
    assert wide.search(15, 0.1)[3] <= 3


def test_counterfactual_and_found_graphs(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, "office" if i else "corridor", rng.random(4).tolist()) for g in (1, 2) for i in range(9)]
    edges = spark.createDataFrame([(g, "physical", 0, i) for g in (1, 2) for i in range(1, 9)] + [(g, "sight", i, i % 8 + 1) for g in (1, 2) for i in range(1, 9)], EDGES)
    packed, net = T.pack(spark.createDataFrame(rows, FEATURES), edges), small()
    tests = X.counterfactual(packed, net, ("one", "two"), sims=120).collect()
    scored = {(r.graph_id, r.task): r.score for r in T.score(packed, net).collect()}
    found = {(r.graph_id, r.metric): r for r in X.search_graphs(packed, net, ("one", "two"), 120, 0.5, (1.0, 0.0, 0.0)).collect()}
    feats = spark.createDataFrame(rows, FEATURES)
    for t in tests:
        f = found[t.graph_id, t.metric]
        masked = X.masked_features(feats, spark.createDataFrame([(t.graph_id, i) for i in f.rooms], "graph_id long, room_id long")).filter(F.col("graph_id") == t.graph_id)
        again = {r.task: r.score for r in T.score(T.pack(masked, edges.filter(F.col("graph_id") == t.graph_id)), net).collect()}
        assert t.baseline_score == pytest.approx(scored[t.graph_id, t.metric]) and t.sub_score == pytest.approx(again[t.metric])
        assert t.delta_q == pytest.approx(t.baseline_score - t.sub_score) and t.delta_q <= 0 and not t.significant
        assert t.subgraph_nodes == len(f.rooms) and 0 in f.rooms and t.subgraph_edges == len(f.edges)
    assert len(tests) == 4 and any(t.delta_q < 0 for t in tests)
    d = [t.delta_q for t in tests]
    report = X.counterfactual_report(spark.createDataFrame([(v,) for v in [*d, 0.03]], "delta_q double")).first()
    assert (report.total, report.significant, report.sig_pct) == (5, 1, 20.0) and report.std_delta == pytest.approx(np.std([*d, 0.03]), abs=1e-4)
    states = X.search_graphs(packed, net, ("one",))
    got = {(r.graph_id, r.rel): r["count"] for r in X.found_graphs(states, edges).groupBy("graph_id", "rel").count().collect()}
    assert sum(got.values()) == sum(len(r.edges) for r in states.collect())


def test_search_asks_one_scorer_a_graph():
    """Masked scores come from weights summed once a graph, and rooms out of reach from bits: both as by the plain definitions."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 70):
        links = {r: (rng.integers(0, n, 2 * n), rng.integers(0, n, 2 * n)) for r in ("physical", "sight")[: n % 3]}
        net, x, means = Network(hidden=8), rng.random((n, 27)), directed(n, links)
        keys = sorted({(min(a, b), max(a, b), r) for r, (s, d) in links.items() for a, b in zip(s.tolist(), d.tolist(), strict=True) if a != b})
        tree = X.Tree(["office"] * n, keys, lambda rooms: 0.0)
        score = net.scorer(x, means)
        for _ in range(20):
            kept = (rng.random((n, 1)) < 0.7).astype(float)
            assert np.allclose(score(kept), net.forward(x * kept, means), rtol=0, atol=1e-12)
            rooms = frozenset(np.flatnonzero(kept).tolist())
            live = frozenset(i for i, (a, b, _) in enumerate(keys) if a in rooms and b in rooms and rng.random() < 0.6)
            assert tree.unreached(rooms, live) == X.unreached([keys[i] for i in live], rooms)
