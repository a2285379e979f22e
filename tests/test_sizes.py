"""What showed on larger tables: sums on a bound, strips without area, values that must not depend on the order of rows."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import model as M
from graphloom.operators import algorithms as A
from graphloom.operators import constraints as C
from graphloom.operators import features as P
from graphloom.operators import layout as Y
from graphloom.operators import metrics as Q
from graphloom.operators import mining as K
from graphloom.operators import stats as S
from graphloom.operators import topology as J
from graphloom.plans import more, registry
from graphloom.sources import fixtures


def test_areas_that_add_up_to_the_bound_are_within_it(spark):
    n = spark.range(12000).coalesce(1).select(F.lit(1).cast("long").alias("graph_id"), F.lit("ground").alias("typical_floor"), F.lit(0).alias("floor_lo"), F.lit(0).alias("floor_hi"), F.lit(0.07).alias("area"))
    graphs = spark.createDataFrame([(1, "small", 1)], "graph_id long, school_size string, num_floors int")
    assert C.area_completeness(M.GraphTables(graphs, n, n.limit(0), n.limit(0))).collect() == []  # 840 of 800 m2
    more = n.withColumn("area", F.lit(0.0701))
    assert C.area_completeness(M.GraphTables(graphs, more, n.limit(0), n.limit(0))).count() == 2


def test_a_strip_without_area(spark):
    rows = [(1, "ground", k, float(a)) for k, a in enumerate((6, 5, 4, 3, 2, 1, 0, 0))]
    d = {r.ord: r for r in Y.strips(spark.createDataFrame(rows, "graph_id long, typical_floor string, ord int, area double")).collect()}
    assert [d[k].row for k in (0, 5, 6, 7)] == [0, 0, 1, 1] and d[6].h == d[6].x0 == 0.0
    assert math.isnan(d[6].w) and math.isnan(d[7].w) and d[0].w == pytest.approx(50 * 6 / 21)


def test_fire_margins_do_not_depend_on_the_order_of_rooms(spark):
    want = {32: (1, 0.65625), 64: (62, 0.34375), 96: (93, 0.34375)}  # rooms of the graph: those with one third, the mean
    rooms = [(n, i, 60, 2) for n in want for i in range(n)]
    lines = [(n, i, 1000) for n, (a, _) in want.items() for i in range(n) for _ in range(2 if i < a else 3)]
    nodes = spark.createDataFrame(rooms, "graph_id long, room_id long, occupancy int, exits int")
    edges = spark.createDataFrame(lines, "graph_id long, src long, dst long").withColumns({"rel": F.lit("physical"), "dst_kind": F.lit("room")})
    g = M.GraphTables(nodes.select("graph_id").distinct(), nodes, nodes.limit(0), edges)
    assert {r.graph_id: r.value for r in Q.fire_safety_margin(g).collect()} == {n: v for n, (_, v) in want.items()}


def _random_graphs(spark):
    """Two graphs of 14 rooms and a lone one, with loops, double doors and several components."""
    rng = np.random.default_rng(5)
    types = ("classroom", "corridor", "toilet", "music_room")
    rooms = [(k, i, types[i % 4], (1, 2, 1, 3)[i % 4], (1, 3, 1, 0)[i % 4]) for k in (1, 2) for i in range(14)] + [(3, 0, "corridor", 2, 3)]
    doors = [(k, int(a), int(b)) for k in (1, 2) for a, b in rng.integers(0, 14, (11, 2))] + [(1, 0, 1), (1, 1, 0), (2, 3, 3)]
    nodes = spark.createDataFrame(rooms, "graph_id long, room_id long, room_type string, noise int, tolerance int")
    edges = spark.createDataFrame(doors, "graph_id long, src long, dst long").withColumns({"rel": F.lit("physical"), "dst_kind": F.lit("room")})
    return M.GraphTables(nodes.select("graph_id").distinct(), nodes, nodes.limit(0), edges)


def test_hop_metrics_make_no_row_for_a_pair(spark, monkeypatch):
    g = _random_graphs(spark)
    names = ("acoustic_comfort", "stair_service_radius", "toilet_coverage", "local_evacuation_loop")
    rows = lambda: {(r.graph_id, r.metric): round(r.value, 9) for r in Q.compute_all(g, names).collect()}
    with monkeypatch.context() as m:
        m.setattr(A, "LARGEST", 2)  # the joins for large graphs, which do
        want = rows()
    monkeypatch.setattr(A, "all_pairs", None)
    assert rows() == want and len(want) == 12


def test_paths_of_components(spark, monkeypatch):
    links = P.undirected(_random_graphs(spark).edges)
    rows = lambda: sorted(map(tuple, A.component_paths(links).collect()))
    small = rows()
    monkeypatch.setattr(A, "LARGEST", 2)
    assert small == rows() and small


def test_refinement_shuffles_labels_once(spark, monkeypatch):
    g = _random_graphs(spark)
    lab = g.nodes.select("graph_id", F.col("room_id").alias("node"), F.col("room_type").alias("label"))
    h = K.wl_histogram(lab, P.undirected(g.edges))
    assert h._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    small = sorted(map(tuple, h.collect()))
    monkeypatch.setattr(K, "LARGEST", 2)
    assert small == sorted(map(tuple, K.wl_histogram(lab, P.undirected(g.edges)).collect())) and small


def test_summaries_round_the_double(spark):
    """174 ends of doors over 80 rooms are 2.175, which as a double is below the tie: 2.17."""
    nodes = spark.createDataFrame([(1, i) for i in range(80)], "graph_id long, room_id long")
    edges = spark.createDataFrame([(1, i, (i + 1) % 80) for i in range(80)] + [(1, i, i + 2) for i in range(7)], "graph_id long, src long, dst long").withColumns({"rel": F.lit("physical"), "dst_kind": F.lit("room")})
    env = spark.createDataFrame([(1, -1)], "graph_id long, env_id long")
    got = S.graph_summary(M.GraphTables(nodes.select("graph_id").distinct(), nodes, env, edges)).first()
    assert (got.n_rooms, got.n_components, got.avg_degree) == (80, 2, 2.17)


def test_near_and_loud_pairs_of_cells(spark):
    """Groups of cells give the pairs of the plain definition once, on borders of cells, across zero and loud both ways."""
    rng = np.random.default_rng(11)
    types, noise, tolerance = ("classroom", "music_room", "corridor", "toilet"), (1, 3, 2, 1), (1, 0, 3, None)
    kinds = rng.integers(0, 4, 90)
    at = rng.choice([-15.0, -7.5, 0.0, 9.0, 15.0, 30.0, 44.9], (90, 2))
    rows = [(1 + i % 2, i, 90 - i, *map(float, at[i]), i % 3, i % 3 + i % 2, types[k], noise[k] if i % 17 else None, tolerance[k]) for i, k in enumerate(kinds)]
    names = "graph_id long, room_id long, ord int, x double, y double, floor_lo int, floor_hi int, room_type string, noise int, tolerance int"
    nodes = spark.createDataFrame(rows, names).withColumn("floor", F.col("floor_lo"))
    over = lambda a, b: a[8] is not None and b[9] is not None and a[8] - b[9] >= 2
    want = []
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[2] < b[2] and max(a[5], b[5]) <= min(a[6], b[6]) and math.dist(a[3:5], b[3:5]) <= 15 and (over(a, b) or over(b, a)):
                want.append((a[0], a[1], b[1], 55.0 if {a[7], b[7]} == {"classroom", "music_room"} else 45.0))
    got = J.proximity_pairs(M.GraphTables(nodes, nodes, nodes, nodes)).select("graph_id", "src", "dst", "attenuation_db").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 40


def test_a_report_of_all_graphs_deals_its_rooms_once(spark, sf, monkeypatch):
    """no rule shuffles the rooms by anything but the graph, neighbouring cells least of all, and the edges are not persisted."""
    monkeypatch.setattr(fixtures, "_held", {})
    report = registry.QUERIES["counterfactual_report"](spark, sf)
    (row,) = report.collect()
    assert row.total == 3 * spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    (g,) = fixtures._held.values()
    final = report._jdf.queryExecution().executedPlan().executedPlan().toString()  # as it ran
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", final)
    assert not [k for k in keys if re.search(r"\b(room_id|a_room_id|cx|i)#", k)] and any("user_id#" in k for k in keys), keys
    assert not g.edges.is_cached
    g.nodes.unpersist()


def _plain(part):
    return not re.search(r"Join|Aggregate|Window|InMemory", part._jdf.queryExecution().optimizedPlan().toString())


def test_evaluators_start_from_written_tables(spark, sf, monkeypatch):
    """six evaluators over the joins that make the edges take most of their time in planning these again."""
    seen = []
    stub = [F.lit(1.0).alias(n) for n in (*S.EVALUATORS, "overall")]
    monkeypatch.setattr(fixtures, "_held", {})
    monkeypatch.setattr(S, "evaluate_all", lambda g: seen.append(g) or g.graphs.select("graph_id", *stub, F.lit("A").alias("grade")))
    n = registry.QUERIES["evaluate_all"](spark, sf).count()
    assert n == spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert all(map(_plain, (seen[0].graphs, seen[0].nodes, seen[0].env, seen[0].edges)))
    next(iter(fixtures._held.values())).nodes.unpersist()


def test_packed_graphs_lie_in_many_files(spark, sf, monkeypatch):
    """searches take long for few rows; in one file, one task makes them all. And the metrics start from written tables."""
    seen = []
    monkeypatch.setattr(fixtures, "_held", {})
    metrics = Q.compute_all
    monkeypatch.setattr(Q, "compute_all", lambda g, names: seen.append(g) or metrics(g, ("circulation_efficiency",)).withColumn("metric", F.lit(names[0])))
    packed = more._packed(fixtures.event_graphs(spark, sf, False, True))
    files = [r.n for r in packed.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(files) == spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert len(files) > 5 and max(files) < sum(files) / 2
    assert all(_plain(part) for g in seen for part in (g.graphs, g.nodes, g.env, g.edges)) and len(seen) == len(Q.WEIGHTS)
    next(iter(fixtures._held.values())).nodes.unpersist()


def test_a_graph_goes_to_few_tiles(spark):
    """240 graphs in groups of up to 60 are copied four times, not thirty; strips of a tile give the same matrix."""
    hist = spark.range(240).selectExpr("id as graph_id", "explode(array(id % 7, 10 + id % 5, 20)) as bin").selectExpr("graph_id", "bin", "1 + (graph_id + bin) % 4 as n")
    x = np.zeros((240, 21))
    for r in hist.collect():
        x[r.graph_id, r.bin] = r.n
    d, m = x @ x.T, np.sqrt((x * x).sum(1)) + 1e-8
    want = np.where(np.eye(240, dtype=bool), d, d / np.outer(m, m))
    got = np.full((240, 240), np.nan)
    k = K.kernel_matrix(hist, block=8, wide=60, least=2)
    rows = k.collect()
    for r in rows:
        got[r.g1, r.g2] = r.k
    assert len(rows) == 240 * 240 and np.abs(got - want).max() < 1e-12
    copies = re.findall(r"sequence\(0, (\d+)", k._jdf.queryExecution().analyzed().toString())
    assert copies == ["3"]
