"""Unit fixtures of single operators, storage round trips, reports and streaming."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import functions as E
from graphloom import model as M
from graphloom.operators import algorithms as A
from graphloom.operators import constraints as C
from graphloom.operators import features as P
from graphloom.operators import generate as G
from graphloom.operators import layout as Y
from graphloom.operators import mining as K
from graphloom.operators import reports as R
from graphloom.operators import topology as J
from graphloom.sources import tables as T

EDGE = "graph_id long, src long, dst long"


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def nodes(spark, rows):
    """rows: (room_id, room_type, area, x, y, floor)."""
    d = spark.createDataFrame([(1, i, k + 1, t, float(a), float(x), float(y), f, f, f, "ground" if f == 0 else "teaching") for k, (i, t, a, x, y, f) in enumerate(rows)], "graph_id long, room_id long, ord int, room_type string, area double, x double, y double, floor int, floor_lo int, floor_hi int, typical_floor string")
    return P.with_catalog(d.withColumn("aspect_ratio", F.lit(1.2)), M.catalog(spark))


def tables(spark, rows, edges=()):
    n = nodes(spark, rows)
    g = M.GraphTables(spark.createDataFrame([(1, "small", 2)], "graph_id long, school_size string, num_floors int"), n, spark.createDataFrame([(1, -1, 1, "south_facing", 100.0, 150.0), (1, -2, 2, "main_road_access", 0.0, 75.0), (1, -3, 3, "green_space", 5.0, 5.0)], "graph_id long, env_id long, env_ord int, env_type string, x double, y double"), n.limit(0))
    parts = [J.edges(spark.createDataFrame([(1, a, b)], EDGE), rel, "t", kind) for a, b, rel, kind in edges] or [J.edges(spark.createDataFrame([], EDGE), "physical", "t")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return g.with_(edges=out)


def test_scalars(spark):
    assert [one(spark, E.clamp_norm(F.lit(v), m)) for v, m in ((10.0, 5.0), (-1.0, 5.0), (60.0, 800.0), (1.0, 0.0))] == [1.0, 0.0, 0.075, 0.0]
    assert [one(spark, E.half_even(F.lit(v))) for v in (2.5, 3.5, -0.5)] == [2.0, 4.0, 0.0]
    assert one(spark, E.hash_uniform("42", "7", "area")) == 0.9926677427720279
    assert one(spark, E.occupancy(F.lit(0.1), F.lit(1.0))) == 1 and one(spark, E.occupancy(F.lit(62.4), F.lit(1.2))) == 52
    assert one(spark, E.overlap(F.lit(0), F.lit(1), F.lit(1), F.lit(3))) and not one(spark, E.overlap(F.lit(0), F.lit(0), F.lit(1), F.lit(3)))
    assert one(spark, E.typical_floor_of(F.lit(3.5))) == "top" and one(spark, E.label_prefix(F.lit("music_room_1"))) == "music"


def test_catalog(spark):
    assert M.catalog(spark).count() == 13
    with pytest.raises(KeyError):
        M.catalog(spark, {"classroom": M.CATALOG["classroom"]})
    with pytest.raises(KeyError):
        M.catalog(spark, {"attic": M.CATALOG["classroom"]}, complete=False)
    assert M.lookup(M.catalog(spark), "toilet").first().exits == 1
    with pytest.raises(Exception, match="no room type"):
        M.lookup(M.catalog(spark), "attic").collect()
    assert M.config_row(spark, {"proximity": 9}).first().proximity == 9 and M.config_row(spark).first().noise_gap == 2


def test_fire_exits_and_connectivity(spark):
    rooms = [(1, "classroom", 62, 0, 0, 0), (2, "corridor", 40, 5, 0, 0), (3, "corridor", 40, 9, 0, 0), (4, "storage", 10, 50, 0, 0)]
    ok = tables(spark, rooms, [(1, 2, "physical", "room"), (1, 3, "physical", "room"), (1, 3, "physical", "room")])
    # corridors of 133 persons have one neighbour, the store of 100 has none
    assert {r.entity for r in C.fire_exits(ok).collect()} == {"2", "3", "4"}
    bad = tables(spark, rooms, [(1, 2, "physical", "room"), (1, 2, "physical", "room")])
    assert {r.entity for r in C.fire_exits(bad).collect()} == {"1", "2", "3", "4"}
    assert {(r.entity, r.other) for r in C.connectivity(bad).collect()} == {("3", "isolated"), ("4", "isolated")}
    env = tables(spark, rooms, [(1, 2, "physical", "room"), (3, -2, "physical", "environment"), (4, -2, "physical", "environment")])
    assert {(r.entity, r.other) for r in C.connectivity(env).collect()} == {("1", "unreachable"), ("2", "unreachable")}


def test_acoustic_and_area(spark):
    rooms = [(1, "classroom", 62, 0, 0, 0), (2, "music_room", 80, 10, 0, 0), (3, "music_room", 95, 100, 0, 0)]
    door = tables(spark, rooms, [(1, 2, "physical", "room")])
    assert {(r.entity, r.other) for r in C.acoustic(door).collect()} == {("2", "1")}
    wall = tables(spark, rooms, [(1, 2, "physical", "room"), (2, 1, "acoustic", "room")])
    assert C.acoustic(wall).count() == 0
    assert [r.entity for r in C.area_bounds(door).collect()] == ["3"]
    assert {r.entity for r in C.area_completeness(door, 237.0).collect()} == {"all"}  # one floor of two


def test_rules(spark):
    rooms = [(1, "classroom", 62, 0, 0, 0), (2, "corridor", 40, 5, 0, 0), (3, "corridor", 40, 9, 0, 0), (4, "toilet", 30, 8, 0, 0), (5, "staircase", 20, 4, 1, 0), (6, "staircase", 20, 4, 1, 1), (7, "library", 150, 30, 30, 1), (8, "entrance_hall", 50, 6, 0, 0), (9, "gymnasium", 500, 7, 0, 0)]
    g = tables(spark, rooms)
    pairs = lambda d: sorted((r.src, r.dst) for r in d.collect())
    assert [p for p in pairs(J.room_to_corridors(g)) if p[0] in (1, 4, 7)] == [(1, 2), (1, 3), (4, 3), (7, 2), (7, 3)]
    assert pairs(J.corridor_network(g, "spine")) == [(2, 3)] and pairs(J.service_rooms(g)) == [(4, 3)] and pairs(J.vertical_chain(g)) == [(5, 6)]
    assert pairs(J.entrance(g)) == [(8, -2), (8, 2)] and pairs(J.library_to_green(g)) == [(7, -3)]
    assert {(r.dst, r.access_type) for r in J.large_halls(g).collect()} == {(2, None), (-2, 0.5)}
    assert J.apply_rules(g, "spine").count() > 15
    cover = J.toilet_service(g.nodes).first()
    assert cover.n_rooms == 8 and cover.uncovered == 1 and cover.worst == [7]


def test_flatten_keeps_or_hides_doors(spark):
    g = tables(spark, [(1, "classroom", 62, 0, 0, 0), (2, "corridor", 40, 5, 0, 0)], [(1, 2, "physical", "room"), (2, 1, "sight", "room")])
    assert P.flatten(g.edges).first().etype == "sight" and P.flatten(g.edges, compat=False).first().etype == "physical"
    err = P.schema_errors(P.room_features(g.nodes), P.env_features(g.env), g.with_(edges=J.edges(spark.createDataFrame([(1, 1, 9)], EDGE), "physical", "t")))
    assert [(r.error, r.n) for r in err.collect()] == [("unknown dst", 1)]


def links(spark, pairs):
    d = spark.createDataFrame([(1, a, b) for a, b in pairs], "graph_id long, node long, nbr long")
    return P.undirected(d.select("graph_id", F.col("node").alias("src"), F.col("nbr").alias("dst")))


def test_algorithms_on_a_cycle_with_a_tail(spark):
    e = links(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (5, 6), (6, 7)])
    assert sorted((r.a, r.b) for r in A.bridges(e).collect()) == [(5, 6), (6, 7)]
    hops = {(r.a, r.b): r.hops for r in A.all_pairs(e).collect()}
    assert hops[1, 3] == 2 and hops[3, 7] == 4 and len(hops) == 42
    bc = {r.node: r.bc for r in A.betweenness(e).collect()}
    assert bc[7] == 0 and bc[6] == pytest.approx(5 / 15) and bc[5] == max(bc.values())
    assert {r.component for r in A.components(e).collect()} == {1} == {r.component for r in A.components_large(e).collect()}
    want = spark.createDataFrame([(1, 1, 4), (1, 1, 9)], EDGE)
    got = {r.dst: (r.hops, r.path) for r in A.shortest_path(e, want).collect()}
    assert got[4] == (2, [1, 5, 4]) and got[9] == (None, [])


def test_lambda2_matches_the_path(spark):
    e = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 1.0)], "graph_id long, node long, nbr long, w double")
    assert A.lambda2(e).first().l2 == pytest.approx(1.0, abs=1e-6)


def test_kmeans_and_spectral():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(20, 3)) + 9, rng.normal(size=(20, 3)) - 9])
    lab = K.lloyd(x, 2)
    assert len(set(lab[:20])) == len(set(lab[20:])) == 1 and lab[0] != lab[20]
    k = np.exp(-((x[:, None] - x) ** 2).sum(2) / 50)
    lab = K.spectral_labels(k, 2)
    assert len(set(lab[:20])) == len(set(lab[20:])) == 1 and lab[0] != lab[20]


def test_spectral_clusters_without_a_matrix(spark):
    rng = np.random.default_rng(3)
    rows = [(g, b, int(1 + rng.poisson(9 if b // 6 == g % 3 else 1) + 4 * (g % 50 == 7))) for g in range(240) for b in range(18) if b // 6 == g % 3 or rng.random() < 0.3]
    hist = spark.createDataFrame(rows, "graph_id long, bin long, n long")
    x = np.zeros((240, 18))
    for g, b, n in rows:
        x[g, b] = n
    norm = np.sqrt((x * x).sum(1)) + 1e-8
    m = x @ x.T / norm / norm[:, None]
    np.fill_diagonal(m, (x * x).sum(1))
    want, k = K.spectral_labels(m, 4), 4
    d = 1 / np.sqrt(m.sum(1) + 1e-8)
    v = np.linalg.eigh(np.eye(240) - d[:, None] * m * d)[1][:, :k]
    v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-8
    e = np.array([r.embedding for r in K.spectral_vectors(hist, k).orderBy("graph_id").collect()])
    assert np.allclose(e @ e.T, v @ v.T, atol=1e-4)
    got = [r.cluster for r in K.histogram_clusters(hist, k).orderBy("graph_id").collect()]
    assert got == want.tolist()
    one = K.histogram_clusters(hist.filter("graph_id = 5"), k).collect()
    assert [tuple(r) for r in one] == [(5, 0)]


def test_queries_of_doors_build_no_other_edges(spark, sf):
    from graphloom.plans import registry
    from graphloom.sources import fixtures

    fixtures._held.clear()
    first = registry.QUERIES["motif_centroids"](spark, sf).orderBy("cluster").collect()
    (held,) = fixtures._held.values()
    assert {r.rel for r in held.edges.select("rel").distinct().collect()} == {"physical"}
    whole = fixtures.event_graphs(spark, sf)
    assert {r.rel for r in whole.edges.select("rel").distinct().collect()} == {"physical", "acoustic", "sight"}
    assert registry.QUERIES["motif_centroids"](spark, sf).orderBy("cluster").collect() == first
    assert list(fixtures._held.values()) == [whole] and fixtures.event_graphs(spark, sf, doors=True) is whole


def test_dedup(spark):
    d = spark.createDataFrame([("a", 1, ["x", "y", "z", "w"]), ("b", 2, ["x", "y", "z", "w"]), ("c", 3, ["q"]), ("d", 4, ["q", "x"])], "pattern string, rank long, items array<string>")
    assert sorted(r.pattern for r in K.dedup(d).collect()) == ["a", "c", "d"]


def test_generated_collection(spark):
    with pytest.raises(ValueError):
        G.requests(spark, 3, sizes=("huge",))
    with pytest.raises(ValueError):
        G.environment(G.requests(spark, 1), "up")
    r = G.requests(spark, 4)
    n = G.allocate_areas(G.enforce_minimums(G.rooms(G.floor_program(r), M.catalog(spark))))
    floors = n.groupBy("graph_id", "typical_floor").agg(F.sum("area").alias("a"), F.count_if(F.col("room_type") == "staircase").alias("s"), F.max((F.col("floor_hi") - F.col("floor_lo") + 1)).alias("span")).collect()
    assert all(f.s >= 2 and f.a > 0 for f in floors)
    again = G.rooms(G.floor_program(r), M.catalog(spark)).repartition(3)
    key = ["graph_id", "room_name", "area"]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, G.rooms(G.floor_program(r), M.catalog(spark)).select(*key).collect()))
    env = G.environment(r).groupBy("graph_id").pivot("env_type").count().collect()
    assert all(e.south_facing == e.main_road_access == 1 for e in env)


def test_layout(spark):
    n = nodes(spark, [(i, "classroom" if i < 5 else "toilet", 63, i, 0, 0) for i in range(1, 8)])
    rows = {r.room_id: (r.x0, r.w) for r in Y.pack_rows(n).collect()}
    assert rows[1] == (0.0, 9.0) and rows[5] == (36.0, 5.5)
    assert [r.room_id for r in Y.interleave(n).orderBy("pos").collect()] == [1, 5, 2, 6, 3, 7, 4]
    assert {r.row for r in Y.grid(12, 3, spark).collect()} == {0, 1, 2}
    canvas = spark.createDataFrame([("corridor", "corridor_1", 0.0, 0.0)], "room_type string, label string, x double, y double")
    p = Y.place_pattern(canvas, Y.default_patterns(spark).filter("pattern = 'P4'"), 5.0, 5.0)
    assert sorted(r.label for r in p.collect()) == ["corridor_1", "staircase_1", "toilet_1"]
    assert {(r.room_type, r.add) for r in Y.missing_essentials(p).collect()} == {("staircase", 1)} and Y.clear(p).count() == 0
    assert Y.floor_plan(n).count() == 7


def test_kmeans_settles_and_keeps_rows_without_a_vector(spark):
    x = np.sort(np.random.default_rng(5).random(400)).tolist()
    d = spark.createDataFrame([(i, [v]) for i, v in enumerate(x)] + [(1000, None)], "vec_id long, embedding array<double>")
    lab = {r.vec_id: r.cluster for r in K.kmeans(d, 8).collect()}
    assert len(lab) == 401 and lab[1000] is None
    centre = {j: np.mean([v for i, v in enumerate(x) if lab[i] == j]) for j in {lab[i] for i in range(400)}}
    assert all(lab[i] == min(centre, key=lambda j: abs(centre[j] - v)) for i, v in enumerate(x))


def test_storage_round_trip(spark, tmp_path):
    g = tables(spark, [(1, "classroom", 62, 0, 0, 0), (2, "corridor", 40, 5, 0, 0)], [(1, 2, "physical", "room")])
    path = T.save_graphs(g, str(tmp_path / "g"))
    back = T.load_graphs(spark, path, "all", validate=True)
    assert back.nodes.count() == 2 and back.edges.count() == 1 and back.graphs.first().n_rooms == 2
    with pytest.raises(ValueError):
        T.load_graphs(spark, path, "test")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        T.load_graphs(spark, str(tmp_path / "none"))
    doc = T.graph_documents(g.nodes, P.flatten(g.edges)).first().document
    assert '"room_type":"classroom"' in doc and '"edge_type":"physical"' in doc
    T.write_json(T.graph_documents(g.nodes, P.flatten(g.edges)), str(tmp_path / "j"))
    assert T.read_json(spark, str(tmp_path / "j"), False).count() == 1
    assert T.motif_patterns(spark, None).select("motif_id").distinct().count() == 5
    assert "split_info" in T.metadata({"seed": 1}, spark.createDataFrame([("a", 1.0)], "stat string, value double"), spark.createDataFrame([("train",)], "split string"))


def test_reports(spark):
    g = tables(spark, [(1, "classroom", 62, 0, 0, 0), (2, "corridor", 40, 5, 0, 0)])
    v = C.all_violations(g)
    text = R.violation_report(C.status(g, v), v).first().report
    assert "[FAIL] fire_exits (2)" in text and "    -> 1: 0.00 vs 2.00" in text
    assert "A" in R.grade_report(spark.createDataFrame([(1, "m", 90.0)], "graph_id long, metric string, score double")).first().report
    assert R.composition_lines(spark.createDataFrame([("m", "toilet", 2.0), ("m", "office", 0.2)], "motif_id string, room_type string, mean double")).first().text == "2 toilet"
    assert R.rate_marks(spark.createDataFrame([("c", 0.6)], "constraint string, rate double")).first().line.startswith("weak")


def test_streaming(spark, tmp_path):
    from graphloom import streaming as W

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, 1, 2), (1, 1, 3)], EDGE).write.parquet(str(tmp_path / "in" / "a"))
    src = spark.readStream.schema(EDGE).parquet(str(tmp_path / "in" / "*"))
    got = []
    n = nodes(spark, [(1, "classroom", 62, 0, 0, 0), (2, "corridor", 40, 5, 0, 0)])
    q = W.fire_exit_changes(src, n, lambda df, k: got.extend((r.room_id, r.d, r.ok) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(got) == [(1, 2, True), (2, 1, False)]


def test_entropy_reference():
    assert -2 * 0.5 * math.log(0.5) == pytest.approx(math.log(2))


def test_shortest_path_beyond_64_hops(spark):
    n = 67
    e = spark.createDataFrame([(1, a, b) for i in range(n) for a, b in ((i, i + 1), (i + 1, i))], "graph_id long, node long, nbr long").repartition(1)
    r = A.shortest_path(e, spark.createDataFrame([(1, 0, n)], EDGE)).first()
    assert r.hops == n and r.path == list(range(n + 1))


def test_retries_run_all_rules_and_checks(spark):
    from graphloom.plans import more

    assert more.generated_status
    t, best = G.with_retries(G.requests(spark, 2), attempts=2)
    assert sorted(r.source for r in best.collect()) == [0, 1]
    rows = C.status(t).collect()
    assert len(rows) == 2 * len(C.CONSTRAINTS) and len({r.graph_id for r in rows}) == 2
    assert t.edges.count() > 0 and t.nodes.filter("x is null or y is null").count() == 0


def _graph(spark, rooms, doors):
    """A small graph from (room_id, type, floor) and pairs of rooms."""
    from graphloom.model import GraphTables

    n = spark.createDataFrame([(1, i, t, f, f, f, 60, 1, 1, 3, 10.0) for i, t, f in rooms], "graph_id long, room_id long, room_type string, floor int, floor_lo int, floor_hi int, occupancy int, exits int, noise int, daylight int, area double")
    n = n.withColumn("tolerance", F.lit(2))
    e = spark.createDataFrame([(1, "physical", "room", a, b, "x") for a, b in doors], "graph_id long, rel string, dst_kind string, src long, dst long, rule string")
    env = spark.createDataFrame([], "graph_id long, env_id long, env_type string, x double, y double")
    return GraphTables(n.select("graph_id").distinct(), n, env, e)


def test_metrics_by_hand(spark):
    from graphloom.operators import metrics as M

    one = lambda f, g: f(g, compat=False).first().value
    path = [(1, "staircase", 0), (2, "office", 0), (3, "office", 1), (4, "office", 1)]
    # Hops of the others are 1, 2, 3: mean 2 of 4 rooms.
    assert one(M.stair_service_radius, _graph(spark, path, [(1, 2), (2, 3), (3, 4)])) == pytest.approx(0.5)
    # Unreached rooms count as many hops as there are rooms: (1 + 4 + 4) / 3 = 3 of 4.
    assert one(M.stair_service_radius, _graph(spark, path, [(1, 2)])) == pytest.approx(0.25)
    assert one(M.stair_service_radius, _graph(spark, [(1, "office", 0), (2, "office", 0)], [(1, 2)])) == 0
    assert one(M.stair_service_radius, _graph(spark, [(1, "staircase", 0), (2, "staircase", 0)], [(1, 2)])) == 1
    # Stairs a floor: 1 and 0, so the sample deviation over the mean is sqrt(2).
    assert one(M.vertical_flow_balance, _graph(spark, path, [])) == 0
    assert one(M.vertical_flow_balance, _graph(spark, [(1, "office", 0), (2, "office", 1)], [])) == 1
    assert one(M.vertical_flow_balance, _graph(spark, [(1, "staircase", 0), (2, "office", 0)], [])) == 1


def test_evaluators_by_hand(spark):
    from graphloom.operators import stats as S

    g = _graph(spark, [(1, "corridor", 0), (2, "office", 0), (3, "office", 0), (4, "office", 0)], [(1, 2), (1, 3), (2, 3)])
    fire = S.evaluate_fire(g).first()
    assert (fire.compliant, fire.total, fire.score, fire.passed, fire.violations) == (3, 4, 75.0, False, [4])
    con = S.evaluate_connectivity(g).first()
    assert (con.components, con.isolated, con.score, con.passed) == (2, 1, 35.0, False)
    div = S.evaluate_diversity(g).first()
    # Degrees 2, 2, 2, 0; a triangle and a lone room.
    assert div.entropy == pytest.approx(0.5623351446) and div.clustering == pytest.approx(0.75) and (div.d_min, div.d_max) == (0, 2)
    cir = S.evaluate_circulation(g).first()
    assert (cir.corridor_ratio, cir.avg_path, cir.diameter, cir.score, cir.passed) == (0.25, 1.0, 1, 100.0, True)
    assert S.evaluate_daylight(g).first().score == 0
    loud = g.with_(nodes=g.nodes.withColumn("noise", F.when(F.col("room_id") == 1, 4).otherwise(1)))
    aco = S.evaluate_acoustic(loud).first()
    # Room 1 is too loud for the three others; rooms 2 and 3 have a door to it.
    assert (aco.adequate, aco.total, [tuple(v) for v in aco.violations]) == (1, 3, [(1, 2), (1, 3)])
    row = S.evaluate_all(g).first()
    assert row.overall == pytest.approx((35 + 75 + 0 + 100 + 100 + min(100, 40 * 0.5623351446 + 50 * 0.75)) / 6) and row.grade == "C"
    none = S.evaluate_fire(g.with_(nodes=g.nodes.withColumn("occupancy", F.lit(1)))).first()
    assert (none.rate, none.total, none.passed, none.violations) == (1.0, 0, True, [])


def test_names_and_patterns_by_hand(spark):
    from graphloom.operators import layout as Y
    from graphloom.operators import mining as K

    comps = [
        ({"music_room": 1.0, "classroom": 2.0}, "动静分区模体", "动静分区单元"), ({"classroom": 4.0, "corridor": 1.0, "staircase": 1.0}, "教学翼标准模体", "4教室教学单元"),
        ({"classroom": 2.5, "corridor": 1.0}, "教室-走廊模体", "2教室集群"), ({"entrance_hall": 1.0, "office": 1.0}, "入口行政模体", "办公·entrance_hall组合"),
        ({"toilet": 1.0, "staircase": 1.0, "corridor": 1.0}, "公共服务核模体", "交通服务核"), ({"corridor": 3.0, "office": 2.0}, "走廊脊柱模体", "办公走廊区"), ({"storage": 1.0}, "复合功能模体", "储藏组合"),
    ]
    d = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(comps)], "i long, comp map<string,double>")
    got = {r.i: (r.m, r.p) for r in d.select("i", K.motif_name(F.col("comp")).alias("m"), K.pattern_name(F.col("comp")).alias("p")).collect()}
    # Ties are in order of the type's name: entrance_hall before office.
    assert got == {i: (m, "entrance_hall·办公组合" if i == 3 else p) for i, (_, m, p) in enumerate(comps)}
    refs = d.filter("i = 1").select(K.constraint_refs(F.col("comp")).alias("r")).first().r
    assert sorted(refs) == sorted(["GB50099-2011 §5.1 采光", "GB50016-2014 §5.5 消防", "GB50016-2014 §5.5.17 疏散", "GB50099-2011 §8.2.3 走廊比"])
    comp = spark.createDataFrame([(1, "classroom", 9.9), (1, "staircase", 1.0), (1, "toilet", 1.2), (1, "corridor", 7.0), (2, "storage", 3.0)], "motif_id long, room_type string, mean double")
    sub = {(r.motif_id, r.pattern, r.room_type): r["count"] for r in Y.sub_patterns(comp).collect()}
    assert {k[1:]: n for k, n in sub.items() if k[0] == 1} == {("U1", "classroom"): 6, ("U1", "corridor"): 1, ("U1", "toilet"): 1, ("U2", "classroom"): 4, ("U2", "corridor"): 1, ("C1", "staircase"): 1, ("C1", "toilet"): 1}
    assert {k[1] for k in sub if k[0] == 2} == {"P1", "P2", "P3", "P4", "P5"}
    rows = Y.template(comp.filter("motif_id = 1")).orderBy("i").collect()
    assert [r.room_type for r in rows] == ["classroom"] * 6 + ["toilet", "staircase"]
    # Five classrooms of 8.3 pass 40; the next line is one below them.
    assert [round(r.x, 1) for r in rows] == [0, 8.3, 16.6, 24.9, 33.2, 0, 8.3, 12.6] and [r.y for r in rows] == [0] * 5 + [9.0] * 3
    row = spark.createDataFrame([(1, "top", 1), (1, "top", 2)], "graph_id long, typical_floor string, ord int")
    assert sorted(r.cx for r in Y.even_positions(row, 50.0).collect()) == [2.75, 47.25]


def test_places_follow_the_site(spark):
    from graphloom.operators import generate as G

    rows = [(1, f"r{i}", f, z, t, 42) for f in ("ground", "teaching") for i, (z, t) in enumerate([("admin", "office"), ("special", "gymnasium"), ("service", "entrance_hall"), ("circulation", "staircase"), ("teaching", "classroom"), ("circulation", "corridor")])]
    p = G.place(spark.createDataFrame(rows, "graph_id long, room_name string, typical_floor string, zone string, room_type string, seed long")).collect()
    at = {(r.typical_floor, r.room_type): (r.x, r.y) for r in p}
    # Two slices of 75: centres at 37.5 and 112.5.
    assert 10 <= at["ground", "office"][0] <= 50 and 150 <= at["ground", "gymnasium"][0] <= 190 and at["ground", "entrance_hall"] == (10, 37.5)
    assert at["teaching", "staircase"][0] in (10, 100, 190) and at["teaching", "staircase"][1] == 112.5 == at["teaching", "corridor"][1]
    assert 120 <= at["teaching", "classroom"][1] <= 142.5 and 86.25 <= at["teaching", "gymnasium"][1] <= 108.75


def test_rectangles_meet_once_over_the_grid(spark):
    """The pairs of a plain comparison, each way once, for cells smaller and larger than the rectangles, also left of and below zero."""
    rng = np.random.default_rng(4)
    rects = [(1 + i % 2, i, *map(float, np.round(rng.uniform(-30, 30, 2), 1)), *map(float, np.round(rng.uniform(0, 12, 2), 1))) for i in range(60)] + [(3, 1, 0.0, 0.0, 10.0, 1.0), (3, 2, 10.5, 0.0, 0.0, 1.0), (3, 3, 11.1, 0.0, 1.0, 1.0)]
    near = lambda a, b: a[2] - 0.5 <= b[2] + b[4] and b[2] - 0.5 <= a[2] + a[4] and a[3] - 0.5 <= b[3] + b[5] and b[3] - 0.5 <= a[3] + a[5]
    want = sorted((a[0], a[1], b[1]) for a in rects for b in rects if a[0] == b[0] and a[1] != b[1] and near(a, b))
    d = spark.createDataFrame(rects, "graph_id long, rect_id long, x double, y double, w double, h double")
    for cell in (1.5, 10.0, 100.0):
        assert sorted(map(tuple, J.adjacent_rectangles(d, cell=cell).collect())) == want
