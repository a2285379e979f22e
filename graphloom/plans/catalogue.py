"""Registered queries: DataFrame code through the operators beside SQL written for DuckDB.

Doubles are rounded to six places on both sides, because sums do not add up in the same order everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import hash_uniform
from graphloom.model import GraphTables
from graphloom.operators import algorithms as A
from graphloom.operators import constraints as C
from graphloom.operators import features as P
from graphloom.operators import metrics as M
from graphloom.operators import stats as S
from graphloom.operators import topology as J
from graphloom.plans.prelude import hops, sql, u
from graphloom.session import held
from graphloom.sources.fixtures import event_graphs, trade_graphs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register fn(spark, sf_dir) and its SQL."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn

    return add


def on_events(oracle: str | None = None, doors: bool = False, once: bool = False):
    """Register fn(graphs) over the event graphs; doors: fn reads no edges but the physical ones; once: it reads edges once only, by graph."""

    def add(fn):
        query(oracle, fn.__name__)(lambda spark, sf_dir: fn(event_graphs(spark, sf_dir, doors, once)))
        return fn

    return add


def written(g: GraphTables) -> GraphTables:
    """g with its parts written as tables, for queries of many steps: each step's plan starts there, not at the joins that make the edges."""
    nodes, edges = held(g.nodes), held(g.edges)
    return GraphTables(held(g.graphs), nodes, held(g.env), edges)


def r6(c, name: str | None = None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


# Constraints ---------------------------------------------------------------------------------------
V = "graph_id, constraint, entity, other, round(actual, 6) as actual, round(required, 6) as required"
VIOLATIONS = {
    "fire_exits": ("nodes ddeg", "select n.graph_id, 'fire_exits' as constraint, room_id::varchar as entity, null::varchar as other, coalesce(degree, 0)::double as actual, exits::double as required from nodes n left join ddeg using (graph_id, room_id) where occupancy >= 50 and coalesce(degree, 0) < exits"),
    "daylight": ("nodes edges", "select n.graph_id, 'daylight' as constraint, room_id::varchar as entity, null::varchar as other, 0::double as actual, 1::double as required from nodes n where daylight >= 3 and not exists (select 1 from edges e where e.graph_id = n.graph_id and e.rel = 'sight' and (e.src = n.room_id or e.dst = n.room_id))"),
    "acoustic": ("near a1 door", "select l.graph_id, 'acoustic' as constraint, l.s::varchar as entity, l.t::varchar as other, l.gap::double as actual, 2::double as required from (select graph_id, src as s, dst as t, gab as gap from near union all select graph_id, dst, src, gba from near) l where gap >= 2 and not exists (select 1 from a1 where a1.graph_id = l.graph_id and ((a1.src = s and a1.dst = t) or (a1.src = t and a1.dst = s))) and exists (select 1 from door d where d.graph_id = l.graph_id and d.node = s and d.nbr = t)"),
    "area_bounds": ("nodes", "select graph_id, 'area_bounds' as constraint, room_id::varchar as entity, null::varchar as other, area as actual, case when area < area_min then area_min else area_max end as required from nodes where area < area_min or area > area_max"),
    "circulation_ratio": ("nodes", "select graph_id, 'circulation_ratio' as constraint, 'all' as entity, null::varchar as other, r as actual, (case when r < 0.1 then 0.1 else 0.3 end)::double as required from (select graph_id, sum(case when room_type = 'corridor' then area else 0 end) / sum(area) as r from nodes group by 1) where r < 0.1 or r > 0.3"),
    "floor_corridor_ratio": ("nodes", "select graph_id, 'floor_corridor_ratio' as constraint, typical_floor as entity, null::varchar as other, r as actual, (case when r < 0.1 then 0.1 else 0.25 end)::double as required from (select graph_id, typical_floor, sum(case when room_type = 'corridor' then area else 0 end) / sum(area) as r from nodes group by 1, 2) where r < 0.1 or r > 0.25"),
    "area_completeness": ("nodes", "select graph_id, 'area_completeness' as constraint, entity, null::varchar as other, area as actual, want as required from (select graph_id, typical_floor as entity, sum(area) as area, 800.0::double as want from nodes group by 1, 2 union all select graph_id, 'all', sum(area), 2400.0::double from nodes group by 1) where abs(area - want) > 0.05 * want"),
}
CONN = hops("door", "c") | {
    "part": "select graph_id, node, least(node, coalesce(min(b), node)) as component from (select distinct graph_id, node from door) n left join hopsc h using (graph_id) where h.a = n.node or h.a is null group by 1, 2",
    "conn": "select n.graph_id, 'connectivity' as constraint, n.room_id::varchar as entity, case when p.node is null then 'isolated' else 'unreachable' end as other, 0::double as actual, 1::double as required from nodes n left join part p on p.graph_id = n.graph_id and p.node = n.room_id left join (select graph_id, min(component) as main from part group by 1) m on m.graph_id = n.graph_id where p.node is null or p.component <> m.main",
}


def _violations(df: DataFrame) -> DataFrame:
    return df.select("graph_id", "constraint", "entity", "other", r6("actual"), r6("required"))


for _name, _fn in {"fire_exits": C.fire_exits, "area_bounds": C.area_bounds, "circulation_ratio": C.circulation_ratio, "floor_corridor_ratio": C.floor_corridor_ratio, "area_completeness": C.area_completeness}.items():
    _uses, _text = VIOLATIONS[_name]
    query(sql(_uses, f"select {V} from v", v=_text), f"{_name}_violations")(lambda spark, sf_dir, f=_fn: _violations(f(event_graphs(spark, sf_dir))))
# The rules leave no room without light and no loud neighbour without a barrier: what looks for either reads graphs with edges taken out.
VIOLATIONS["daylight"] = (VIOLATIONS["daylight"][0], VIOLATIONS["daylight"][1].replace("e.rel = 'sight'", "e.rel = 'sight' and e.src % 5 <> 0"))
VIOLATIONS["acoustic"] = (VIOLATIONS["acoustic"][0], VIOLATIONS["acoustic"][1].replace("from a1 where", "from a1 where a1.src % 2 = 1 and"))


def thinned(g):
    return g.with_(edges=g.edges.filter("(rel <> 'sight' or src % 5 <> 0) and (rel <> 'acoustic' or src % 2 = 1)"))


for _name, _fn in {"daylight": C.daylight, "acoustic": C.acoustic}.items():
    _uses, _text = VIOLATIONS[_name]
    query(sql(_uses, f"select {V} from v", v=_text), f"{_name}_violations")(lambda spark, sf_dir, f=_fn: _violations(f(thinned(event_graphs(spark, sf_dir)))))
query(sql("nodes door", f"select {V} from conn", **CONN), "connectivity_violations")(lambda spark, sf_dir: _violations(C.connectivity(event_graphs(spark, sf_dir))))

_ALLV = {f"v_{k}": t for k, (_, t) in VIOLATIONS.items()}
_STATUS = {
    **CONN, **_ALLV, "v": " union all ".join(f"select graph_id, constraint from v_{k}" for k in VIOLATIONS) + " union all select graph_id, constraint from conn",
    "names": "select unnest(['fire_exits', 'daylight', 'acoustic', 'connectivity', 'area_bounds', 'circulation_ratio', 'area_completeness', 'floor_corridor_ratio']) as constraint",
    "st": "select g.graph_id, k.constraint, count(v.graph_id) as n_violations, count(v.graph_id) = 0 as passed from graphs g cross join names k left join v on v.graph_id = g.graph_id and v.constraint = k.constraint group by 1, 2",
}
_SU = "nodes graphs ddeg edges near a1 door"


@on_events(sql(_SU, "select graph_id, constraint, passed, n_violations from st", **_STATUS))
def constraint_summary(g):
    """C09."""
    return C.status(thinned(g))


@on_events(sql(_SU, "select graph_id, bool_and(passed) as all_passed, bool_and(passed or constraint in ('area_bounds', 'circulation_ratio')) as hard_passed, round(avg(passed::int), 6) as pass_fraction from st group by 1", **_STATUS))
def hard_constraints_passed(g):
    """C10, C11, C14."""
    return C.verdicts(C.status(thinned(g))).select("graph_id", "all_passed", "hard_passed", r6("pass_fraction"))


@on_events(sql(_SU, "select constraint, count(*) filter (where passed) as passed, count(*) filter (where not passed) as failed, round(100.0 * avg(passed::int), 6) as pass_pct, sum(n_violations)::bigint as violations from st group by 1", **_STATUS))
def constraint_failures(g):
    """A17."""
    return S.failure_table(C.status(thinned(g))).select("constraint", "passed", "failed", r6("pass_pct"), "violations")


@on_events(sql(_SU, "select n_passed, count(*) as graphs from (select graph_id, count(*) filter (where passed) as n_passed from st group by 1) group by 1", **_STATUS))
def pass_histogram(g):
    """A15, A16."""
    return S.pass_histogram(C.status(thinned(g)))


@on_events(sql(_SU, "select round(avg(v), 6) as mean, median(v)::double as median, min(v) as least, max(v) as most from (select graph_id, sum(n_violations)::bigint as v from st group by 1)", **_STATUS))
def violation_stats(g):
    """A15."""
    return S.violation_stats(C.status(thinned(g))).select(r6("mean"), "median", "least", "most")


@on_events(sql("nodes", """select graph_id, typical_floor, w as warning from (select graph_id, typical_floor, unnest(list_filter([
 case when sum((room_type='toilet')::int) = 0 then 'no toilet' end, case when sum((room_type='toilet')::int) > 3 then 'too many toilets' end, case when sum((room_type='classroom' and area < 54)::int) > 0 then 'small classroom' end,
 case when sum((room_type='corridor')::int) = 0 then 'no corridor' end, case when sum((room_type='staircase')::int) = 0 then 'no staircase' end], lambda x: x is not null)) as w from nodes group by 1, 2)
 union all select graph_id, 'all', 'missing ' || t from (select distinct graph_id from nodes) g cross join (select unnest(['classroom','corridor','staircase','toilet']) as t) k where not exists (select 1 from nodes n where n.graph_id = g.graph_id and n.room_type = k.t)"""))  # fmt: skip
def realism_warnings(g):
    """C13."""
    return C.realism(g)


# Topology ------------------------------------------------------------------------------------------
def _dist(df: DataFrame) -> DataFrame:
    return df.select("graph_id", "src", "dst", r6("distance_weight", "dist"))


E3 = "select graph_id, src, dst, round(dist, 6) as dist from "


@on_events(sql("p1", E3 + "p1"))
def knn_corridor_edges(g):
    """J01."""
    return _dist(J.room_to_corridors(g))


@on_events(sql("p2", E3 + "p2"))
def corridor_spine(g):
    """J02."""
    return _dist(J.corridor_network(g, "spine"))


_HUB = {"c": "select *, row_number() over (partition by graph_id, floor order by x, ord) - 1 as k, count(*) over (partition by graph_id, floor) as n from hall"}


@on_events(sql("hall p2", "select graph_id, src, dst, round(dist, 6) as dist from p2 union all select a.graph_id, a.room_id, b.room_id, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) from c a join c b on a.graph_id = b.graph_id and a.floor = b.floor and a.n >= 3 and a.k = a.n - 1 and b.k = 0", **_HUB))
def corridor_loop(g):
    """J02, loop."""
    return _dist(J.corridor_network(g, "loop"))


@on_events(sql("hall", "select a.graph_id, a.room_id as src, b.room_id as dst, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) as dist from c a join c b on a.graph_id = b.graph_id and a.floor = b.floor and a.n >= 2 and b.k = a.n // 2 and a.k <> b.k", **_HUB))
def hub_branch(g):
    """J02, branch."""
    return _dist(J.corridor_network(g, "branch"))


@on_events(sql("hall", f"select a.graph_id, a.room_id as src, b.room_id as dst, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) as dist from c a join c b on a.graph_id = b.graph_id and a.floor = b.floor and a.n >= 3 and a.k <= a.n - 3 and {u('42', 'a.graph_id', 'a.room_id', chr(39) + 'cross' + chr(39))} < 0.4 and b.k = a.k + 2 + floor({u('42', 'a.graph_id', 'a.room_id', chr(39) + 'step' + chr(39))} * (least(2, a.n - a.k - 3) + 1))", **_HUB))
def corridor_cross_links(g):
    """J03."""
    return _dist(J.corridor_cross_links(g))


@on_events(sql("p1c", f"select graph_id, src, dst, round(dist, 6) as dist from (select *, row_number() over (partition by graph_id, src order by dist, bo) as k from p1c where shared and {u('42', 'graph_id', 'src', chr(39) + 'second' + chr(39))} < 0.3) where k = 2"))
def second_corridor(g):
    """J04."""
    return _dist(J.second_corridor(g))


@on_events(sql("same", E3 + "same where k = 1 and src_type = 'staircase'"))
def stair_floor_edges(g):
    """J05."""
    return _dist(J.stair_floors(g))


@on_events(sql("nodes", "select a.graph_id, a.room_id as src, b.room_id as dst, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) as dist from nodes a join nodes b on a.graph_id = b.graph_id and a.room_type = 'staircase' and b.room_type = 'staircase' and b.floor = a.floor + 1"))
def vertical_chain(g):
    """J06."""
    return _dist(J.vertical_chain(g))


@on_events(sql("same", "select graph_id, src, dst, round(dist, 6) as dist, case src_type when 'music_room' then 0.5 else 0.7 end::double as access from same where k = 1 and src_type in ('music_room', 'staircase')"))
def nearest_same_floor(g):
    """The nearest corridor of the floor, with access by type."""
    return J.nearest_same_floor(g, ("music_room", "staircase")).select("graph_id", "src", "dst", r6("dist"), F.when(F.col("a_room_type") == "music_room", 0.5).otherwise(0.7).alias("access"))


@on_events(sql("p7", E3 + "p7"))
def service_edges(g):
    """J09."""
    return _dist(J.service_rooms(g))


@on_events(sql("a1", "select graph_id, src, dst, db from a1"))
def proximity_pairs(g):
    """J10."""
    return J.proximity_pairs(g).select("graph_id", "src", "dst", F.col("attenuation_db").alias("db"))


@on_events(sql("s1", "select graph_id, src, dst, round(orientation, 6) as orientation, round(dist, 6) as dist from s1"))
def daylight_to_south(g):
    """J11."""
    return J.daylight_to_south(g).select("graph_id", "src", "dst", r6("orientation"), r6("distance", "dist"))


@on_events(sql("s2", "select graph_id, src, dst, transparency, round(dist, 6) as dist from s2"))
def daylight_via_corridor(g):
    """J12."""
    return J.daylight_via_corridor(g).select("graph_id", "src", "dst", "transparency", r6("sight_distance", "dist"))


@on_events(sql("nodes env", "select n.graph_id, room_id as src, env_id as dst, 0.5::double as orientation from nodes n join env using (graph_id) where room_type = 'music_room'"))
def cross_to_environment(g):
    """J13 with the fixture's types: music rooms for libraries, the south node for green space."""
    h = g.with_(nodes=g.nodes.filter("room_type = 'music_room'").withColumn("room_type", F.lit("library")), env=g.env.withColumn("env_type", F.lit("green_space")))
    return J.library_to_green(h).select("graph_id", "src", "dst", "orientation")


@on_events(sql("edges", "select rule, rel, dst_kind, count(*) as n, count(distinct (graph_id, src, dst)) as n_distinct from edges group by all"))
def all_rules(g):
    """The bag of the fixture's rules."""
    return g.edges.groupBy("rule", "rel", "dst_kind").agg(F.count("*").alias("n"), F.countDistinct("graph_id", "src", "dst").alias("n_distinct"))


_RECT = "select graph_id, room_id as rect_id, x * 3 as x, y / 10 as y, sqrt(area) as w, sqrt(area) / 2 as h from nodes"


@on_events(sql("nodes", "select a.graph_id, a.rect_id as src, b.rect_id as dst from r a join r b on a.graph_id = b.graph_id and a.rect_id <> b.rect_id and a.x - 0.5 <= b.x + b.w and b.x - 0.5 <= a.x + a.w and a.y - 0.5 <= b.y + b.h and b.y - 0.5 <= a.y + a.h", r=_RECT))
def canvas_adjacency(g):
    """J15, P24."""
    r = g.nodes.select("graph_id", F.col("room_id").alias("rect_id"), (F.col("x") * 3).alias("x"), (F.col("y") / 10).alias("y"), F.sqrt("area").alias("w"), (F.sqrt("area") / 2).alias("h"))
    return J.adjacent_rectangles(r)


@on_events(sql("nodes", "select graph_id, count(*) as n_rooms, sum((d > 30)::int)::bigint as uncovered, round(1 - sum((d > 30)::int) / count(*), 6) as coverage, coalesce(max(d) <= 30, false) as ok from f group by 1", f="select a.graph_id, a.room_id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) as d from nodes a left join nodes b on a.graph_id = b.graph_id and b.room_type = 'toilet' where a.room_type <> 'toilet' group by 1, 2"))
def toilet_service(g):
    """J16."""
    return J.toilet_service(g.nodes).select("graph_id", "n_rooms", "uncovered", r6("coverage"), "ok")


# Features ------------------------------------------------------------------------------------------
@on_events(sql("nodes", """select graph_id, room_id, row_number() over (partition by graph_id order by ord) - 1 as idx, (case when room_type in ('classroom','corridor','staircase','toilet','music_room') then type_idx end)::bigint as hot,
 round(least(1, area / 800), 9) as area, round(1.5 / 12, 6) as aspect, round(least(1, occupancy / 300), 6) as occ, daylight / 4 as day, noise / 4 as noise, tolerance / 4 as tol, floor / 4 as floor, exits / 4 as exits, zone_idx::bigint as zone from nodes"""))  # fmt: skip
def room_features(g):
    """The 27 features, read back by position."""
    f = P.room_features(g.nodes)
    at = lambda k, n: r6(F.element_at("features", k + 1), n)
    hot = lambda lo, n, name: (F.array_position(F.slice("features", lo + 1, n), 1.0) - 1).alias(name)
    return f.select("graph_id", "room_id", F.col("idx").cast("long").alias("idx"), hot(0, 13, "hot"), F.round(F.element_at("features", 14), 9).alias("area"), at(14, "aspect"), at(15, "occ"), at(16, "day"), at(17, "noise"), at(18, "tol"), at(19, "floor"), at(26, "exits"), hot(20, 6, "zone"))


@on_events(sql("env", "select graph_id, env_id, 0::bigint as idx, 1.0::double as south, round(x / 200, 6) as x, round(least(1, y / 150), 6) as y from env"))
def env_features(g):
    """P08."""
    f = P.env_features(g.env)
    return f.select("graph_id", "env_id", F.col("idx").cast("long").alias("idx"), F.element_at("features", 1).alias("south"), r6(F.element_at("features", 5), "x"), r6(F.element_at("features", 6), "y"))


@on_events(sql("phys a1 s1 s2", """select graph_id, 'physical' as rel, src, dst, round(dist, 6) as a0, 0.0::double as a1 from phys union all select graph_id, 'acoustic', src, dst, round(db / 60, 6), null from a1
 union all select graph_id, 'sight', src, dst, round(orientation, 6), round(least(1, dist / 250), 6) from s1 union all select graph_id, 'sight', src, dst, transparency, round(least(1, dist / 250), 6) from s2"""))  # fmt: skip
def edge_attr_encoding(g):
    """P10-P14."""
    return P.edge_attributes(g).select("graph_id", "rel", "src", "dst", r6("a0"), r6("a1"))


@on_events(sql("nodes edges", "select e.graph_id, e.rel, e.src, e.dst, a.i as src_idx, coalesce(b.i, 0) as dst_idx, e.dst_kind from edges e join k a on a.graph_id = e.graph_id and a.room_id = e.src left join k b on b.graph_id = e.graph_id and b.room_id = e.dst", k="select graph_id, room_id, row_number() over (partition by graph_id order by ord) - 1 as i from nodes"))
def assembled_edges(g):
    """P09, P18."""
    return P.assemble(g).select("graph_id", "rel", "src", "dst", F.col("src_idx").cast("long"), F.col("dst_idx").cast("long"), "dst_kind")


@on_events(sql("edges", "select graph_id, rel, dst_kind, count(*) as n from edges group by all"))
def split_edges(g):
    """P16, P17."""
    return P.split_by_destination(g.edges, g.env).groupBy("graph_id", "rel", "dst_kind").agg(F.count("*").alias("n"))


@on_events(sql("nodes", "select graph_id, room_id, room_type, floor::bigint as floor, case when floor < 1 then 'ground' else 'teaching' end as typical from nodes"))
def decoded_features(g):
    """Types and floors read back from the features."""
    f = P.room_features(g.nodes)
    return f.select("graph_id", "room_id", P.decode_type(F.col("features")).alias("room_type"), P.decode_floor(F.col("features")).cast("long").alias("floor"), P.decode_typical_floor(F.col("features")).alias("typical"))


@on_events(sql("nodes edges", "select graph_id, 'unknown src' as error, count(*) as n from edges where src % 11 = 0 group by 1 union all select graph_id, 'unknown dst', count(*) from edges where dst_kind = 'room' and dst % 11 = 0 group by 1 union all select graph_id, 'room width', count(*) from nodes where room_id % 11 <> 0 and room_id % 13 = 0 group by 1"))
def schema_errors(g):
    """Every eleventh room is gone from under its edges, every thirteenth lacks a feature."""
    known = g.with_(nodes=g.nodes.filter("room_id % 11 <> 0"))
    rooms = P.room_features(known.nodes).withColumn("features", F.when(F.col("room_id") % 13 == 0, F.slice("features", 1, 26)).otherwise(F.col("features")))
    return P.schema_errors(rooms, P.env_features(g.env), known)


@on_events(sql("simple", "select graph_id, a, b, etype from simple"))
def flatten_events(g):
    """P27 on event graphs."""
    return P.flatten(g.edges)


@on_events(sql("simple", "select graph_id, count(*) as n from simple where etype = 'physical' group by 1"))
def physical_subgraph(g):
    """P28."""
    return P.induced_by_type(P.flatten(g.edges), "physical").groupBy("graph_id").agg(F.count("*").alias("n"))


@on_events(sql("nodes", "select a.graph_id, a.room_id as src, count(*) as same_floor, min(abs(a.floor - b.floor))::bigint as gap from nodes a join nodes b on a.graph_id = b.graph_id and a.ord < b.ord and greatest(a.floor, b.floor) <= least(a.floor, b.floor) and a.room_type = 'staircase' group by 1, 2"))
def floor_overlap_pairs(g):
    """Pairs on shared floors."""
    from graphloom.functions import floors_spanned, overlap

    a = g.nodes.filter("room_type = 'staircase'").select("graph_id", F.col("room_id").alias("src"), "ord", F.col("floor_lo").alias("al"), F.col("floor_hi").alias("ah"))
    b = g.nodes.select("graph_id", F.col("ord").alias("bo"), F.col("floor_lo").alias("bl"), F.col("floor_hi").alias("bh"))
    p = a.join(b, "graph_id").filter("ord < bo").filter(overlap(F.col("al"), F.col("ah"), F.col("bl"), F.col("bh")))
    return p.groupBy("graph_id", "src").agg(F.count("*").alias("same_floor"), F.min(F.abs(floors_spanned(F.col("al"), F.col("bh")) - 1)).cast("long").alias("gap"))


_TRADE = {
    "tr": "select c.c_nationkey::bigint as graph_id, c.c_custkey as src, -1 - l.l_suppkey as dst, case l.l_returnflag when 'R' then 'physical' when 'A' then 'acoustic' else 'sight' end as rel from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on c.c_custkey = o.o_custkey"
}


@query(sql("", "select graph_id, least(src, dst) as a, greatest(src, dst) as b, case max(case rel when 'physical' then 1 when 'acoustic' then 2 else 3 end) when 1 then 'physical' when 2 then 'acoustic' else 'sight' end as etype from tr group by 1, 2, 3", **_TRADE))
def flatten_multirelational(spark, sf_dir):
    """P27 on trade graphs, where parallel edges are the rule."""
    return P.flatten(trade_graphs(spark, sf_dir).edges)


@query(sql("", "select graph_id, rel, count(*) as n, count(distinct (src, dst)) as pairs from tr group by 1, 2", **_TRADE))
def typed_edge_counts(spark, sf_dir):
    """GA10, P25 on trade graphs."""
    return trade_graphs(spark, sf_dir).edges.groupBy("graph_id", "rel").agg(F.count("*").alias("n"), F.countDistinct("src", "dst").alias("pairs"))


@query(sql("", "select graph_id, room_id, count(*) as d, count(distinct o) as degree from (select graph_id, src as room_id, dst as o from tr union all select graph_id, dst, src from tr) group by 1, 2", **_TRADE))
def trade_degrees(spark, sf_dir):
    """Both degree notions: every edge, and distinct neighbours."""
    g = trade_graphs(spark, sf_dir)
    return M.multi_degree(g.edges).join(C.distinct_degree(g.edges), ["graph_id", "room_id"])


# Algorithms ----------------------------------------------------------------------------------------
@on_events(sql("door", "select graph_id, a, b, hops from hops", **hops()))
def shortest_path_lengths(g):
    """GA02."""
    return A.all_pairs(P.undirected(g.view("physical")))


@on_events(sql("nodes door", "select graph_id, hops, count(*) as pairs from hops group by 1, 2", **hops()))
def hop_histogram(g):
    """GA02, aggregated."""
    return A.all_pairs(P.undirected(g.view("physical"))).groupBy("graph_id", "hops").agg(F.count("*").alias("pairs"))


@on_events(sql("nodes door", "select f.graph_id, f.src, f.dst, h.hops from f left join hops h on h.graph_id = f.graph_id and h.a = f.src and h.b = f.dst", f="select graph_id, min(room_id) as src, max(room_id) as dst from nodes group by 1", **hops()))
def single_pair_path(g):
    """GA01: hops between the smallest and the largest room of each graph."""
    w = g.nodes.groupBy("graph_id").agg(F.min("room_id").alias("src"), F.max("room_id").alias("dst"))
    return A.shortest_path(P.undirected(g.view("physical")), w).select("graph_id", "src", "dst", "hops")


@on_events(sql("nodes door", "select graph_id, node, component from part", **CONN))
def components(g):
    """GA05."""
    return A.components(P.undirected(g.view("physical")))


@on_events(sql("nodes door", "select graph_id, node, component from part", **CONN))
def components_large(g):
    """GA05 by label propagation over the link table."""
    return A.components_large(P.undirected(g.view("physical")))


@on_events(sql("nodes door", "select graph_id, room_id from nodes n where not exists (select 1 from door d where d.graph_id = n.graph_id and d.node = n.room_id and d.node % 7 <> 0 and d.nbr % 7 <> 0)"))
def isolated_nodes(g):
    """GA04, with the doors of every seventh room closed."""
    return A.isolated(g.nodes, P.undirected(g.view("physical").filter("src % 7 <> 0 and dst % 7 <> 0")))


_SIGMA = {
    **hops(),
    "h0": "select * from hops union all select distinct graph_id, node, node, 0 from door",
    **{f"s{k}": (f"select graph_id, a, b, 1.0::double as s from h0 where hops = 0" if k == 0 else f"select h.graph_id, h.a, h.b, sum(p.s) as s from h0 h join door d on d.graph_id = h.graph_id and d.node = h.b join s{k - 1} p on p.graph_id = h.graph_id and p.a = h.a and p.b = d.nbr where h.hops = {k} group by 1, 2, 3") for k in range(16)},
    "sg": "select h.graph_id, h.a, h.b, h.hops, x.s from h0 h join (" + " union all ".join(f"select * from s{k}" for k in range(16)) + ") x using (graph_id, a, b)",
    "nn": "select graph_id, count(distinct node) as n from door group by 1",
    "bcs": "select x.graph_id, y.b as node, sum(x2.s * y.s / x.s) as t from sg x join sg y on y.graph_id = x.graph_id and y.a = x.a and y.b <> x.a and y.b <> x.b join sg x2 on x2.graph_id = x.graph_id and x2.a = y.b and x2.b = x.b and x2.hops + y.hops = x.hops where x.a <> x.b group by 1, 2",
}


@on_events(sql("door", "select d.graph_id, d.node, round(case when n > 2 then coalesce(t, 0) / ((n - 1) * (n - 2)) else 0 end, 6) as bc from (select distinct graph_id, node from door) d join nn using (graph_id) left join bcs using (graph_id, node)", **_SIGMA))
def betweenness(g):
    """GA03."""
    return A.betweenness(P.undirected(g.view("physical"))).select("graph_id", "node", r6("bc"))


_CUT = {"r_cut(graph_id, a, b, x)": "select graph_id, node, nbr, node from door where node < nbr union select r.graph_id, r.a, r.b, d.nbr from r_cut r join door d on d.graph_id = r.graph_id and d.node = r.x where not (d.node = r.a and d.nbr = r.b) and not (d.node = r.b and d.nbr = r.a)"}


@on_events(sql("door", "select graph_id, a, b from r_cut group by 1, 2, 3 having not bool_or(x = b)", **_CUT))
def bridges(g):
    """GA06."""
    return A.bridges(P.undirected(g.view("physical")))


_CC = {"t3": "select graph_id, node, count(*) as t from (select graph_id, x as node from tri union all select graph_id, y from tri union all select graph_id, z from tri) group by 1, 2", "dg": "select graph_id, node, count(*) as d from door group by 1, 2"}


@on_events(sql("door tri", "select graph_id, node, round(case when d >= 2 then 2.0 * coalesce(t, 0) / (d * (d - 1)) else 0 end, 6) as c from dg left join t3 using (graph_id, node)", **_CC))
def clustering_coeff(g):
    """GA18."""
    return A.clustering(P.undirected(g.view("physical"))).select("graph_id", "node", r6("c"))


_GS = {
    **hops("links", "s"),
    "nm": "select graph_id, room_id as node from nodes union all select graph_id, env_id from env",
    "cp": "select n.graph_id, n.node, least(n.node, coalesce(min(h.b), n.node)) as component from nm n left join hopss h on h.graph_id = n.graph_id and h.a = n.node group by 1, 2",
    "sz": "select graph_id, component, count(*) as size from cp group by 1, 2",
    "tp": "select graph_id, arg_max(component, (size, -component)) as component, count(*) as n_components from sz group by 1",
    "hp": "select h.graph_id, avg(hops) as apl, max(hops) as diameter from hopss h join cp on cp.graph_id = h.graph_id and cp.node = h.a join tp on tp.graph_id = cp.graph_id and tp.component = cp.component group by 1",
    "tq": "select a.graph_id, a.node as x, a.nbr as y, b.nbr as z from links a join links b on a.graph_id = b.graph_id and a.nbr = b.node and a.node < a.nbr and b.node < b.nbr join links c on c.graph_id = a.graph_id and c.node = a.node and c.nbr = b.nbr",
    "tt": "select graph_id, node, count(*) as t from (select graph_id, x as node from tq union all select graph_id, y from tq union all select graph_id, z from tq) group by 1, 2",
    "ld": "select graph_id, node, count(*) as d from links group by 1, 2",
    "cl": "select n.graph_id, avg(case when d >= 2 then 2.0 * coalesce(t, 0) / (d * (d - 1)) else 0 end) as clustering from nm n left join ld using (graph_id, node) left join tt using (graph_id, node) group by 1",
    "pd": "select n.graph_id, count(*) as n_rooms, avg(coalesce(d, 0)) as avg_degree from nodes n left join (select graph_id, node as room_id, count(*) as d from pdoor group by 1, 2) using (graph_id, room_id) group by 1",
    "ec": "select graph_id, count(*) as n_edges, count(*) filter (where dst_kind = 'room') as n_rr from edges group by 1",
}


@on_events(sql("nodes env edges links pdoor", "select graph_id, n_rooms, 1::bigint as n_env, coalesce(n_edges, 0) as n_edges, round_even(avg_degree, 2) as avg_degree, round_even(coalesce(n_rr, 0) / (n_rooms * (n_rooms - 1) / 2), 4) as density, n_components, round_even(clustering, 4) as clustering, round_even(coalesce(apl, 0), 2) as apl, coalesce(diameter, 0) as diameter from pd left join ec using (graph_id) left join tp using (graph_id) left join cl using (graph_id) left join hp using (graph_id)", **_GS))
def graph_summary(g):
    """GA11."""
    return S.graph_summary(g)


@on_events(sql("nodes ", "select graph_id, a, b from m", m="select a.graph_id, a.room_id as a, b.room_id as b from nodes a join nodes b on a.graph_id = b.graph_id and a.room_id <> b.room_id where a.noise - b.tolerance >= 2 or b.noise - a.tolerance >= 2"))
def acoustic_mask(g):
    """GA08."""
    return A.acoustic_mask(g.nodes)


@on_events(sql("nodes mdeg", "select n.graph_id, n.room_id as a, b.room_id as b from nodes n left join mdeg using (graph_id, room_id) join nodes b on b.graph_id = n.graph_id and b.room_id <> n.room_id where n.occupancy >= 50 and coalesce(d, 0) < greatest(1, n.exits)"))
def fire_mask(g):
    """GA07."""
    return A.fire_mask(g.nodes, g.view("physical", "room"))


@on_events(sql("nodes env", "select n.graph_id, room_id as a, env_id as b from nodes n join env using (graph_id) where daylight >= 3"))
def daylight_mask(g):
    """GA09."""
    return A.daylight_mask(g.nodes, g.env)


@on_events(sql("nodes edges", "select r.graph_id, r.relation, count(e.graph_id) as n, round_even(count(e.graph_id) / (rooms * (rooms - 1) / 2), 4) as density from (select graph_id, count(*) as rooms, unnest(['room>physical>room','room>acoustic>room','room>sight>room','room>sight>environment','room>physical>environment']) as relation from nodes group by 1) r left join edges e on e.graph_id = r.graph_id and 'room>' || e.rel || '>' || e.dst_kind = r.relation group by 1, 2, rooms"))
def relation_density(g):
    """GA10, GA16."""
    return S.relation_counts(g)


@on_events(sql("nodes", "select graph_id, room_type, count(*) as n from nodes group by 1, 2"))
def type_distribution(g):
    """GA12."""
    return S.type_distribution(g)


@on_events(sql("nodes", "select graph_id, case when floor < 0.5 then 'ground' when floor > 3 then 'top' else 'teaching' end as typical_floor, count(*) as n from nodes group by 1, 2"))
def floor_distribution(g):
    """GA13."""
    return S.floor_distribution(g)


@on_events(sql("nodes edges", "select n.graph_id, coalesce(round(avg(case when daylight >= 3 then (exists (select 1 from edges e where e.graph_id = n.graph_id and rel = 'sight' and src % 5 <> 0 and (src = room_id or (dst = room_id and dst_kind = 'room'))))::int end), 6), 1.0) as daylight_rate from nodes n group by 1"))
def daylight_rate(g):
    """GA14."""
    return S.daylight_rate(thinned(g)).select("graph_id", r6("daylight_rate"))


@on_events(sql("nodes graphs simple", "select g.graph_id, round(coalesce(avg((a.a is not null or p.a is null)::int), 1.0), 6) as acoustic_rate from graphs g left join m on m.graph_id = g.graph_id left join (select * from simple where etype = 'acoustic') a on a.graph_id = m.graph_id and a.a = m.a and a.b = m.b left join (select * from simple where etype = 'physical') p on p.graph_id = m.graph_id and p.a = m.a and p.b = m.b group by 1", m="select a.graph_id, a.room_id as a, b.room_id as b from nodes a join nodes b on a.graph_id = b.graph_id and a.room_id < b.room_id where a.noise - b.tolerance >= 2 or b.noise - a.tolerance >= 2"))
def acoustic_rate(g):
    """GA15, A10."""
    return S.acoustic_rate(g).select("graph_id", r6("acoustic_rate"))


# Metrics -------------------------------------------------------------------------------------------
_NR = {"nr": "select graph_id, count(*) as n from nodes group by 1"}


def _from(kind: str) -> dict[str, str]:
    return {**hops(), **_NR, "hf": f"select x.graph_id, x.room_id, x.room_type, min(case when x.room_id = s.room_id then 0 else h.hops end) as hops from nodes x left join nodes s on s.graph_id = x.graph_id and s.room_type = '{kind}' left join hops h on h.graph_id = x.graph_id and h.a = s.room_id and h.b = x.room_id group by 1, 2, 3"}


METRIC_SQL = {
    "daylight_quality": ("nodes graphs edges", {}, "select g.graph_id, coalesce(v, 1.0) as value from graphs g left join (select n.graph_id, avg(case least(coalesce(d, 0), 3) when 0 then 0.0 when 1 then 0.5 when 2 then 0.8 else 1.0 end) as v from nodes n left join (select graph_id, src as room_id, count(*) as d from edges where rel = 'sight' group by 1, 2) using (graph_id, room_id) where daylight >= 3 group by 1) using (graph_id)"),
    "acoustic_comfort": ("nodes graphs door", {**hops(), **_NR}, "select g.graph_id, coalesce(v, 1.0) as value from graphs g left join (select a.graph_id, avg(case when a.room_id = b.room_id then 0 else coalesce(hops / n, 1.0) end) as v from nodes a join nodes b on a.graph_id = b.graph_id and a.noise >= 2 and b.tolerance <= 1 join nr on nr.graph_id = a.graph_id left join hops h on h.graph_id = a.graph_id and h.a = a.room_id and h.b = b.room_id group by 1) using (graph_id)"),
    "circulation_efficiency": ("nodes", {}, "select graph_id, greatest(0, 1 - abs(sum(case when room_type = 'corridor' then area else 0 end) / sum(area) - 0.18) / 0.12) as value from nodes group by 1"),
    "fire_safety_margin": ("nodes graphs mdeg", {}, "select graph_id, coalesce(v, 1.0) as value from graphs left join (select n.graph_id, avg(least(1, greatest(0, (coalesce(d, 0) - exits + 1) / 3))) as v from nodes n left join mdeg using (graph_id, room_id) where occupancy >= 50 group by 1) using (graph_id)"),
    "path_redundancy": ("nodes mdeg", {}, "select n.graph_id, least(1, 2 * avg((coalesce(d, 0) >= 3)::int)) as value from nodes n left join mdeg using (graph_id, room_id) group by 1"),
    "zone_cohesion": ("nodes graphs phys", {}, "select graph_id, coalesce(v, 0.5) as value from graphs left join (select p.graph_id, 1 - abs(avg((a.zone = b.zone)::int) - 0.4) / 0.4 as v from phys p join nodes a on a.graph_id = p.graph_id and a.room_id = p.src join nodes b on b.graph_id = p.graph_id and b.room_id = p.dst group by 1) using (graph_id)"),
    "stair_service_radius": ("nodes door", _from("toilet"), "select graph_id, case when max(n) <= 1 then 1.0 when count(*) filter (where room_type = 'toilet') = 0 then 0.0 when count(*) filter (where room_type <> 'toilet') = 0 then 1.0 else least(1, greatest(0, 1 - avg(coalesce(hops, n)) filter (where room_type <> 'toilet') / max(n))) end as value from hf join nr using (graph_id) group by 1"),
    "toilet_coverage": ("nodes graphs door", _from("toilet"), "select graph_id, coalesce(v, 1.0) as value from graphs left join (select graph_id, avg((coalesce(hops, 4) <= 3)::int) as v from hf where room_type <> 'toilet' group by 1) using (graph_id)"),
    "local_evacuation_loop": ("nodes door tri", {"w4": "select a.graph_id, a.nbr as a, b.nbr as b, a.node as m from door a join door b on a.graph_id = b.graph_id and a.node = b.node and a.nbr < b.nbr", "q4": "select *, count(*) over (partition by graph_id, a, b) as k from w4", "onc": "select graph_id, x as room_id from tri union select graph_id, y from tri union select graph_id, z from tri union select graph_id, a from q4 where k > 1 union select graph_id, b from q4 where k > 1 union select graph_id, m from q4 where k > 1"}, "select n.graph_id, avg((o.room_id is not null)::int) as value from nodes n left join onc o using (graph_id, room_id) group by 1"),
    "classroom_south_cluster": ("nodes graphs s2 door", {"cr": "select graph_id, room_id from nodes where room_type = 'classroom'", "lit": "select * from cr where exists (select 1 from s2 where s2.graph_id = cr.graph_id and (src = room_id or dst = room_id))", "okc": "select * from lit union select d.graph_id, d.node from door d join lit on lit.graph_id = d.graph_id and lit.room_id = d.nbr"}, "select graph_id, coalesce(v, 1.0) as value from graphs left join (select cr.graph_id, case when count(*) <= 1 then 1.0 else avg((okc.room_id is not null)::int) end as v from cr left join okc using (graph_id, room_id) group by 1) using (graph_id)"),
    "space_type_diversity": ("nodes", {}, "select graph_id, -sum(k / n * ln(k / n)) / ln(13) as value from (select graph_id, room_type, count(*) as k, sum(count(*)) over (partition by graph_id) as n from nodes group by 1, 2) group by 1"),
    "vertical_flow_balance": ("nodes", {}, "select graph_id, case when count(*) < 2 or avg(k) <= 0 then 1.0 else greatest(0, 1 - stddev_samp(k) / avg(k)) end as value from (select graph_id, floor, sum((room_type = 'toilet')::int) as k from nodes group by 1, 2) group by 1"),
}
#: The door graphs as matrices: B = (I + N) / 2 less the part of the first eigenvector, of which 30 squarings leave the second eigenvalue.
_SQUARES = 30
_HALF = "0.5 * ((a.k = b.k)::int + coalesce(x.w, 0) / sqrt((a.d + 1e-8) * (b.d + 1e-8)))"
LAMBDA2 = {
    "rw": "select graph_id, src as i, dst as j from phys where src <> dst union all select graph_id, dst, src from phys where src <> dst",
    "ra": "select graph_id, i, j, count(*)::double as w from rw group by all",
    "rd": "select n.graph_id, n.room_id as i, row_number() over (partition by n.graph_id order by room_id) as k, coalesce(sum(w), 0)::double as d from nodes n left join ra a on a.graph_id = n.graph_id and a.i = n.room_id group by n.graph_id, n.room_id",
    "rb": f"select a.graph_id, a.k, list({_HALF} order by b.k) as b, list({_HALF} - coalesce(sqrt(a.d * b.d) / nullif(t.t, 0), 0) order by b.k) as m from rd a join rd b on a.graph_id = b.graph_id join (select graph_id, sum(d) as t from rd group by 1) t on t.graph_id = a.graph_id left join ra x on x.graph_id = a.graph_id and x.i = a.i and x.j = b.i group by a.graph_id, a.k",
    "rm": "select graph_id, list(b order by k) as b, list(m order by k) as m, count(*) as n from rb group by 1",
    "r_sq(graph_id, s, m)": f"select graph_id, 0, m from rm union all select graph_id, s, list_transform(p, lambda x: list_transform(x, lambda v: v / t)) from (select *, greatest(1e-300, list_sum(list_transform(p, lambda r, i: r[i]))) as t from (select graph_id, s + 1 as s, list_transform(m, lambda x: list_transform(m, lambda y: list_dot_product(x, y))) as p from r_sq where s < {_SQUARES}))",
    "l2": f"select graph_id, case when n = 1 then 0.0 else 2 * (1 - coalesce(list_sum(list_transform(list_zip(q.m, rm.b), lambda z: list_dot_product(z[1], z[2]))) / nullif(list_sum(list_transform(q.m, lambda r, i: r[i])), 0), 0)) end as l2 from r_sq q join rm using (graph_id) where s = {_SQUARES}",
}
METRIC_SQL["graph_robustness"] = ("nodes phys", LAMBDA2, "select graph_id, least(1.0, greatest(0.0, 5 * l2)) as value from l2")
for _m, (_uses, _own, _text) in METRIC_SQL.items():
    query(sql(_uses, f"select graph_id, round(value, 6) as value from ({_text})", **_own), f"metric_{_m}")(lambda spark, sf_dir, f=M.METRICS[_m]: f(event_graphs(spark, sf_dir)).select("graph_id", r6("value")))

_SOME = tuple(M.WEIGHTS)
_MALL = {**{n: t for k in _SOME for n, t in METRIC_SQL[k][1].items()}, **{f"m_{k}": METRIC_SQL[k][2] for k in _SOME}}
_MSUM = " + ".join(f"{M.WEIGHTS[k]} * m_{k}.value" for k in _SOME)
_MJOIN = f"m_{_SOME[0]} " + " ".join(f"join m_{k} using (graph_id)" for k in _SOME[1:])
_MUSE = "nodes graphs mdeg phys door tri s2"


_ALL13 = {**{n: t for k in M.METRICS for n, t in METRIC_SQL[k][1].items()}, **{f"m_{k}": METRIC_SQL[k][2] for k in M.METRICS}}


@on_events(sql(f"{_MUSE} edges", " union all ".join(f"select graph_id, '{k}' as metric, round(value, 6) as value from m_{k}" for k in M.METRICS), **_ALL13))
def metric_all(g):
    """All thirteen metrics."""
    return M.compute_all(g).select("graph_id", "metric", r6("value"))


@on_events(sql(_MUSE, f"select graph_id, round(({_MSUM}) / {sum(M.WEIGHTS.values())}, 6) as score from {_MJOIN}", **_MALL))
def metric_aggregate(g):
    """The weighted mean over all eleven weights."""
    return M.aggregate(M.compute_all(g, tuple(M.WEIGHTS))).select("graph_id", r6("score"))


@on_events(sql(_MUSE, f"select graph_id, round(({_MSUM}) / {sum(M.WEIGHTS[k] for k in _SOME)}, 6) as score from {_MJOIN}", **_MALL))
def metric_aggregate_sql(g):
    """M15 with its weights given one by one."""
    return M.aggregate(M.compute_all(g, _SOME), {k: M.WEIGHTS[k] for k in _SOME}).select("graph_id", r6("score"))


_SCORES = {**_MALL, "scores": f"select graph_id, 100 * ({_MSUM}) / {sum(M.WEIGHTS[k] for k in _SOME)} as score from {_MJOIN}"}


def _scores(g):
    """Held, as some reports read the scores twice."""
    return held(M.aggregate(M.compute_all(g, _SOME)).select("graph_id", (100 * F.col("score")).alias("score")))


@on_events(sql(_MUSE, "select bin, count(*) as n, round((select avg(score) from scores), 6) as mean, round((select stddev_pop(score) from scores), 6) as std from (select case when score < 30 then '[0,30)' when score < 50 then '[30,50)' when score < 70 then '[50,70)' when score < 85 then '[70,85)' else '[85,101)' end as bin from scores) group by 1", **_SCORES))
def grade_histogram(g):
    """A14."""
    return S.score_report(_scores(g)).select("bin", "n", r6("mean"), r6("std"))


@on_events(sql(_MUSE, "select case when score >= 85 then 'A' when score >= 70 then 'B' when score >= 50 then 'C' else 'D' end as grade, count(*) as n from scores group by 1", **_SCORES))
def grades(g):
    """A13, A13c."""
    return _scores(g).groupBy(S.grade(F.col("score")).alias("grade")).agg(F.count("*").alias("n"))


@on_events(sql(_MUSE, "select * from (select graph_id, round(score, 6) as score, 'best' as side from scores order by scores.score desc, graph_id limit 3) union all select * from (select graph_id, round(score, 6) as score, 'worst' as side from scores order by scores.score, graph_id limit 3)", **_SCORES))
def best_and_worst(g):
    """A top-k report."""
    return S.best_and_worst(_scores(g)).select("graph_id", r6("score"), "side")


# Data sets -----------------------------------------------------------------------------------------
@on_events(sql("nodes graphs edges", """select 'rooms_mean' as stat, round(avg(n), 6) as value from g union all select 'rooms_std', round(stddev_pop(n), 6) from g union all select 'rooms_min', min(n)::double from g union all select 'rooms_max', max(n)::double from g
 union all select 'floors_mean', round(avg(f), 6) from g union all select 'graphs', count(*)::double from g union all select 'edges_' || rel, round(count(*) / (select count(*) from g), 6) from edges group by rel
 union all select 'type_' || t, round(count(n.graph_id) / (select count(*) from g), 6) from (select unnest(['classroom','special_classroom','music_room','gymnasium','library','office','teacher_office','corridor','staircase','toilet','storage','cafeteria','entrance_hall']) as t) left join nodes n on n.room_type = t group by t""", g="select graph_id, count(*) as n, max(floor + 1) as f from nodes group by 1"))  # fmt: skip
def dataset_stats(g):
    """A01."""
    return S.dataset_statistics(g).select("stat", r6("value"))


_AUD = {
    "fl": "select graph_id, floor as floor_mid, sum(area) as total, sum(case when room_type = 'corridor' then area else 0 end) as hall, count(*) as n_rooms, count(*) filter (where (area > 300 and room_type <> 'corridor') or area < 3) as outliers from nodes group by 1, 2",
    "rk": "select *, dense_rank() over (partition by graph_id order by floor_mid) as k, count(*) over (partition by graph_id) as m from fl",
    "au": "select graph_id, floor_mid::bigint as floor_mid, n_phys, total / n_phys as area, coalesce(hall / nullif(total, 0), 0) as corridor_ratio, n_rooms, outliers, coalesce(hall / nullif(total, 0), 0) between 0.1 and 0.25 as ratio_ok from (select *, (case when k = 1 or (k = m and m > 2) then 1 else greatest(1, (3 - case when m > 2 then 2 else 1 end) // greatest(1, m - case when m > 2 then 2 else 1 end)) end)::bigint as n_phys from rk)",
    "ag": "select graph_id, sum(area) as area, sum(area * corridor_ratio) / sum(area) as ratio, bool_and(ratio_ok) as fok, sum(outliers)::bigint as outliers from au group by 1",
}


@on_events(sql("nodes", "select graph_id, floor_mid, n_phys, round(area, 6) as area, round(corridor_ratio, 6) as corridor_ratio, n_rooms, outliers, ratio_ok from au", **_AUD))
def floor_audit(g):
    """A03, A04."""
    a = S.floor_audit(g)
    return a.select("graph_id", F.col("floor_mid").cast("long"), F.col("n_phys").cast("long"), r6("area"), r6("corridor_ratio"), "n_rooms", "outliers", "ratio_ok")


@on_events(sql("nodes", "select graph_id, round(area, 6) as area, round(ratio, 6) as ratio, outliers, fok and ratio between 0.1 and 0.25 as valid from ag", **_AUD))
def audit_graphs(g):
    """A06."""
    return S.audit_graphs(S.floor_audit(g)).select("graph_id", r6("area"), r6("ratio"), "outliers", "valid")


@on_events(sql("nodes", "select count(*) as graphs, round(100.0 * avg((fok and ratio between 0.1 and 0.25)::int), 6) as valid_pct, round(avg(ratio), 6) as ratio_mean, round(stddev_pop(ratio), 6) as ratio_std, round(min(ratio), 6) as ratio_min, round(max(ratio), 6) as ratio_max, sum(outliers)::bigint as outliers from ag", **_AUD))
def audit_summary(g):
    """A05."""
    a = S.audit_summary(S.floor_audit(g))
    return a.select("graphs", *[r6(c) for c in ("valid_pct", "ratio_mean", "ratio_std", "ratio_min", "ratio_max")], "outliers")


_DV = {
    "d3": "select n.graph_id, n.room_id as node, count(p.nbr) as d from nodes n left join pdoor p on p.graph_id = n.graph_id and p.node = n.room_id group by 1, 2",
    "q3": "select a.graph_id, a.node as x, a.nbr as y, b.nbr as z from pdoor a join pdoor b on a.graph_id = b.graph_id and a.nbr = b.node and a.node < a.nbr and b.node < b.nbr join pdoor c on c.graph_id = a.graph_id and c.node = a.node and c.nbr = b.nbr",
    "t3": "select graph_id, node, count(*) as t from (select graph_id, x as node from q3 union all select graph_id, y from q3 union all select graph_id, z from q3) group by 1, 2",
    "h3": "select graph_id, -sum(k / n * ln(k / n)) as entropy, min(d) as d_min, max(d) as d_max from (select graph_id, d, count(*) as k, sum(count(*)) over (partition by graph_id) as n from d3 group by 1, 2) group by 1",
    "c3": "select graph_id, sum(case when d >= 2 then 2.0 * coalesce(t, 0) / (d * (d - 1)) else 0 end) / (count(*) + 1) as clustering from d3 left join t3 using (graph_id, node) group by 1",
    "dv": "select *, least(100, 40 * entropy + 50 * clustering) as score from h3 join c3 using (graph_id)",
}  # the environment has one node, without doors


@on_events(sql("nodes pdoor", "select graph_id, round(entropy, 6) as entropy, round(clustering, 6) as clustering, d_min, d_max, round(score, 6) as score, entropy >= 1 as passed from dv", **_DV))
def evaluate_diversity(g):
    """A12."""
    return S.evaluate_diversity(g).select("graph_id", r6("entropy"), r6("clustering"), "d_min", "d_max", r6("score"), "passed")


def _share(rows: str) -> str:
    return f"select g.graph_id, coalesce(compliant, 0) as compliant, coalesce(total, 0) as total, coalesce(compliant / total, 1.0) as rate from graphs g left join (select graph_id, count(*) filter (where ok) as compliant, count(*) as total from ({rows}) group by 1) using (graph_id)"


_RATED = "graph_id, compliant::bigint as compliant, total::bigint as total, round(rate, 6) as rate, rate >= 0.95 as passed"
_FI = _share("select n.graph_id, coalesce(d, 0) >= exits as ok from nodes n left join mdeg using (graph_id, room_id) where occupancy >= 50")
_DL = _share("select n.graph_id, exists (select 1 from edges e where e.graph_id = n.graph_id and e.src = n.room_id and e.rel = 'sight' and e.src % 5 <> 0) as ok from nodes n where daylight >= 3")
_AC = _share("select a.graph_id, exists (select 1 from a1 where a1.graph_id = a.graph_id and a1.src in (a.room_id, b.room_id) and a1.dst in (a.room_id, b.room_id)) or not exists (select 1 from door d where d.graph_id = a.graph_id and d.node = a.room_id and d.nbr = b.room_id) as ok from nodes a join nodes b on a.graph_id = b.graph_id and a.room_id < b.room_id and (a.noise - b.tolerance >= 2 or b.noise - a.tolerance >= 2)")


@on_events(sql("nodes graphs mdeg", f"select {_RATED} from v", v=_FI))
def evaluate_fire(g):
    """A08."""
    return S.evaluate_fire(g).select("graph_id", "compliant", "total", r6("rate"), "passed")


@on_events(sql("nodes graphs edges", f"select {_RATED} from v", v=_DL))
def evaluate_daylight(g):
    """A09."""
    return S.evaluate_daylight(thinned(g)).select("graph_id", "compliant", "total", r6("rate"), "passed")


@on_events(sql("nodes graphs a1 door", f"select {_RATED} from v", v=_AC))
def evaluate_acoustic(g):
    """A10."""
    return S.evaluate_acoustic(g).select("graph_id", F.col("adequate").alias("compliant"), "total", r6("rate"), "passed")


@on_events()
def evaluate_connectivity(g):
    """A07 (bridges have no plain SQL)."""
    return S.evaluate_connectivity(g)


@on_events(sql("nodes env pdoor", "select n.graph_id, round(r, 6) as corridor_ratio, round(coalesce(apl, 0), 6) as avg_path, coalesce(diameter, 0)::bigint as diameter, (100.0 - case when r between 0.1 and 0.3 then 0 else 30 end - case when coalesce(apl, 0) > 8 then 10 else 0 end)::double as score, r between 0.1 and 0.3 as passed from (select graph_id, sum(case when room_type = 'corridor' then area else 0 end) / sum(area) as r, count(*) as k from nodes group by 1) n left join hpp on hpp.graph_id = n.graph_id and k >= 2", **{
    **hops("pdoor", "p"),
    "nmp": "select graph_id, room_id as node from nodes union all select graph_id, env_id from env",
    "cpp": "select n.graph_id, n.node, least(n.node, coalesce(min(h.b), n.node)) as component from nmp n left join hopsp h on h.graph_id = n.graph_id and h.a = n.node group by 1, 2",
    "tpp": "select graph_id, arg_max(component, (size, -component)) as component from (select graph_id, component, count(*) as size from cpp group by 1, 2) group by 1",
    "hpp": "select h.graph_id, avg(hops) as apl, max(hops) as diameter from hopsp h join cpp on cpp.graph_id = h.graph_id and cpp.node = h.a join tpp on tpp.graph_id = cpp.graph_id and tpp.component = cpp.component group by 1",
}))
def evaluate_circulation(g):
    """A11 (betweenness is compared by the query of its own)."""
    return S.evaluate_circulation(g).select("graph_id", r6("corridor_ratio"), r6("avg_path"), F.col("diameter").cast("long").alias("diameter"), "score", "passed")


@on_events(once=True)
def evaluate_all(g):
    """The six scores, their mean and the grade."""
    return S.evaluate_all(written(g)).select("graph_id", *[r6(n) for n in S.EVALUATORS], r6("overall"), "grade")


@on_events(sql("nodes", "select room_type, round(avg(k), 6) as mean, round(stddev_samp(k), 6) as std, round(stddev_samp(k) / (avg(k) + 1e-8), 6) as cv, min(k) as least, max(k) as most from (select g.graph_id, t.room_type, count(n.graph_id) as k from (select distinct graph_id from nodes) g cross join (select distinct room_type from nodes) t left join nodes n on n.graph_id = g.graph_id and n.room_type = t.room_type group by 1, 2) group by 1"))
def type_cv_table(g):
    """A19."""
    return S.type_variation(g).select("room_type", r6("mean"), r6("std"), r6("cv"), "least", "most")


@on_events(sql("nodes ddeg", "select coalesce(degree, 0) as degree, count(*) as n from nodes left join ddeg using (graph_id, room_id) group by 1"))
def degree_histogram(g):
    """A23."""
    return S.degree_histogram(g, "physical")


@on_events(sql("nodes", "select least(14, floor(area / 500 * 15))::bigint as bin, count(*) as n from nodes where area between 0 and 500 group by 1"))
def area_histogram(g):
    """15 equal bins."""
    return S.histogram(g.nodes, "area", 0.0, 500.0, 15).select(F.col("bin").cast("long"), "n")


@on_events(sql("nodes", "select typical_floor, " + ", ".join(f"count(*) filter (where room_type = '{t}') as {t}" for t in ("classroom", "corridor", "toilet")) + " from nodes group by 1"))
def motif_pivot(g):
    """A count table."""
    return S.pivot_counts(g.nodes, "typical_floor", "room_type", ["classroom", "corridor", "toilet"])


@on_events(sql("nodes", "select round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, round(regr_r2(y, x), 6) as r2, round(corr(y, x), 6) as r from q", q="select graph_id, count(*)::double as x, avg(area) as y from nodes group by 1"))
def baseline_regression(g):
    """A18."""
    q = g.nodes.groupBy("graph_id").agg(F.count("*").alias("x"), F.avg("area").alias("y"))
    return S.regression(q, "x", "y").select(r6("slope"), r6("intercept"), r6("r2"), r6("r"))


_U7 = u("7", "graph_id", "'split'")
_MARGIN = {"m": METRIC_SQL["fire_safety_margin"][2], "s": f"select case when {_U7} < 0.7 then 'train' when {_U7} < 0.85 then 'val' else 'test' end as split, value as score from m"}


def _margins(g):
    part = hash_uniform(7, F.col("graph_id"), "split")
    return M.fire_safety_margin(g).select(F.when(part < 0.7, "train").when(part < 0.85, "val").otherwise("test").alias("split"), F.col("value").alias("score"))


@on_events(sql("nodes graphs mdeg", "select split, count(*) as n, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as std, round(min(score), 6) as least, round(max(score), 6) as most, round(quantile_disc(score, 0.5), 6) as median, count(distinct round(score, 4)) as distinct_scores, count(*) filter (where score = 1) as perfect, count(*) filter (where score >= 0.83) as high from (select split, score from s union all select 'all', score from s) group by 1", **_MARGIN))
def score_audit(g):
    """A16."""
    return S.score_audit(_margins(g)).select("split", "n", r6("mean"), r6("std"), r6("least"), r6("most"), r6("median"), "distinct_scores", "perfect", "high")


@on_events(sql("nodes graphs mdeg", "select least(5, floor(round(score, 9) * 6))::int as bin, count(*) as n from s where score between 0 and 1 group by 1", **_MARGIN))
def score_bins(g):
    """Six equal bins."""
    return S.histogram(_margins(g).withColumn("score", F.round("score", 9)), "score", 0.0, 1.0, 6)


_MODEL = {
    "q": "select graph_id, count(*)::double as x, coalesce(avg(area) filter (where floor = 0), avg(area)) / 100 as pred, avg(area) / 100 as target from nodes group by 1",
    "f": "select avg(target) as mean, regr_slope(target, x) as slope, regr_intercept(target, x) as intercept from q",
    "o": f"select count(*) as n, avg((pred - target) ** 2) as mse, avg(abs(pred - target)) as mae, avg((target - mean) ** 2) as mse_mean, avg((target - {u('42', 'graph_id', chr(39) + 'baseline' + chr(39))}) ** 2) as mse_random, avg((target - intercept - slope * x) ** 2) as mse_line, corr(pred, target) as corr, stddev_samp(pred) / stddev_samp(target) as spread, count(*) filter (where abs(pred - target) < 0.05) as under_05, count(*) filter (where abs(pred - target) < 0.10) as under_10, count(*) filter (where abs(pred - target) < 0.15) as under_15, count(*) filter (where abs(pred - target) >= 0.20) as over_20 from q, f",
}


@on_events(sql("nodes", "select n, round(mse, 6) as mse, round(mae, 6) as mae, round(1 - mse / mse_mean, 6) as r2, round(mse_mean, 6) as mse_mean, round(mse_random, 6) as mse_random, round(mse_line, 6) as mse_line, round(100 * (mse_mean - mse) / mse_mean, 6) as gain_mean, round(100 * (mse_line - mse) / mse_line, 6) as gain_line, round(corr, 6) as corr, round(spread, 6) as spread, under_05, under_10, under_15, over_20 from o", **_MODEL))
def model_audit(g):
    """The mean area of the ground floor as a prediction of that of all floors."""
    q = g.nodes.groupBy(F.col("graph_id").alias("key")).agg(F.count("*").cast("double").alias("x"), (F.coalesce(F.avg(F.when(F.col("floor") == 0, F.col("area"))), F.avg("area")) / 100).alias("pred"), (F.avg("area") / 100).alias("target"))
    return S.model_audit(q).select("n", *[r6(c) for c in ("mse", "mae", "r2", "mse_mean", "mse_random", "mse_line", "gain_mean", "gain_line", "corr", "spread")], "under_05", "under_10", "under_15", "over_20")


@query("select task, round(case when sum((target - t) ** 2) > 0 then 1 - sum((pred - target) ** 2) / sum((target - t) ** 2) else 0 end, 6) as r2, round(avg(abs(pred - target)), 6) as mae, round(avg(pred), 6) as mean_pred, round(avg(target), 6) as mean_target from (select *, avg(target) over (partition by task) as t from (select l_returnflag as task, l_extendedprice / l_quantity as pred, p_retailprice as target from lineitem join part on p_partkey = l_partkey)) group by 1")
def per_task_r2(spark, sf_dir):
    """A20 over line items: the unit price against the part's."""
    li, p = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    d = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_returnflag").alias("task"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("pred"), F.col("p_retailprice").alias("target"))
    return S.task_report(d).select("task", r6("r2"), r6("mae"), r6("mean_pred"), r6("mean_target"))


@on_events(sql(_MUSE, f"select split, count(*) as n, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std, round(quantile_disc(score, 0.5), 6) as median from (select *, case when {u('7', 'graph_id', chr(39) + 'split' + chr(39))} < 0.7 then 'train' when {u('7', 'graph_id', chr(39) + 'split' + chr(39))} < 0.85 then 'val' else 'test' end as split from scores) group by 1", **_SCORES))
def split_balance(g):
    """A15, A16 with splits by hash."""
    from graphloom.functions import hash_uniform

    r = hash_uniform(7, F.col("graph_id"), "split")
    sp = g.graphs.select("graph_id", F.when(r < 0.7, "train").when(r < 0.85, "val").otherwise("test").alias("split"))
    return S.split_balance(sp, _scores(g)).select("split", "n", r6("mean"), r6("std"), r6("median"))


_ = Window
