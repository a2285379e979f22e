"""Constraint checks (C01-C14): explainable violation rows (graph_id, constraint, entity, other, actual, required)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import distance, overlap
from graphloom.model import CONSTRAINTS, HARD, RULES, GraphTables
from graphloom.operators.features import undirected


def _rows(df: DataFrame, name: str, entity, actual, required, other=None) -> DataFrame:
    other = F.lit(None) if other is None else other
    return df.select("graph_id", F.lit(name).alias("constraint"), entity.cast("string").alias("entity"), other.cast("string").alias("other"), actual.cast("double").alias("actual"), required.cast("double").alias("required"))


def distinct_degree(edges: DataFrame) -> DataFrame:
    """(graph_id, room_id, degree): distinct neighbours, environment nodes counted."""
    return undirected(edges).groupBy("graph_id", F.col("node").alias("room_id")).agg(F.count("*").alias("degree"))


def fire_exits(g: GraphTables, threshold: int | None = None) -> DataFrame:
    """Rooms of 50 or more persons with fewer distinct physical neighbours than exits."""
    t = RULES["occupancy_threshold"] if threshold is None else threshold
    d = g.nodes.filter(F.col("occupancy") >= t).join(distinct_degree(g.view("physical")), ["graph_id", "room_id"], "left")
    deg = F.coalesce("degree", F.lit(0))
    return _rows(d.filter(deg < F.col("exits")), "fire_exits", F.col("room_id"), deg, F.col("exits"))


def daylight(g: GraphTables, least: int | None = None) -> DataFrame:
    """Rooms that require daylight with too few distinct sight neighbours."""
    n = RULES["daylight_min_edges"] if least is None else least
    d = g.nodes.filter("daylight >= 3").join(distinct_degree(g.view("sight")), ["graph_id", "room_id"], "left")
    deg = F.coalesce("degree", F.lit(0))
    return _rows(d.filter(deg < n), "daylight", F.col("room_id"), deg, F.lit(n))


def acoustic(g: GraphTables, radius: float | None = None, gap: int | None = None) -> DataFrame:
    """For pairs on shared floors within `radius`, each direction in which noise exceeds tolerance by `gap`
    although neither an acoustic edge nor two hops of doors part the rooms. Cells bound the pairing."""
    r, gap = radius or RULES["proximity"], gap or RULES["noise_gap"]
    cell = lambda c: F.floor(F.col(c) / r)
    side = lambda p: g.nodes.select("graph_id", cell("x").alias("cx"), cell("y").alias("cy"), *[F.col(c).alias(f"{p}_{c}") for c in ("room_id", "ord", "x", "y", "floor_lo", "floor_hi", "noise", "tolerance")])
    b = side("b").withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1))).withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    p = side("a").join(b, ["graph_id", "cx", "cy"]).filter("a_ord < b_ord")
    p = p.filter(overlap(*[F.col(c) for c in ("a_floor_lo", "a_floor_hi", "b_floor_lo", "b_floor_hi")])).filter(distance(*[F.col(c) for c in ("a_x", "a_y", "b_x", "b_y")]) <= r)
    one = p.select("graph_id", F.col("a_room_id").alias("node"), F.col("b_room_id").alias("nbr"), (F.col("a_noise") - F.col("b_tolerance")).alias("gap"))
    two = p.select("graph_id", F.col("b_room_id").alias("node"), F.col("a_room_id").alias("nbr"), (F.col("b_noise") - F.col("a_tolerance")).alias("gap"))
    loud = one.unionByName(two).filter(F.col("gap") >= gap)
    key = ["graph_id", "node", "nbr"]
    # A path of at least two hops fails exactly where there is a door between the two.
    bad = loud.join(undirected(g.view("acoustic")), key, "left_anti").join(undirected(g.view("physical")), key, "left_semi")
    return _rows(bad, "acoustic", F.col("node"), F.col("gap"), F.lit(gap), F.col("nbr"))


def connectivity(g: GraphTables, components: DataFrame | None = None) -> DataFrame:
    """Rooms without a door, and rooms outside the first component of those with one."""
    from graphloom.operators.algorithms import components as find

    doors = g.view("physical")
    comp = components if components is not None else find(undirected(doors))
    rooms = g.nodes.select("graph_id", "room_id")
    placed = rooms.join(comp.select("graph_id", F.col("node").alias("room_id"), "component"), ["graph_id", "room_id"], "left")
    first = comp.groupBy("graph_id").agg(F.min("component").alias("main"))
    bad = placed.join(first, "graph_id", "left").filter("component is null or component <> main")
    kind = F.when(F.col("component").isNull(), "isolated").otherwise("unreachable")
    return _rows(bad, "connectivity", F.col("room_id"), F.lit(0), F.lit(1), kind)


def area_bounds(g: GraphTables) -> DataFrame:
    """Areas outside the type's closed range."""
    bad = g.nodes.filter(~F.col("area").between(F.col("area_min"), F.col("area_max")))
    return _rows(bad, "area_bounds", F.col("room_id"), F.col("area"), F.when(F.col("area") < F.col("area_min"), F.col("area_min")).otherwise(F.col("area_max")))


def _share(df: DataFrame, *keys: str) -> DataFrame:
    hall = F.sum(F.when(F.col("room_type") == "corridor", F.col("area")).otherwise(0.0))
    return df.groupBy(*keys).agg(F.try_divide(hall, F.sum("area")).alias("ratio"))


def circulation_ratio(g: GraphTables) -> DataFrame:
    """The corridors' share of all area outside [0.10, 0.30]."""
    lo, hi = RULES["circulation"]
    bad = _share(g.nodes, "graph_id").filter(~F.col("ratio").between(lo, hi))
    return _rows(bad, "circulation_ratio", F.lit("all"), F.col("ratio"), F.when(F.col("ratio") < lo, lo).otherwise(hi))


def floor_corridor_ratio(g: GraphTables) -> DataFrame:
    """The same for each typical floor, outside [0.10, 0.25]."""
    lo, hi = RULES["floor_corridor"]
    bad = _share(g.nodes, "graph_id", "typical_floor").filter(~F.col("ratio").between(lo, hi))
    return _rows(bad, "floor_corridor_ratio", F.col("typical_floor"), F.col("ratio"), F.when(F.col("ratio") < lo, lo).otherwise(hi))


def area_completeness(g: GraphTables, per_floor: float | None = None) -> DataFrame:
    """Area of each typical floor against footprint times span, and of the whole against footprint times floors,
    each within 5 %. Graphs without a footprint are skipped. Sums count to nine places, so that the order in which areas are
    added does not decide about those on the bound."""
    foot = F.lit(per_floor) if per_floor else F.coalesce(*[F.when(F.col("school_size") == k, v) for k, v in RULES["per_floor_area"].items()])
    gr = g.graphs.select("graph_id", "num_floors", foot.cast("double").alias("foot")).filter("foot is not null")
    n = g.nodes.join(gr, "graph_id").withColumn("span", F.col("floor_hi") - F.col("floor_lo") + 1)
    tol = RULES["area_tolerance"]
    t = n.groupingSets([["graph_id", "foot", "num_floors", "typical_floor"], ["graph_id", "foot", "num_floors"]], "graph_id", "foot", "num_floors", "typical_floor")
    t = t.agg(F.round(F.sum("area"), 9).alias("area"), F.max("span").alias("span"), F.grouping("typical_floor").alias("whole"))
    want = F.when(F.col("whole") == 1, F.col("foot") * F.col("num_floors")).otherwise(F.col("foot") * F.col("span"))
    bad = t.withColumn("want", want).filter(F.abs(F.col("area") - F.col("want")) > tol * F.col("want"))
    return _rows(bad, "area_completeness", F.when(F.col("whole") == 1, "all").otherwise(F.col("typical_floor")), F.col("area"), F.col("want"))


def all_violations(g: GraphTables) -> DataFrame:
    """The rows of all eight checks."""
    return reduce(DataFrame.unionByName, [f(g) for f in (fire_exits, daylight, acoustic, connectivity, area_bounds, circulation_ratio, area_completeness, floor_corridor_ratio)])


def status(g: GraphTables, violations: DataFrame | None = None) -> DataFrame:
    """(graph_id, constraint, passed, n_violations) for every graph and check."""
    v = violations if violations is not None else all_violations(g)
    names = F.explode(F.array(*[F.lit(c) for c in CONSTRAINTS])).alias("constraint")
    n = v.groupBy("graph_id", "constraint").agg(F.count("*").alias("n"))
    out = g.graphs.select("graph_id", names).join(n, ["graph_id", "constraint"], "left")
    return out.select("graph_id", "constraint", F.col("n").isNull().alias("passed"), F.coalesce("n", F.lit(0)).cast("long").alias("n_violations"))


def verdicts(status_: DataFrame) -> DataFrame:
    """Whether all and whether the hard checks pass, and the share that does (0.5 without checks)."""
    return status_.groupBy("graph_id").agg(
        F.bool_and("passed").alias("all_passed"),
        F.bool_and(F.col("passed") | ~F.col("constraint").isin(*HARD)).alias("hard_passed"),
        F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.5)).alias("pass_fraction"),
    )


def realism(g: GraphTables) -> DataFrame:
    """Warnings (graph_id, typical_floor, warning): toilets, small classrooms, corridors, stairs, missing types."""
    c = lambda t: F.sum((F.col("room_type") == t).cast("long"))
    t = g.nodes.groupBy("graph_id", "typical_floor").agg(
        c("toilet").alias("toilets"), c("corridor").alias("halls"), c("staircase").alias("stairs"),
        F.max(F.col("floor_hi") - F.col("floor_lo") + 1).alias("span"), F.sum(((F.col("room_type") == "classroom") & (F.col("area") < 54)).cast("long")).alias("small"),
    )
    w = F.array_compact(F.array(
        F.when(F.col("toilets") == 0, "no toilet"), F.when(F.col("toilets") > 3 * F.col("span"), "too many toilets"), F.when(F.col("small") > 0, "small classroom"),
        F.when(F.col("halls") == 0, "no corridor"), F.when(F.col("stairs") == 0, "no staircase"),
    ))
    floors = t.select("graph_id", "typical_floor", F.explode(w).alias("warning"))
    need = F.array(*[F.lit(x) for x in ("classroom", "corridor", "staircase", "toilet")])
    have = g.nodes.groupBy("graph_id").agg(F.collect_set("room_type").alias("s"))  # at most 13 types
    gone = have.select("graph_id", F.lit("all").alias("typical_floor"), F.explode(F.array_except(need, "s")).alias("t")).select("graph_id", "typical_floor", F.concat(F.lit("missing "), F.col("t")).alias("warning"))
    return floors.unionByName(gone)
