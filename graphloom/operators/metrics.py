"""Quality metrics (M01-M15): one value a graph, each as a frame (graph_id, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import half_even
from graphloom.model import GraphTables
from graphloom.operators import algorithms as A
from graphloom.operators.features import undirected

#: Default weights of the aggregate; metrics left out do not count.
WEIGHTS = {
    "circulation_efficiency": 1.0, "fire_safety_margin": 1.0, "graph_robustness": 1.0, "path_redundancy": 1.0, "zone_cohesion": 1.0, "stair_service_radius": 1.0,
    "toilet_coverage": 1.0, "local_evacuation_loop": 1.0, "classroom_south_cluster": 1.0, "space_type_diversity": 0.5, "vertical_flow_balance": 0.5,
}


def _all(g: GraphTables, df: DataFrame, default: float | None) -> DataFrame:
    """df's values for every graph, `default` where it has none."""
    out = g.graphs.select("graph_id").join(df, "graph_id", "left")
    return out if default is None else out.select("graph_id", F.coalesce("value", F.lit(float(default))).alias("value"))


def doors(g: GraphTables) -> DataFrame:
    return g.view("physical", "room")


def multi_degree(edges: DataFrame) -> DataFrame:
    """(graph_id, room_id, d): every edge counts at both ends."""
    ends = edges.select("graph_id", F.col("src").alias("room_id")).union(edges.select("graph_id", "dst"))
    return ends.groupBy("graph_id", "room_id").agg(F.count("*").alias("d"))


def source_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id", F.col("src").alias("room_id")).agg(F.count("*").alias("d"))


def _rooms_with(g: GraphTables, degree: DataFrame) -> DataFrame:
    return g.nodes.join(degree, ["graph_id", "room_id"], "left").withColumn("d", F.coalesce("d", F.lit(0)))


def daylight_quality(g: GraphTables) -> DataFrame:
    """Mean over HIGH rooms of 0, 0.5, 0.8 or 1 for 0, 1, 2 or more sight edges from the room; 1 without such rooms."""
    v = F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.5, 0.8, 1.0)]), (F.least(F.col("d"), F.lit(3)) + 1).cast("int"))
    rooms = _rooms_with(g, source_degree(g.view("sight"))).filter("daylight >= 3")
    return _all(g, rooms.groupBy("graph_id").agg(F.avg(v).alias("value")), 1.0)


def rooms_and_doors(g: GraphTables) -> DataFrame:
    """What the kernels of M02 and M10 to M12 read, in the same form so that Spark shuffles it once: a row a door, and one without nbr a room."""
    e = doors(g).select("graph_id", F.col("src").alias("node"), F.col("dst").alias("nbr"), F.lit(None).cast("string").alias("room_type"), F.lit(None).cast("int").alias("noise"), F.lit(None).cast("int").alias("tolerance"))
    rooms = g.nodes.select("graph_id", F.col("room_id").alias("node"), F.lit(None).cast("long").alias("nbr"), "room_type", F.col("noise").cast("int").alias("noise"), F.col("tolerance").cast("int").alias("tolerance"))
    return e.unionByName(rooms)


def acoustic_comfort(g: GraphTables) -> DataFrame:
    """Mean over noisy by quiet rooms of hops over the number of rooms; 1 where unreachable; a room with itself is 0; 1 without pairs."""
    p = A.hops_between(rooms_and_doors(g))
    return _all(g, p.filter("pairs > 0").select("graph_id", ((F.col("hops") / F.col("n") + F.col("lost")) / F.col("pairs")).alias("value")), 1.0)


def circulation_efficiency(g: GraphTables) -> DataFrame:
    """1 at a corridor share of 0.18, falling to 0 over 0.12 either way; 0.5 without area."""
    hall = F.sum(F.when(F.col("room_type") == "corridor", F.col("area")).otherwise(0.0))
    r = g.nodes.groupBy("graph_id").agg(F.when(F.sum("area") > 0, F.greatest(F.lit(0.0), 1 - F.abs(F.try_divide(hall, F.sum("area")) - 0.18) / 0.12)).alias("value"))
    return _all(g, r, 0.5)


def fire_safety_margin(g: GraphTables) -> DataFrame:
    """Mean over rooms of 50 persons of (edges - exits + 1) / 3 clamped to [0, 1]; 1 without such rooms.

    Thirds are added as whole numbers: equal shares give equal values, in whatever order rooms come."""
    thirds = F.least(F.lit(3), F.greatest(F.lit(0), F.col("d") - F.col("exits") + 1))
    rooms = _rooms_with(g, multi_degree(doors(g))).filter("occupancy >= 50")
    return _all(g, rooms.groupBy("graph_id").agg((F.sum(thirds) / (3.0 * F.count(thirds))).alias("value")), 1.0)


def graph_robustness(g: GraphTables) -> DataFrame:
    """Five times the algebraic connectivity of the door graph, at most 1."""
    e = doors(g).filter("src <> dst").groupBy("graph_id", F.col("src").alias("node"), F.col("dst").alias("nbr")).agg(F.count("*").cast("double").alias("w"))
    alone = g.nodes.select("graph_id", F.col("room_id").alias("node"), F.lit(None).cast("long").alias("nbr"), F.lit(0.0).alias("w"))
    l2 = A.lambda2(e.unionByName(alone))
    return _all(g, l2.select("graph_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 5 * F.col("l2"))).alias("value")), 0.0)


def space_type_diversity(g: GraphTables) -> DataFrame:
    """Entropy of the room types over ln 13."""
    t = g.nodes.groupBy("graph_id", "room_type").agg(F.count("*").alias("k"))
    n = t.groupBy("graph_id").agg(F.sum("k").alias("n"))
    p = F.col("k") / F.col("n")
    return t.join(n, "graph_id").groupBy("graph_id").agg((-F.sum(p * F.ln(p)) / F.ln(F.lit(13.0))).alias("value"))


def vertical_flow_balance(g: GraphTables, compat: bool = True) -> DataFrame:
    """1 less the sample deviation over the mean of stairs a floor, at least 0; floors without any count.

    compat counts toilets, whose index the original takes for stairs'. 1 for a single floor, and where there are none."""
    kind = "toilet" if compat else "staircase"
    mid = half_even((F.col("floor_lo") + F.col("floor_hi")) / 2).alias("f")
    f = g.nodes.select("graph_id", mid, (F.col("room_type") == kind).cast("long").alias("k")).groupBy("graph_id", "f").agg(F.sum("k").alias("k"))
    v = F.when((F.count("*") < 2) | (F.avg("k") <= 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.stddev_samp("k"), F.avg("k"))))
    return f.groupBy("graph_id").agg(v.alias("value"))


def path_redundancy(g: GraphTables) -> DataFrame:
    """Twice the share of rooms with three or more edges, at most 1."""
    rooms = _rooms_with(g, multi_degree(doors(g)))
    return rooms.groupBy("graph_id").agg(F.least(F.lit(1.0), 2 * F.avg((F.col("d") >= 3).cast("double"))).alias("value"))


def zone_cohesion(g: GraphTables) -> DataFrame:
    """1 - |share of edges inside a zone - 0.4| / 0.4, which may be negative; 0.5 without edges."""
    z = lambda c: g.nodes.select("graph_id", F.col("room_id").alias(c), F.col("zone").alias(f"z_{c}"))
    e = doors(g).join(z("src"), ["graph_id", "src"]).join(z("dst"), ["graph_id", "dst"])
    share = F.avg((F.col("z_src") == F.col("z_dst")).cast("double"))
    return _all(g, e.groupBy("graph_id").agg((1 - F.abs(share - 0.4) / 0.4).alias("value")), 0.5)


def stair_service_radius(g: GraphTables, compat: bool = True) -> DataFrame:
    """1 less the mean hops of the other rooms to the nearest stair over the number of rooms (which unreachable rooms
    count), in [0, 1]; 1 for a single room and where all are stairs, 0 without stairs; compat as M07."""
    kind = "toilet" if compat else "staircase"
    other = F.col("room_type") != kind
    r = A.nearest(rooms_and_doors(g), kind).groupBy("graph_id").agg(F.count("*").alias("n"), F.count_if(other).alias("others"), F.sum(F.when(other, F.col("hops"))).alias("hops"), F.count_if(other & F.col("hops").isNull()).alias("lost"))
    r = r.withColumn("mean", F.try_divide(F.coalesce("hops", F.lit(0)) + F.col("lost") * F.col("n"), F.col("others")))
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("mean") / F.col("n")))
    v = F.when(F.col("n") <= 1, 1.0).when(F.col("others") == F.col("n"), 0.0).when(F.col("others") == 0, 1.0).otherwise(near)
    return _all(g, r.select("graph_id", v.alias("value")), 1.0)


def toilet_coverage(g: GraphTables, most: int = 3) -> DataFrame:
    """The share of other rooms within three hops of a toilet; 1 without other rooms."""
    d = A.nearest(rooms_and_doors(g), "toilet").filter("room_type <> 'toilet'")
    return _all(g, d.groupBy("graph_id").agg(F.avg((F.coalesce("hops", F.lit(most + 1)) <= most).cast("double")).alias("value")), 1.0)


def local_evacuation_loop(g: GraphTables) -> DataFrame:
    """The share of rooms on a cycle of three or four doors."""
    return A.on_short_cycles(rooms_and_doors(g)).groupBy("graph_id").agg(F.avg(F.col("on").cast("double")).alias("value"))


def classroom_south_cluster(g: GraphTables) -> DataFrame:
    """The share of classrooms with a room sight line, or next door to a classroom with one; 1 for one or none."""
    rooms = g.nodes.filter("room_type = 'classroom'").select("graph_id", "room_id")
    s = g.view("sight", "room")
    seen = s.select("graph_id", F.col("src").alias("room_id")).union(s.select("graph_id", "dst")).distinct()
    lit = rooms.join(seen, ["graph_id", "room_id"], "left_semi")
    near = undirected(doors(g)).join(lit.select("graph_id", F.col("room_id").alias("nbr")), ["graph_id", "nbr"], "left_semi").select("graph_id", F.col("node").alias("room_id"))
    ok = lit.union(near).distinct().withColumn("ok", F.lit(1.0))
    v = F.when(F.count("*") <= 1, 1.0).otherwise(F.avg(F.coalesce("ok", F.lit(0.0))))
    return _all(g, rooms.join(ok, ["graph_id", "room_id"], "left").groupBy("graph_id").agg(v.alias("value")), 1.0)


METRICS = {
    "daylight_quality": daylight_quality, "acoustic_comfort": acoustic_comfort, "circulation_efficiency": circulation_efficiency, "fire_safety_margin": fire_safety_margin,
    "graph_robustness": graph_robustness, "path_redundancy": path_redundancy, "zone_cohesion": zone_cohesion, "stair_service_radius": stair_service_radius, "toilet_coverage": toilet_coverage,
    "local_evacuation_loop": local_evacuation_loop, "classroom_south_cluster": classroom_south_cluster, "space_type_diversity": space_type_diversity, "vertical_flow_balance": vertical_flow_balance,
}


def compute_all(g: GraphTables, names: tuple[str, ...] | None = None) -> DataFrame:
    """Long rows (graph_id, metric, value) of all metrics, or of those named."""
    parts = [METRICS[n](g).select("graph_id", F.lit(n).alias("metric"), "value") for n in names or METRICS]
    return reduce(DataFrame.unionByName, parts)


def wide(metrics: DataFrame) -> DataFrame:
    """One column a metric."""
    return metrics.groupBy("graph_id").pivot("metric", list(METRICS)).agg(F.first("value"))


def aggregate(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(graph_id, score), the weighted mean over the metrics that are there; 0.5 without weight."""
    w: Column = F.coalesce(*[F.when(F.col("metric") == k, F.lit(v)) for k, v in (weights or WEIGHTS).items()], F.lit(0.0))
    w = F.when(F.col("value").isNotNull(), w).otherwise(0.0)
    return metrics.groupBy("graph_id").agg(F.coalesce(F.try_divide(F.sum(w * F.coalesce("value", F.lit(0.0))), F.sum(w)), F.lit(0.5)).alias("score"))
