"""Encodings of rooms, environment nodes and edges, flattening, and schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import model as m
from graphloom.functions import clamp_norm, half_even, typical_floor_of
from graphloom.model import GraphTables

#: Which relation survives when a pair has several: the later one.
PRIORITY = {("physical", "room"): 1, ("acoustic", "room"): 2, ("sight", "room"): 3, ("sight", "environment"): 4, ("physical", "environment"): 5}


def unique_rooms(nodes: DataFrame) -> DataFrame:
    """One row a room id in a graph; the first in list order stays."""
    w = Window.partitionBy("graph_id", "room_id").orderBy("ord")
    return nodes.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def with_catalog(nodes: DataFrame, spec: DataFrame) -> DataFrame:
    """Rooms with their type's columns and occupancy; 13 catalog rows are broadcast."""
    own = [c for c in spec.columns if c == "room_type" or c not in nodes.columns]
    return nodes.join(F.broadcast(spec.select(*own)), "room_type").withColumn("occupancy", F.greatest(F.lit(1), F.floor(F.col("area") / F.col("density")).cast("int")))


def room_features(nodes: DataFrame, *more: str) -> DataFrame:
    """(graph_id, room_id, idx, features[27]) and `more` columns of the rooms: type one-hot, six measures, floor middle, zone one-hot, exits."""
    w = Window.partitionBy("graph_id").orderBy("ord")
    mid = (F.col("floor_lo") + F.col("floor_hi")) / 2
    hot = lambda c, n: [(F.col(c) == k).cast("double") for k in range(n)]
    cols = [
        *hot("type_idx", 13), clamp_norm(F.col("area"), m.MAX_AREA), clamp_norm(F.col("aspect_ratio"), m.MAX_ASPECT), clamp_norm(F.col("occupancy"), m.MAX_OCCUPANCY),
        *[clamp_norm(F.col(c), 4.0) for c in ("daylight", "noise", "tolerance")], clamp_norm(mid, m.MAX_FLOOR), *hot("zone_idx", 6), clamp_norm(F.col("exits"), m.MAX_EXITS),
    ]
    return nodes.select("graph_id", "room_id", (F.row_number().over(w) - 1).alias("idx"), F.array(*cols).alias("features"), *more)


def env_features(env: DataFrame) -> DataFrame:
    """(graph_id, env_id, idx, features[6]): type one-hot and the place on the site."""
    w = Window.partitionBy("graph_id").orderBy("env_ord")
    hot = [(F.col("env_type") == k).cast("double") for k in m.ENV_TYPES]
    return env.select("graph_id", "env_id", (F.row_number().over(w) - 1).alias("idx"), F.array(*hot, clamp_norm(F.col("x"), m.RULES["site"][2]), clamp_norm(F.col("y"), m.RULES["site"][3])).alias("features"))


def edge_index(edges: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Edges with the indexes of their ends; src, dst: (graph_id, id, idx). An unknown end fails the query."""
    a = src.select("graph_id", F.col("id").alias("src"), F.col("idx").alias("src_idx"))
    b = dst.select("graph_id", F.col("id").alias("dst"), F.col("idx").alias("dst_idx"))
    both = edges.join(a, ["graph_id", "src"], "left").join(b, ["graph_id", "dst"], "left")
    known = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit("an edge ends at an unknown node"))).otherwise(F.col(c)).alias(c)
    return both.select("graph_id", "rel", "src", "dst", known("src_idx"), known("dst_idx"))


def edge_attributes(g: GraphTables) -> DataFrame:
    """The encoded attributes of each relation; missing ones are 0, distances and decibels are normalised."""
    a = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    env = F.col("dst_kind") == "environment"
    first = (
        F.when((F.col("rel") == "physical") & ~env, a("distance_weight")).when(F.col("rel") == "physical", a("access_type")).when(F.col("rel") == "acoustic", clamp_norm(a("attenuation_db"), m.MAX_DB))
        .when(env, a("orientation")).otherwise(a("transparency"))
    )
    second = F.when((F.col("rel") == "physical") & ~env, a("is_stair")).when((F.col("rel") == "sight") & env, clamp_norm(a("distance"), m.SITE_DIAGONAL)).when(F.col("rel") == "sight", clamp_norm(a("sight_distance"), m.SITE_DIAGONAL))
    return g.edges.select("graph_id", "rel", "dst_kind", "rule", "src", "dst", first.alias("a0"), second.alias("a1"))


def split_by_destination(edges: DataFrame, env: DataFrame) -> DataFrame:
    """Edges with dst_kind told by whether the destination is an environment node of the graph."""
    known = env.select("graph_id", F.col("env_id").alias("dst"), F.lit(True).alias("_env")).distinct()
    kind = F.when(F.col("_env"), "environment").otherwise("room")
    return edges.drop("dst_kind").join(known, ["graph_id", "dst"], "left").withColumn("dst_kind", kind).drop("_env")


def assemble(g: GraphTables) -> DataFrame:
    """All typed edges with indexes into the room or environment table of their graph."""
    w = Window.partitionBy("graph_id").orderBy("ord")
    rooms = g.nodes.select("graph_id", F.col("room_id").alias("id"), (F.row_number().over(w) - 1).alias("idx"))
    envs = g.env.select("graph_id", F.col("env_id").alias("id"), (F.row_number().over(Window.partitionBy("graph_id").orderBy("env_ord")) - 1).alias("idx"))
    rr = edge_index(g.edges.filter("dst_kind = 'room'"), rooms, rooms).withColumn("dst_kind", F.lit("room"))
    re = edge_index(g.edges.filter("dst_kind = 'environment'"), rooms, envs).withColumn("dst_kind", F.lit("environment"))
    return rr.unionByName(re)


def decode_type(features: Column) -> Column:
    """P20: the type whose one-hot column is largest."""
    hot = F.slice(features, 1, 13)
    names = F.array(*[F.lit(t) for t in m.ROOM_TYPES])
    return F.element_at(names, F.array_position(hot, F.array_max(hot)).cast("int"))


def decode_floor(features: Column) -> Column:
    """The floor's number, halves to the even one."""
    return half_even(F.element_at(features, 20) * 4).cast("int")


def decode_typical_floor(features: Column) -> Column:
    """P22."""
    return typical_floor_of(F.element_at(features, 20) * 4)


def schema_errors(rooms: DataFrame, envs: DataFrame, g: GraphTables) -> DataFrame:
    """(graph_id, error, n): wrong feature widths, and ends of edges that no node has."""
    wide = lambda d, n, what: d.filter(F.size("features") != n).groupBy("graph_id").agg(F.count("*").alias("n")).select("graph_id", F.lit(what).alias("error"), "n")
    room = g.nodes.select("graph_id", F.col("room_id").alias("id"), F.lit("room").alias("kind"))
    ends = room.union(g.env.select("graph_id", "env_id", F.lit("environment")))
    lost = lambda e, k: g.edges.select("graph_id", F.col(e).alias("id"), F.col(k).alias("kind")).join(ends, ["graph_id", "id", "kind"], "left_anti").groupBy("graph_id").agg(F.count("*").alias("n")).select("graph_id", F.lit(f"unknown {e}").alias("error"), "n")
    return wide(rooms, 27, "room width").unionByName(wide(envs, 6, "environment width")).unionByName(lost("src", "src_kind")).unionByName(lost("dst", "dst_kind"))


def flatten(edges: DataFrame, compat: bool = True) -> DataFrame:
    """One undirected edge (graph_id, a, b, etype) a pair, a < b; loops are dropped.

    compat: the relation latest in PRIORITY survives, so a door is hidden by a sight line between the
    same rooms; otherwise the earliest does and physical analysis keeps its doors.
    """
    rank = F.coalesce(*[F.when((F.col("rel") == r) & (F.col("dst_kind") == k), p) for (r, k), p in PRIORITY.items()])
    e = edges.filter("src <> dst").select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.struct(rank.alias("p"), F.col("rel").alias("etype")).alias("t"))
    return e.groupBy("graph_id", "a", "b").agg((F.max("t") if compat else F.min("t")).alias("t")).select("graph_id", "a", "b", "t.etype")


def induced_by_type(simple: DataFrame, etype: str) -> DataFrame:
    """The flattened edges whose surviving type matches; nodes stay as they are."""
    return simple.filter(F.col("etype") == etype)


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (graph_id, node, nbr) in both directions."""
    one = edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("nbr"))
    return one.union(edges.select("graph_id", "dst", "src")).filter("node <> nbr").distinct()
