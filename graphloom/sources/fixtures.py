"""Graph views over the driver's star-schema tables, the subjects of the registered queries.

Events: a user is a graph, an event a room whose type follows from the event's. Trade: a nation is a
graph of its customers and the suppliers they buy from, one edge a line item.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import occupancy
from graphloom.model import CATALOG, GraphTables, catalog
from graphloom.operators import topology as J

#: Types of events: (room type, persons a unit of area, exits).
ROLES = {"click": ("classroom", 0.5, 2), "view": ("corridor", 0.3, 2), "signup": ("staircase", 0.5, 2), "error": ("toilet", 0.8, 1), "purchase": ("music_room", 1.5, 2)}
ORIGIN = "2024-01-01 00:00:00"


def role_spec(spark: SparkSession) -> DataFrame:
    """The catalog rows of the event types with the fixture's densities and exits."""
    own = spark.createDataFrame([(e, r, d, x) for e, (r, d, x) in ROLES.items()], "event_type string, room_type string, density double, exits int")
    rows = {r: CATALOG[r] for r, _, _ in ROLES.values()}
    return own.join(catalog(spark, rows, complete=False).drop("density", "exits", "floors"), "room_type")


def event_nodes(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One room an event. `ord` follows time and id inside the graph. dealt: the events are dealt by graph first, into a fixed number of
    partitions, so that whatever is persisted of the rooms is known to lie by graph."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type", "value")
    if dealt:
        e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")
    days = F.timestamp_diff("SECOND", F.lit(ORIGIN).cast("timestamp_ntz"), F.col("ts")) / 86400.0
    floor = F.least(F.lit(2), F.greatest(F.lit(0), F.floor(days / 10).cast("int")))
    n = e.join(F.broadcast(role_spec(spark)), "event_type")  # five rows
    return n.select(
        F.col("user_id").alias("graph_id"),
        F.col("event_id").alias("room_id"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ord"),
        "room_type", "type_idx", "zone", "zone_idx", "area_min", "area_max", "daylight", "noise", "tolerance", "density", "exits",
        F.col("value").alias("area"),
        F.lit(1.5).alias("aspect_ratio"),
        days.alias("x"),
        F.col("value").alias("y"),
        floor.alias("floor"), floor.alias("floor_lo"), floor.alias("floor_hi"),
        F.when(floor == 0, "ground").when(floor == 1, "teaching").otherwise("top").alias("typical_floor"),
        occupancy(F.col("value"), F.col("density")).alias("occupancy"),
    )


_held: dict[tuple[str, str, bool, bool], GraphTables] = {}


def event_graphs(spark: SparkSession, sf_dir: str, doors: bool = False, once: bool = False) -> GraphTables:
    """Event graphs with the edges of the deterministic rules P1, P2 (spine), P7, A1, S1 and S2.

    Rooms and edges are persisted (memory, then disk) for the queries that follow over the same tables,
    as they all start from the same six joins; asking for other tables lets go of them. doors: for queries that read
    no edges but the physical ones, which are then the only ones there. once: for queries that read the edges once, graph by graph: these
    are not persisted, and the rooms are dealt by graph once for all rules. Neither matters where the whole graphs are persisted already."""
    app = spark.sparkContext.applicationId
    whole, key = (app, sf_dir, False, False), (app, sf_dir, doors, once)
    if whole in _held:
        return _held[whole]
    if key not in _held:
        for old in _held.values():
            if old.nodes.sparkSession is spark:
                old.nodes.unpersist()
                old.edges.unpersist()
        _held.clear()
        g = _event_graphs(spark, sf_dir, doors, once)
        _held[key] = g if once else g.with_(edges=g.edges.persist(StorageLevel.MEMORY_AND_DISK))
    return _held[key]


def _event_graphs(spark: SparkSession, sf_dir: str, doors: bool, once: bool) -> GraphTables:
    nodes = event_nodes(spark, sf_dir, once).persist(StorageLevel.MEMORY_AND_DISK)
    ids = nodes.select("graph_id").distinct()
    graphs = ids.select("graph_id", F.lit("small").alias("school_size"), F.lit(3).alias("num_floors"))
    env = ids.select("graph_id", F.lit(-1).cast("long").alias("env_id"), F.lit(1).alias("env_ord"), F.lit("south_facing").alias("env_type"), F.lit(15.0).alias("x"), F.lit(500.0).alias("y"))
    g = GraphTables(graphs, nodes, env, nodes.limit(0))
    parts = [J.room_to_corridors(g), J.corridor_network(g, "spine"), J.service_rooms(g)]
    if not doors:
        parts += [J.proximity_pairs(g), J.daylight_to_south(g), J.daylight_via_corridor(g)]
    return g.with_(edges=reduce(DataFrame.unionByName, parts))


def trade_graphs(spark: SparkSession, sf_dir: str) -> GraphTables:
    """Trade graphs: relation R / A / N of the line item's return flag as physical / acoustic / sight. Supplier s is node -1 - s."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    c = t("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("graph_id"))
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    li = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_returnflag")
    rel = F.when(F.col("l_returnflag") == "R", "physical").when(F.col("l_returnflag") == "A", "acoustic").otherwise("sight")
    e = li.join(o, "o_orderkey").join(c, "c_custkey").select("graph_id", F.col("c_custkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"), rel.alias("kind"))
    edges = reduce(DataFrame.unionByName, [J.edges(e.filter(F.col("kind") == k), k, "line") for k in ("physical", "acoustic", "sight")])
    nodes = c.select("graph_id", F.col("c_custkey").alias("room_id")).union(e.select("graph_id", "dst").distinct())
    return GraphTables(nodes.select("graph_id").distinct(), nodes, nodes.limit(0), edges)
