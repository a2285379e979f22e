"""Synthesis of building graphs (G01-G18) as relations with hash-keyed randomness.

Every draw is a uniform number from md5 of (seed, graph, entity, purpose), so results do not depend on
partitioning, retries are rows like others, and a collection of any size is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import hash_uniform
from graphloom.model import RULES, GraphTables, catalog
from graphloom.operators import constraints as C
from graphloom.operators import topology as J
from graphloom.session import held

# Rooms of each school size, the rooms a typical floor may hold, and the least it must.
PROGRAM = {
    "small": {"classroom": 12, "special_classroom": 3, "music_room": 1, "teacher_office": 3, "staircase": 6, "toilet": 3, "storage": 3, "entrance_hall": 1},
    "medium": {"classroom": 24, "special_classroom": 4, "music_room": 2, "teacher_office": 5, "staircase": 8, "toilet": 5, "storage": 5, "entrance_hall": 1},
    "large": {"classroom": 36, "special_classroom": 6, "music_room": 3, "teacher_office": 8, "staircase": 10, "toilet": 7, "storage": 8, "entrance_hall": 1},
}
FLOOR_ROOMS = {
    "ground": ("entrance_hall", "corridor", "staircase", "toilet", "storage", "special_classroom", "teacher_office"),
    "teaching": ("classroom", "special_classroom", "teacher_office", "music_room", "corridor", "staircase", "toilet", "storage"),
    "top": ("classroom", "special_classroom", "corridor", "staircase", "toilet", "teacher_office"),
}
FLOOR_LEAST = {"ground": {"entrance_hall": 1, "staircase": 2, "toilet": 1}, "teaching": {"staircase": 2, "toilet": 1}, "top": {"staircase": 2, "toilet": 1}}
GREEN = {"small": 1, "medium": 2, "large": 3}
ATTEMPTS = 5
TYPE_IDS = {"ground": "G", "teaching": "T", "top": "P"}


def requests(spark: SparkSession, total: int, sizes: tuple[str, ...] = ("small", "medium", "large"), floors: tuple[int, int] = (2, 5), seed: int = 42, split: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """(graph_id, school_size, num_floors, seed, split) of `total` graphs; sizes in turn, floors and splits by hash.

    ValueError for an unknown size, a bad floor range, or shares that do not sum to one."""
    if bad := [s for s in sizes if s not in PROGRAM]:
        raise ValueError(f"unknown sizes {bad}")
    if not 1 <= floors[0] <= floors[1] or abs(sum(split) - 1) > 1e-9:
        raise ValueError("bad floor range or split")
    r = spark.range(total).withColumnRenamed("id", "graph_id")
    size = F.element_at(F.array(*[F.lit(s) for s in sizes]), (F.col("graph_id") % len(sizes) + 1).cast("int"))
    n = floors[0] + F.floor(hash_uniform(seed, F.col("graph_id"), "floors") * (floors[1] - floors[0] + 1)).cast("int")
    u = hash_uniform(seed, F.col("graph_id"), "split")
    part = F.when(u < split[0], "train").when(u < split[0] + split[1], "val").otherwise("test")
    return r.select("graph_id", size.alias("school_size"), n.alias("num_floors"), (F.col("graph_id") + seed).alias("seed"), part.alias("split"))


def typical_floors(graphs: DataFrame) -> DataFrame:
    """Graphs with (typical_floor, floor_lo, floor_hi): ground; teaching from two floors on; a top from five on."""
    n = F.col("num_floors")
    row = lambda t, lo, hi: F.struct(F.lit(t).alias("typical_floor"), F.lit(lo).cast("int").alias("floor_lo"), hi.cast("int").alias("floor_hi"))
    top = F.struct(F.lit("top").alias("typical_floor"), (n - 1).cast("int").alias("floor_lo"), (n - 1).cast("int").alias("floor_hi"))
    fl = F.when(n >= 5, F.array(row("ground", 0, F.lit(0)), row("teaching", 1, n - 2), top)).when(n >= 2, F.array(row("ground", 0, F.lit(0)), row("teaching", 1, n - 1))).otherwise(F.array(row("ground", 0, F.lit(0))))
    return graphs.select("*", F.explode(fl).alias("f")).select(*graphs.columns, "f.*")


def program(graphs: DataFrame) -> DataFrame:
    """Graphs with (room_type, count) of their size's template."""
    spark = graphs.sparkSession
    rows = spark.createDataFrame([(s, t, n) for s, p in PROGRAM.items() for t, n in p.items()], "school_size string, room_type string, count int")
    return graphs.join(F.broadcast(rows), "school_size")  # a few dozen rows


def floor_program(graphs: DataFrame) -> DataFrame:
    """(…, typical_floor, floor_lo, floor_hi, room_type, count): the program dealt to floors.

    A type goes to the floors that may hold it in proportion to the physical floors they stand for, whole
    rooms by truncation, the rest to the teaching floor; each floor has at least its template's rooms and
    two staircases a physical floor; corridors are 13 % of the footprint in pieces of 30 m2, at least
    eight, dealt 30 : 60 : 10. Types without any floor (classrooms of a one-floor building) fall away."""
    spark = graphs.sparkSession
    may = spark.createDataFrame([(f, t, FLOOR_LEAST[f].get(t, 0)) for f, ts in FLOOR_ROOMS.items() for t in ts], "typical_floor string, room_type string, least int")
    fl = typical_floors(graphs).join(F.broadcast(may), "typical_floor").filter("room_type <> 'corridor'").withColumn("span", F.col("floor_hi") - F.col("floor_lo") + 1)
    p = fl.join(program(graphs).select("graph_id", "room_type", "count"), ["graph_id", "room_type"])
    w = Window.partitionBy("graph_id", "room_type")
    given = F.floor(F.col("count") * F.col("span") / F.sum("span").over(w)).cast("int")
    p = p.withColumn("given", given).withColumn("k", F.row_number().over(w.orderBy(F.when(F.col("typical_floor") == "teaching", 0).otherwise(1), "floor_lo")))
    p = p.withColumn("given", F.col("given") + F.when(F.col("k") == 1, F.col("count") - F.sum("given").over(w)).otherwise(0))
    least = F.when(F.col("room_type") == "staircase", F.when(F.col("typical_floor") == "teaching", 2 * F.col("span")).otherwise(2)).otherwise(F.col("least"))
    rooms = p.select(*graphs.columns, "typical_floor", "floor_lo", "floor_hi", "room_type", F.greatest("given", least).cast("int").alias("count"))
    foot = F.coalesce(*[F.when(F.col("school_size") == k, v) for k, v in RULES["per_floor_area"].items()])
    halls = F.greatest(F.lit(8), F.floor(0.13 * foot * F.col("num_floors") / 30))
    share = F.when(F.col("num_floors") < 2, 1.0).when(F.col("typical_floor") == "ground", 0.3).when(F.col("typical_floor") == "top", 0.1).otherwise(F.when(F.col("num_floors") >= 5, 0.6).otherwise(0.7))
    corr = typical_floors(graphs).select(*graphs.columns, "typical_floor", "floor_lo", "floor_hi", F.lit("corridor").alias("room_type"), F.greatest(F.lit(1), F.floor(halls * share)).cast("int").alias("count"))
    return rooms.unionByName(corr).filter("count > 0")


def rooms(floor_prog: DataFrame, spec: DataFrame, seed_col: str = "seed") -> DataFrame:
    """One row a room, area within 10 % of the type's middle inside its range, aspect in its range,
    id {type}_{number of the type in the graph}_{G|T|P}{first floor}."""
    r = floor_prog.select("*", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("i")).join(F.broadcast(spec.drop("floors")), "room_type")
    w = Window.partitionBy("graph_id", "room_type").orderBy("floor_lo", "i")
    r = r.withColumn("number", F.row_number().over(w) - 1)
    code = F.coalesce(*[F.when(F.col("typical_floor") == k, v) for k, v in TYPE_IDS.items()])
    r = r.withColumn("room_name", F.format_string("%s_%03d_%s%d", "room_type", "number", code, "floor_lo"))
    u = lambda what: hash_uniform(F.col(seed_col), F.col("room_name"), what)
    mid = (F.col("area_min") + F.col("area_max")) / 2
    area = F.least("area_max", F.greatest("area_min", mid * (0.9 + 0.2 * u("area"))))
    aspect = F.col("aspect_min") + (F.col("aspect_max") - F.col("aspect_min")) * u("aspect")
    return r.withColumns({"area": area, "aspect_ratio": aspect}).drop("i")


def enforce_minimums(nodes: DataFrame) -> DataFrame:
    """Classrooms under 54 become 60, any room under 6 becomes 12."""
    return nodes.withColumn("area", F.when((F.col("room_type") == "classroom") & (F.col("area") < 54), 60.0).when(F.col("area") < 6, 12.0).otherwise(F.col("area")))


def allocate_areas(nodes: DataFrame) -> DataFrame:
    """Areas of each typical floor brought to its footprint times span.

    Corridors above 22 % of the nominal area are scaled to 20 %; the others are scaled to what is left and
    kept in their ranges; three passes then give a shortfall to the corridors and take an excess from
    rooms above their least; corridors above 24 % of the target end at 22 %."""
    foot = F.coalesce(*[F.when(F.col("school_size") == k, v) for k, v in RULES["per_floor_area"].items()])
    w = Window.partitionBy("graph_id", "typical_floor")
    hall = F.col("room_type") == "corridor"
    part = lambda cond: F.sum(F.when(cond, F.col("area")).otherwise(0.0)).over(w)
    d = nodes.withColumn("_t", foot * (F.col("floor_hi") - F.col("floor_lo") + 1)).withColumn("_h", part(hall)).withColumn("_s", F.sum("area").over(w))
    d = d.withColumn("area", F.when(hall & (F.col("_h") > 0.22 * F.col("_s")), F.col("area") * 0.2 * F.col("_s") / F.col("_h")).otherwise(F.col("area")))
    d = d.withColumn("_h", part(hall)).withColumn("_f", part(~hall))
    fit = F.col("area") * F.try_divide(F.col("_t") - F.col("_h"), F.col("_f"))
    d = d.withColumn("area", F.when(hall | (F.col("_f") <= 0), F.col("area")).otherwise(F.least("area_max", F.greatest("area_min", fit))))
    for _ in range(3):
        room = F.when(~hall, F.col("area") - F.col("area_min")).otherwise(0.0)
        d = d.withColumn("_h", part(hall)).withColumn("_g", F.col("_t") - F.sum("area").over(w)).withColumn("_r", F.sum(room).over(w))
        up = F.when(hall & (F.col("_g") > 0) & (F.col("_h") > 0), F.col("area") * F.try_divide(F.col("_h") + F.col("_g"), F.col("_h")))
        down = F.when(~hall & (F.col("_g") < 0) & (F.col("_r") > 0), F.col("area") - room * F.least(F.lit(1.0), F.try_divide(-F.col("_g"), F.col("_r"))))
        d = d.withColumn("area", F.coalesce(up, down, F.col("area")))
    d = d.withColumn("_h", part(hall)).withColumn("_f", part(~hall)).withColumn("_x", F.greatest(F.lit(0.0), F.col("_h") - 0.22 * F.col("_t")))
    over = F.col("_h") > 0.24 * F.col("_t")
    d = d.withColumn("area", F.when(over & hall, F.col("area") * F.try_divide(0.22 * F.col("_t"), F.col("_h"))).when(over & ~hall & (F.col("_f") > 0), F.col("area") * F.try_divide(F.col("_f") + F.col("_x"), F.col("_f"))).otherwise(F.col("area")))
    return d.select(*nodes.columns)


def place(nodes: DataFrame, seed_col: str = "seed") -> DataFrame:
    """Centroids within the site: a slice of y for each typical floor the graph has (ground, teaching, top upwards).

    Ground: administration west, special rooms and the cafeteria east, the entrance hall at the west end, others around the
    middle. Above: teaching rooms over the slice's centre, special rooms under it, corridors and stairs on it, stairs at the
    west end, the middle or the east end."""
    x0, y0, x1, y1 = RULES["site"]
    u = lambda what, lo, hi: lo + (hi - lo) * hash_uniform(F.col(seed_col), F.col("room_name"), what)
    mid = (x0 + x1) / 2
    ground, kind, zone = F.col("typical_floor") == "ground", F.col("room_type"), F.col("zone")
    d = nodes.withColumn("_slice", (y1 - y0) / F.size(F.collect_set("typical_floor").over(Window.partitionBy("graph_id"))))
    rank = F.when(ground, 0).when(F.col("typical_floor") == "teaching", 1).otherwise(2)
    base = y0 + (rank + 0.5) * F.col("_slice")
    third = F.floor(u("stair", 0.0, 3.0)).cast("int")
    east = (zone == "special") | (kind == "cafeteria")
    low_x = F.when(zone == "admin", u("x", x0 + 10, x0 + 50)).when(east, u("x", x1 - 50, x1 - 10)).when(kind == "entrance_hall", F.lit(x0 + 10)).otherwise(u("x", mid - 40, mid + 40))
    low_y = F.when((zone == "admin") | east, u("y", -10.0, 10.0)).when(kind == "entrance_hall", 0.0).otherwise(u("y", -5.0, 5.0))
    side = u("x", x0 + 10, x1 - 10)
    up_x = F.when(zone.isin("teaching", "special"), side).when(kind == "corridor", u("x", mid - 30, mid + 30)).when(kind == "staircase", F.when(third == 0, x0 + 10).when(third == 1, mid).otherwise(x1 - 10)).otherwise(side)
    up_y = F.when(zone == "teaching", F.col("_slice") * u("y", 0.1, 0.4)).when(zone == "special", -F.col("_slice") * u("y", 0.05, 0.35)).when(kind.isin("corridor", "staircase"), 0.0).otherwise(u("y", -10.0, 10.0))
    return d.withColumns({"x": F.when(ground, low_x).otherwise(up_x), "y": base + F.when(ground, low_y).otherwise(up_y)}).drop("_slice")


def environment(graphs: DataFrame, road_side: str = "west") -> DataFrame:
    """The environment nodes of each graph: south and road always, a playground from medium on, one to three greens."""
    x0, y0, x1, y1 = RULES["site"]
    mid = {"west": (x0, (y0 + y1) / 2), "east": (x1, (y0 + y1) / 2), "south": ((x0 + x1) / 2, y1), "north": ((x0 + x1) / 2, y0)}
    if road_side not in mid:
        raise ValueError(f"unknown side {road_side}")
    u = lambda *what: hash_uniform(F.col("seed"), *what)
    row = lambda kind, i, x, y, view=None: F.struct(F.lit(kind).alias("env_type"), i.cast("int").alias("i"), x.cast("double").alias("x"), y.cast("double").alias("y"), (view if view is not None else F.lit(None)).cast("double").alias("view_quality"))
    one = graphs.select("graph_id", "seed", F.explode(F.array(row("south_facing", F.lit(0), F.lit((x0 + x1) / 2), F.lit(y1)), row("main_road_access", F.lit(0), *map(F.lit, mid[road_side])))).alias("e"))
    play = graphs.filter("school_size <> 'small'").select("graph_id", "seed", row("playground", F.lit(0), x0 + 20 + (x1 - x0 - 40) * u("play", "x"), y0 + 10 + (0.4 * y1 - y0 - 10) * u("play", "y")).alias("e"))
    n = F.coalesce(*[F.when(F.col("school_size") == k, v) for k, v in GREEN.items()])
    g = graphs.select("graph_id", "seed", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    side = F.floor(u("green", F.col("i"), "side") * 4)
    along = u("green", F.col("i"), "along")
    gx = F.when(side == 0, x0 + 5).when(side == 1, x1 - 5).otherwise(x0 + (x1 - x0) * along)
    gy = F.when(side == 2, y0 + 5).when(side == 3, y1 - 5).otherwise(y0 + (y1 - y0) * along)
    green = g.select("graph_id", "seed", row("green_space", F.col("i"), gx, gy, 0.5 + 0.5 * u("green", F.col("i"), "view")).alias("e"))
    all_ = one.unionByName(play).unionByName(green).select("graph_id", "e.*")
    w = Window.partitionBy("graph_id").orderBy("env_type", "i")
    attrs = F.when(F.col("view_quality").isNotNull(), F.create_map(F.lit("view_quality"), F.col("view_quality")))
    return all_.select("graph_id", F.format_string("%s_%02d", "env_type", "i").alias("env_name"), "env_type", F.row_number().over(w).alias("env_ord"), (-F.row_number().over(w)).cast("long").alias("env_id"), "x", "y", attrs.alias("attributes"))


def build(graphs: DataFrame, seed: int = 42) -> GraphTables:
    """One attempt for each row of graphs (graph_id, school_size, num_floors, seed)."""
    spark = graphs.sparkSession
    n = rooms(floor_program(graphs), catalog(spark))
    n = place(allocate_areas(enforce_minimums(n)))
    w = Window.partitionBy("graph_id").orderBy("floor_lo", "type_idx", "number")
    n = n.withColumns({"ord": F.row_number().over(w), "floor": F.col("floor_lo"), "occupancy": F.greatest(F.lit(1), F.floor(F.col("area") / F.col("density")).cast("int"))}).withColumn("room_id", F.col("ord").cast("long"))
    n = n.drop("school_size", "num_floors", "split", "seed", "count")
    n = held(n)  # thirteen rules start from it
    g = GraphTables(graphs, n, held(environment(graphs)), n.limit(0))
    return g.with_(edges=held(J.apply_rules(g, seed=seed, keep=held)))


def with_retries(graphs: DataFrame, attempts: int = ATTEMPTS) -> tuple[GraphTables, DataFrame]:
    """The first attempt that passes all checks, else that with the fewest violations, with seeds 1000 apart.

    All attempts are rows of one collection; returns the winners' tables and (graph_id, attempt, all_passed, violations)."""
    each = graphs.select("*", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    each = each.withColumns({"_g": F.col("graph_id"), "graph_id": F.col("graph_id") * attempts + F.col("attempt"), "seed": F.col("seed") + 1000 * F.col("attempt")})
    t = build(each.drop("attempt", "_g"))
    st = C.status(t).groupBy("graph_id").agg(F.bool_and("passed").alias("all_passed"), F.sum("n_violations").alias("violations"))
    best = held(best_attempt(st.join(each.select("graph_id", F.col("_g").alias("source"), "attempt"), "graph_id")))
    keep = best.select("graph_id")
    pick = lambda d: d.join(keep, "graph_id", "left_semi")
    return GraphTables(pick(t.graphs), pick(t.nodes), pick(t.env), pick(t.edges)), best


def best_attempt(tries: DataFrame) -> DataFrame:
    """Of (source, attempt, all_passed, violations) the best of each source: passing first, then fewest, then earliest."""
    w = Window.partitionBy("source").orderBy(F.desc("all_passed"), "violations", "attempt")
    passed_first = F.when(F.col("all_passed"), 0).otherwise(F.col("violations"))
    return tries.withColumn("violations", passed_first).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def names() -> Column:
    """SK03: the key of a generated graph from (school_size, num_floors, n_rooms, seed)."""
    return F.format_string("school_%s_f%d_n%d_seed%d", "school_size", "num_floors", "n_rooms", "seed")
