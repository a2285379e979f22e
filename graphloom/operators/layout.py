"""Sequence operators of layouts (Y01-Y22): ordering, interleaving, packing by prefix sums, patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FLOOR_ORDER = {"ground": 0, "teaching": 1, "top": 2}
FIXED_WIDTH = {"staircase": 4.0, "toilet": 5.5}
#: Patterns used where no motif dictionary is there (id, frequency, percentage, rooms).
DEFAULT_PATTERNS = (
    ("P1", 10, 0.3, {"classroom": 4, "corridor": 1}), ("P2", 8, 0.25, {"classroom": 2}), ("P3", 6, 0.2, {"classroom": 2, "teacher_office": 1}),
    ("P4", 5, 0.15, {"staircase": 1, "toilet": 1}), ("P5", 4, 0.1, {"special_classroom": 2, "music_room": 1}),
)
#: Width and depth of a placed room by type; (6, 6) for others.
DEFAULT_SIZES = {
    "classroom": (8, 8), "special_classroom": (8, 10), "music_room": (9, 9), "library": (10, 10), "office": (4, 6), "teacher_office": (5, 8),
    "corridor": (3, 30), "staircase": (4, 8), "toilet": (4, 5), "storage": (3, 4), "entrance_hall": (6, 8),
}


def floor_rank() -> Column:
    """Ground, teaching, top."""
    return F.coalesce(*[F.when(F.col("typical_floor") == k, v) for k, v in FLOOR_ORDER.items()], F.lit(9))


def pick(nodes: DataFrame, *types: str) -> DataFrame:
    """Y10."""
    return nodes.filter(F.col("room_type").isin(*types))


def split_physical(nodes: DataFrame, floors: int) -> DataFrame:
    """(…, phys): rooms of a floor dealt to `floors` physical ones: round robin; toilets and storage in
    consecutive shares; the i-th corridor or staircase to floor i modulo the number."""
    w = Window.partitionBy("graph_id", "typical_floor", "room_type").orderBy("ord")
    flex = Window.partitionBy("graph_id", "typical_floor", F.col("room_type").isin("toilet", "storage", "corridor", "staircase")).orderBy("ord")
    i, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy("graph_id", "typical_floor", "room_type"))
    share = F.floor(i * floors / n)
    phys = F.when(F.col("room_type").isin("toilet", "storage"), share).when(F.col("room_type").isin("corridor", "staircase"), F.pmod(i, F.lit(floors))).otherwise(F.pmod(F.row_number().over(flex) - 1, F.lit(floors)))
    return nodes.withColumn("phys", phys.cast("long"))


def interleave(nodes: DataFrame) -> DataFrame:
    """(…, pos): the i-th room of each type in turn, types by size (then first appearance) descending."""
    t = Window.partitionBy("graph_id", "room_type")
    d = nodes.withColumn("_r", F.row_number().over(t.orderBy("ord"))).withColumn("_n", F.count("*").over(t)).withColumn("_f", F.min("ord").over(t))
    return d.withColumn("pos", F.row_number().over(Window.partitionBy("graph_id").orderBy("_r", F.desc("_n"), "_f"))).drop("_r", "_n", "_f")


def row_width(area: Column) -> Column:
    """The width of a room in a row: area over 9, at least 7, and a wall of 0.3."""
    return F.greatest(F.lit(7.0), area / 9) + 0.3


def width_estimate(nodes: DataFrame, ends: float = 8.0) -> DataFrame:
    """(graph_id, typical_floor, width, least): a row of all rooms and its ends; and the sum of 0.9 sqrt(area)."""
    return nodes.groupBy("graph_id", "typical_floor").agg((F.sum(row_width(F.col("area"))) + ends).alias("width"), F.sum(F.sqrt("area") * 0.9).alias("least"))


def pack_rows(nodes: DataFrame, height: float = 7.0, total: float | None = None, order: str = "ord") -> DataFrame:
    """(…, x0, w): rooms of a floor side by side; width is area over height, fixed for stairs and toilets, scaled so
    that the row has the total width if given; those that come out under 2 m are skipped and take no room."""
    g = Window.partitionBy("graph_id", "typical_floor")
    fixed = F.coalesce(*[F.when(F.col("room_type") == k, v) for k, v in FIXED_WIDTH.items()])
    d = nodes.withColumn("_fixed", fixed).withColumn("w", F.coalesce("_fixed", F.col("area") / height))
    if total:
        free = F.sum(F.when(F.col("_fixed").isNull(), F.col("w")).otherwise(0.0)).over(g)
        held = F.sum(F.coalesce("_fixed", F.lit(0.0))).over(g)
        d = d.withColumn("w", F.coalesce("_fixed", F.col("w") * F.greatest(F.lit(0.0), F.try_divide(total - held, free))))
    d = d.filter(F.col("w") >= 2)
    before = F.sum("w").over(g.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("x0", F.coalesce(before, F.lit(0.0))).drop("_fixed")


def strips(nodes: DataFrame, width: float = 50.0, per_row: int = 6) -> DataFrame:
    """(…, row, x0, w, h): largest rooms first, `per_row` a strip; a strip's height is its area over the width, a room's width its share.

    In a strip without area the shares are 0 / 0: the widths are NaN, as in the SQL."""
    o = Window.partitionBy("graph_id", "typical_floor").orderBy(F.desc("area"), "ord")
    d = nodes.withColumn("_i", F.row_number().over(o) - 1).withColumn("row", F.expr(f"cast(_i div {per_row} as long)"))
    r = Window.partitionBy("graph_id", "typical_floor", "row")
    share = F.coalesce(F.try_divide(F.col("area"), F.sum("area").over(r)), F.col("area") * float("inf"))
    d = d.withColumn("h", F.sum("area").over(r) / width).withColumn("w", share * width)
    return d.withColumn("x0", F.coalesce(F.sum("w").over(r.orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_i")


def even_positions(nodes: DataFrame, width: float, own: float = FIXED_WIDTH["toilet"]) -> DataFrame:
    """(…, cx): centres of rooms of width `own` in a row: one in the middle, two flush with the ends, more at the centres
    of equal segments."""
    g = Window.partitionBy("graph_id", "typical_floor")
    i, n = F.row_number().over(g.orderBy("ord")) - 1, F.count("*").over(g)
    return nodes.withColumn("cx", F.when(n == 1, width / 2).when(n == 2, own / 2 + i * (width - own)).otherwise((i + 0.5) * width / n))


def floor_plan(nodes: DataFrame, height: float = 7.0, spine: float = 2.4) -> DataFrame:
    """Rectangles (graph_id, room_id, typical_floor, x, y, w, h) of each floor: rooms interleaved into a south
    and a north row by turns along a corridor spine; floors stacked in order."""
    d = interleave(nodes.filter("room_type <> 'corridor'")).withColumn("side", F.pmod(F.col("pos"), F.lit(2)))
    g = Window.partitionBy("graph_id", "typical_floor", "side")
    d = d.withColumn("w", F.greatest(F.lit(2.0), F.col("area") / height))
    d = d.withColumn("x", F.coalesce(F.sum("w").over(g.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    y = floor_rank() * (2 * height + spine + 4) + F.when(F.col("side") == 1, height + spine).otherwise(0.0)
    return d.select("graph_id", "room_id", "typical_floor", "x", y.alias("y"), "w", F.lit(height).alias("h"))


def plan_error(nodes: DataFrame, rects: DataFrame) -> DataFrame:
    """(graph_id, typical_floor, stored, drawn, error): areas stored and drawn."""
    r = rects.groupBy("graph_id", "typical_floor").agg(F.sum(F.col("w") * F.col("h")).alias("drawn"))
    s = nodes.filter("room_type <> 'corridor'").groupBy("graph_id", "typical_floor").agg(F.sum("area").alias("stored"))
    return s.join(r, ["graph_id", "typical_floor"]).withColumn("error", F.abs(F.col("drawn") - F.col("stored")) / F.col("stored"))


def grid(n: int, rows: int, spark: SparkSession) -> DataFrame:
    """(i, col, row) of n cells."""
    per = max(1, n // rows)
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") % per).alias("col"), F.expr(f"id div {per}").alias("row"))


def _pattern(name: str, rooms: dict) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("pattern"), F.lit(t).alias("room_type"), (n if isinstance(n, Column) else F.lit(n)).cast("int").alias("count")) for t, n in rooms.items()])


def sub_patterns(comp: DataFrame) -> DataFrame:
    """(motif_id, pattern, room_type, count) from compositions (motif_id, room_type, mean), means truncated: a teaching unit
    U1 of up to six classrooms from four on, U2 of half of them from eight on, a core C1 of a staircase and a toilet, an office
    pair O1, up to three special classrooms S1; the default patterns where none of them comes about."""
    whole = comp.filter("mean >= 0.5").withColumn("_n", F.col("mean").cast("int"))
    n = lambda t: F.coalesce(F.max(F.when(F.col("room_type") == t, F.col("_n"))), F.lit(0))
    kinds = ("classroom", "staircase", "toilet", "office", "teacher_office", "special_classroom")
    c = comp.select("motif_id").distinct().join(whole.groupBy("motif_id").agg(*[n(t).alias(t) for t in kinds]), "motif_id", "left").fillna(0, list(kinds))
    room, none = F.col("classroom"), F.array().cast("array<struct<pattern:string,room_type:string,count:int>>")
    part = lambda ok, *a: F.when(ok, _pattern(*a)).otherwise(none)
    found = F.concat(
        part(room >= 4, "U1", {"classroom": F.least(F.lit(6), room), "corridor": 1, "toilet": 1}),
        part(room >= 8, "U2", {"classroom": F.floor(room / 2), "corridor": 1}),
        part((F.col("staircase") >= 1) & (F.col("toilet") >= 1), "C1", {"staircase": 1, "toilet": 1}),
        part(F.col("office") + F.col("teacher_office") >= 2, "O1", {"office": 2}),
        part(F.col("special_classroom") >= 1, "S1", {"special_classroom": F.least(F.lit(3), F.col("special_classroom"))}),
    )
    plain = F.concat(*[_pattern(p, rooms) for p, _, _, rooms in DEFAULT_PATTERNS])
    return c.select("motif_id", F.inline(F.when(F.size(found) > 0, found).otherwise(plain)))


def default_patterns(spark: SparkSession) -> DataFrame:
    """(pattern, room_type, count, frequency, percentage) of the patterns without a dictionary (returned, where the original returned nothing)."""
    return spark.createDataFrame([(p, t, n, f, s) for p, f, s, rooms in DEFAULT_PATTERNS for t, n in rooms.items()], "pattern string, room_type string, count int, frequency int, percentage double")


def top_types(comp: DataFrame, k: int = 5, cap: int = 6) -> DataFrame:
    """(motif_id, room_type, count): of each motif the k most frequent types but corridors (ties by type), as many rooms as
    the mean truncates to, from one to `cap`."""
    w = Window.partitionBy("motif_id").orderBy(F.desc("mean"), "room_type")
    n = F.greatest(F.lit(1), F.least(F.col("mean").cast("int"), F.lit(cap)))
    return comp.filter("room_type <> 'corridor'").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).select("motif_id", "room_type", n.alias("count"), "k")


def template(comp: DataFrame, wrap: float = 40.0) -> DataFrame:
    """(motif_id, i, room_type, x, y, w, h): the rooms of top_types() side by side, 0.3 apart; a new line, one below the last
    room, begins once the line passes `wrap`. A motif has at most 30 rooms."""
    size = "map(" + ", ".join(f"'{t}', named_struct('w', {w}D, 'h', {h}D)" for t, (w, h) in DEFAULT_SIZES.items()) + ")"
    lists = top_types(comp).groupBy("motif_id").agg(F.expr("flatten(transform(array_sort(collect_list(struct(k, room_type, count))), s -> array_repeat(s.room_type, s.count)))").alias("t"))
    step = (
        f"aggregate(transform(t, r -> named_struct('t', r, 'd', coalesce(try_element_at({size}, r), named_struct('w', 6D, 'h', 6D)))),"
        " named_struct('x', 0D, 'y', 0D, 'out', cast(array() as array<struct<room_type:string,x:double,y:double,w:double,h:double>>)),"
        " (a, r) -> named_struct("
        f"'x', if(a.x + r.d.w + 0.3D > {wrap}D, 0D, a.x + r.d.w + 0.3D), 'y', if(a.x + r.d.w + 0.3D > {wrap}D, a.y + r.d.h + 1D, a.y),"
        " 'out', concat(a.out, array(named_struct('room_type', r.t, 'x', a.x, 'y', a.y, 'w', r.d.w, 'h', r.d.h)))), a -> a.out)"
    )
    return lists.select("motif_id", F.posexplode(F.expr(step)).alias("i", "r")).select("motif_id", "i", "r.*")


def place_pattern(canvas: DataFrame, pattern: DataFrame, x: float, y: float, step: float = 9.0, wrap: int = 6) -> DataFrame:
    """Canvas rows and those of the pattern (room_type, count) from (x, y) on, `wrap` a row, labels numbered on by type."""
    have = canvas.groupBy("room_type").agg(F.count("*").alias("had"))
    p = pattern.select("room_type", F.explode(F.sequence(F.lit(1), "count")).alias("i")).join(have, "room_type", "left")
    k = F.row_number().over(Window.orderBy("room_type", "i")) - 1  # a pattern has a few rooms
    new = p.withColumn("k", k).select("room_type", F.concat("room_type", F.lit("_"), F.coalesce("had", F.lit(0)) + F.col("i")).alias("label"), (x + F.pmod(F.col("k"), F.lit(wrap)) * step).alias("x"), (y + F.expr(f"k div {wrap}") * step).alias("y"))
    return canvas.select("room_type", "label", "x", "y").unionByName(new)


def missing_essentials(canvas: DataFrame) -> DataFrame:
    """(room_type, add): a corridor if none, staircases up to two, and toilets for the canvas's span if none."""
    n = lambda t: F.coalesce(F.sum((F.col("room_type") == t).cast("int")), F.lit(0))
    span = F.coalesce(F.max("x") - F.min("x"), F.lit(0.0))
    a = canvas.agg(F.when(n("corridor") == 0, 1).otherwise(0).alias("corridor"), F.greatest(F.lit(0), 2 - n("staircase")).alias("staircase"), F.when(n("toilet") == 0, F.greatest(F.lit(1), F.floor(span / 35).cast("int") + 1)).otherwise(0).alias("toilet"))
    return a.select(F.expr("stack(3, 'corridor', cast(corridor as long), 'staircase', cast(staircase as long), 'toilet', cast(toilet as long)) as (room_type, add)")).filter("add > 0")


def clear(canvas: DataFrame) -> DataFrame:
    """Y21."""
    return canvas.limit(0)
