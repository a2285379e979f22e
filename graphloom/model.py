"""The data model: four keyed tables for a collection of graphs, and the room-type catalog."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Orders and levels of the enumerations, the catalog rows, and the rule parameters.
ROOM_TYPES = (
    "classroom", "special_classroom", "music_room", "gymnasium", "library", "office", "teacher_office",
    "corridor", "staircase", "toilet", "storage", "cafeteria", "entrance_hall",
)
ENV_TYPES = ("south_facing", "main_road_access", "playground", "green_space")
ZONES = ("teaching", "special", "admin", "service", "circulation", "mixed")
DAYLIGHT = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "VERY_HIGH": 4}
NOISE = {"QUIET": 0, "MODERATE": 1, "NOISY": 2, "LOUD": 3, "VERY_LOUD": 4}
#: type: zone, area min, max, aspect min, max, daylight, noise, tolerance, m2 a person, exits, floors
CATALOG = {
    "classroom": ("teaching", 54.0, 72.0, 1.0, 1.8, "HIGH", "MODERATE", "MODERATE", 1.2, 2, (1, 2, 3)),
    "special_classroom": ("special", 72.0, 96.0, 1.0, 1.8, "HIGH", "MODERATE", "MODERATE", 1.5, 2, (1, 2, 3)),
    "music_room": ("special", 72.0, 90.0, 1.0, 1.6, "MEDIUM", "LOUD", "QUIET", 1.5, 2, (0, 1)),
    "gymnasium": ("special", 400.0, 800.0, 1.4, 2.0, "MEDIUM", "VERY_LOUD", "QUIET", 3.0, 3, (0,)),
    "library": ("special", 100.0, 200.0, 1.0, 2.5, "HIGH", "QUIET", "QUIET", 2.0, 2, (0, 1)),
    "office": ("admin", 15.0, 30.0, 1.0, 2.0, "MEDIUM", "MODERATE", "MODERATE", 4.0, 1, (0, 1)),
    "teacher_office": ("admin", 30.0, 60.0, 1.0, 2.0, "HIGH", "MODERATE", "QUIET", 3.0, 1, (1, 2, 3)),
    "corridor": ("circulation", 12.0, 300.0, 3.0, 12.0, "LOW", "NOISY", "LOUD", 0.3, 2, (0, 1, 2, 3, 4)),
    "staircase": ("circulation", 18.0, 30.0, 1.0, 2.0, "NONE", "MODERATE", "LOUD", 0.5, 2, (0, 1, 2, 3, 4)),
    "toilet": ("service", 25.0, 55.0, 1.0, 2.5, "NONE", "MODERATE", "MODERATE", 0.8, 1, (0, 1, 2, 3, 4)),
    "storage": ("service", 6.0, 15.0, 1.0, 3.0, "NONE", "QUIET", "LOUD", 0.1, 1, (0, 1, 2, 3, 4)),
    "cafeteria": ("service", 200.0, 400.0, 1.0, 2.5, "MEDIUM", "NOISY", "NOISY", 1.0, 3, (0,)),
    "entrance_hall": ("admin", 40.0, 80.0, 1.0, 3.0, "MEDIUM", "NOISY", "LOUD", 0.5, 2, (0,)),
}
RULES = {
    "occupancy_threshold": 50, "daylight_min_edges": 1, "noise_gap": 2, "min_path": 2, "proximity": 15.0,
    "attenuation": 45.0, "music_attenuation": 55.0, "circulation": (0.10, 0.30), "floor_corridor": (0.10, 0.25),
    "area_tolerance": 0.05, "service_radius": 30.0, "site": (0.0, 0.0, 200.0, 150.0),
    "per_floor_area": {"small": 800.0, "medium": 1116.0, "large": 1404.0},
}
#: Largest values that features are divided by.
MAX_AREA, MAX_ASPECT, MAX_OCCUPANCY, MAX_EXITS, MAX_FLOOR, MAX_DB, SITE_DIAGONAL = 800.0, 12.0, 300.0, 4.0, 4.0, 60.0, 250.0
RELATIONS = (
    "room>physical>room", "room>acoustic>room", "room>sight>room", "room>sight>environment", "room>physical>environment",
)
HARD = ("fire_exits", "daylight", "acoustic", "connectivity", "area_completeness", "floor_corridor_ratio")
CONSTRAINTS = ("fire_exits", "daylight", "acoustic", "connectivity", "area_bounds", "circulation_ratio", "area_completeness", "floor_corridor_ratio")

SPEC_SCHEMA = "room_type string, type_idx int, zone string, zone_idx int, area_min double, area_max double, aspect_min double, aspect_max double, daylight int, noise int, tolerance int, density double, exits int, floors array<int>"
EDGE_ATTRS = ("distance_weight", "is_stair", "attenuation_db", "transparency", "sight_distance", "orientation", "distance", "access_type")


@dataclass(frozen=True)
class GraphTables:
    """A collection of graphs. nodes carries its type's catalog columns; edges is a bag."""

    graphs: DataFrame
    nodes: DataFrame
    env: DataFrame
    edges: DataFrame

    def with_(self, **kw) -> GraphTables:
        return replace(self, **kw)

    def view(self, rel: str, dst_kind: str | None = None) -> DataFrame:
        """The edges of one relation, of one kind of destination if given."""
        out = self.edges.filter(F.col("rel") == rel)
        return out.filter(F.col("dst_kind") == dst_kind) if dst_kind else out


def spec_row(name: str, raw: tuple) -> tuple:
    """SC05: a catalog row with level names as ordinals; KeyError for an unknown type or level."""
    zone, a0, a1, r0, r1, day, noise, tol, density, exits, floors = raw
    return (name, ROOM_TYPES.index(name) if name in ROOM_TYPES else _unknown(name), zone, ZONES.index(zone), a0, a1, r0, r1, DAYLIGHT[day], NOISE[noise], NOISE[tol], density, exits, list(floors))


def _unknown(name: str) -> int:
    raise KeyError(f"unknown room type {name}")


def catalog(spark: SparkSession, rows: dict[str, tuple] | None = None, complete: bool = True) -> DataFrame:
    """SC01, SC04, SC05b: the catalog as a table; the built-in rows where none are given.

    KeyError for an unknown type and, if `complete`, for a missing one. 13 rows: safe to broadcast.
    """
    rows = CATALOG if rows is None else rows
    if complete and (gone := [t for t in ROOM_TYPES if t not in rows]):
        raise KeyError(f"missing room types {gone}")
    return spark.createDataFrame([spec_row(k, v) for k, v in rows.items()], SPEC_SCHEMA)


def lookup(spec: DataFrame, room_type: str) -> DataFrame:
    """SC02: one catalog row; the query fails for a type that is not there."""
    one = spec.filter(F.col("room_type") == room_type)
    there = spec.agg(F.max((F.col("room_type") == room_type).cast("int")).alias("n"))
    ok = there.select(F.when(F.col("n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"no room type {room_type}")).cast("boolean")).alias("ok"))
    return one.crossJoin(F.broadcast(ok.filter("ok"))).drop("ok")  # one row each


def config_row(spark: SparkSession, given: dict | None = None) -> DataFrame:
    """SC03: rule parameters as one row; every one that is not given has its default."""
    flat = {k: v for k, v in RULES.items() if isinstance(v, int | float)}
    return spark.createDataFrame([tuple(float((given or {}).get(k, v)) for k, v in flat.items())], T.StructType([T.StructField(k, T.DoubleType()) for k in flat]))
