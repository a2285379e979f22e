"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_norm(value: Column, most: Column | float) -> Column:
    """Value / most clamped to [0, 1]; 0 where most is not positive."""
    m = most if isinstance(most, Column) else F.lit(float(most))
    return F.when(m <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(value.cast("double"), m))))


def overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Whether two closed floor ranges share a floor."""
    return F.greatest(a_lo, b_lo) <= F.least(a_hi, b_hi)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Plane distance; floors do not count."""
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def hash_uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on its key alone, not on partitioning: 32 bits of md5 of the joined parts."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("double") / 4294967296.0


def half_even(value: Column) -> Column:
    """Rounding to the nearest integer, halves to the even one."""
    return F.rint(value)


def occupancy(area: Column, density: Column) -> Column:
    """Persons in a room, at least one."""
    return F.greatest(F.lit(1), F.floor(area / density).cast("int"))


def requires_daylight(level: Column) -> Column:
    """HIGH or VERY_HIGH."""
    return level >= 3


def floors_spanned(lo: Column, hi: Column) -> Column:
    """P03."""
    return hi - lo + 1


def typical_floor_of(mid: Column) -> Column:
    """Below 0.5 ground, above 3 top, else teaching."""
    return F.when(mid < 0.5, "ground").when(mid > 3.0, "top").otherwise("teaching")


def label_prefix(room_id: Column) -> Column:
    """The text before the first underscore."""
    return F.substring_index(room_id, "_", 1)


def touches(ax, ay, aw, ah, bx, by, bw, bh, gap: float = 0.5) -> Column:
    """Rectangles that overlap or lie within `gap` of each other on both axes."""
    return (ax - gap <= bx + bw) & (bx - gap <= ax + aw) & (ay - gap <= by + bh) & (by - gap <= ay + ah)
