"""Shared pieces of the operators on integer vectors: usable rows, whole numbers, exact arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = (1 << 63) - 1


def integers(vectors: DataFrame, factor: int, vec_col: str, *others: str) -> DataFrame:
    """(others..., vec array<long>): floor(factor * component) of the vectors that are not null and hold neither nulls nor non-finite components.

    Numbers beyond a long's range are cut to it, as Spark's floor does.
    """
    finite = F.expr("vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = vectors.select(*others, F.col(vec_col).cast("array<double>").alias("vec")).filter(finite)
    return rows.select(*others, F.transform("vec", lambda x: F.floor(x * F.lit(float(factor)))).alias("vec"))


def flat(vec: pa.ListArray, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(components, lengths) of rows lo to hi."""
    at = vec.offsets.to_numpy()[lo : (len(vec) if hi is None else hi) + 1]
    return vec.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], np.diff(at)


def largest(x: np.ndarray) -> int:
    """The largest absolute value, at least 1, as an integer that cannot overflow."""
    return max(1, -int(x.min()), int(x.max())) if x.size else 1


def whole(bound: int) -> type:
    """The fastest type in which integers up to `bound` are exact."""
    return np.int32 if bound < 1 << 31 else np.int64 if bound <= LONG else object


def matrix_type(bound: int) -> type:
    """As `whole`, for matrix products: doubles hold integers up to 2^53 exactly, and BLAS multiplies them."""
    return np.float64 if bound <= 1 << 53 else np.int64 if bound <= LONG else object


def as_long(x: np.ndarray) -> np.ndarray:
    """As int64, cut to its range."""
    return np.array([min(max(int(v), -LONG - 1), LONG) for v in x], np.int64) if x.dtype == object else x.astype(np.int64)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all entries, exact in a type of `matrix_type`."""
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]


def distance_type(x: np.ndarray, entries: np.ndarray) -> type:
    """The type for `squared`: its terms and four times its results are exact."""
    return matrix_type(4 * x.shape[1] * (largest(x) + largest(entries)) ** 2)


def long_sum(column: str | Column) -> Column:
    """The sum of longs, cut to a long's range."""
    total = F.sum(F.col(column).cast("decimal(38,0)") if isinstance(column, str) else column.cast("decimal(38,0)"))
    limit = F.lit(LONG).cast("decimal(38,0)")
    return F.least(F.greatest(total, -limit - 1), limit).cast("long")


def grouped_sums(x: np.ndarray, group: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list]:
    """(groups, their weights, their component sums as Python integers), exact."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    weight = np.ones(len(x), np.int64) if weight is None else weight
    kind = np.int64 if largest(x) * int(weight.sum()) <= LONG else object
    x = x.astype(np.int64).astype(kind) * weight.astype(kind)[:, None]
    order = np.argsort(group, kind="stable")
    groups, first = np.unique(group[order], return_index=True)
    return groups, np.add.reduceat(weight[order], first), np.add.reduceat(x[order], first, axis=0).tolist()
