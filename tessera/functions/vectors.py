"""Scores and maps of single vectors, as columns. Sums run in double, in ascending order of dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import FLT_MIN, Metric


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(values: Column, kind: str = "double") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda acc, x: acc + x)


def let(value: Column, f) -> Column:
    """f(value), with ``value`` evaluated once. The optimizer puts a column's expression where its name stands: one that is
    named twice would be copied, and one named in a lambda would be evaluated anew for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def dot_int(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a.cast("array<bigint>"), b.cast("array<bigint>"), lambda x, y: x * y), "bigint")


def part(v: Column, offset: int, length: int) -> Column:
    return F.slice(v, offset + 1, length)


def dequantized(q8: Column, scale: Column) -> Column:
    """float32 lanes of an int8 row."""
    return let(scale, lambda s: F.transform(q8, lambda x: x.cast("float") * s))


def scaled_double(q8: Column, scale: Column) -> Column:
    return let(scale.cast("double"), lambda s: F.transform(q8, lambda x: x.cast("double") * s))


def floor_to_float(score: Column) -> Column:
    """Subnormal results become 0; one rounding to float32."""
    return F.when(F.abs(score) < FLT_MIN, F.lit(0.0)).otherwise(score).cast("float")


# -- integer mode --------------------------------------------------------------------------------------------------


def xd_dot(cross: Column, row_scale: Column, q_scale: Column) -> Column:
    return cross.cast("double") * (row_scale.cast("double") * q_scale)


def xd_l2(cross: Column, row_sq: Column, q_sq: Column, row_scale: Column, q_scale: Column) -> Column:
    rs = row_scale.cast("double")
    return ((q_scale * q_scale) * q_sq.cast("double") + (rs * rs) * row_sq.cast("double")) - ((rs * q_scale) * cross.cast("double")) * F.lit(2.0)


def xd_pair(metric: Metric, cross: Column, a_sq: Column, b_sq: Column, a_scale: Column, b_scale: Column, zero: float | None = None) -> Column:
    """A pair's distance: dot keeps its similarity, cosine is 1 - cos (``zero`` where a side has no energy)."""
    if metric is Metric.DOT:
        return xd_dot(cross, a_scale, b_scale)
    if metric is Metric.L2:
        return xd_l2(cross, a_sq, b_sq, a_scale, b_scale)
    energy = a_sq.cast("double") * b_sq.cast("double")
    value = F.lit(1.0) - cross.cast("double") / F.sqrt(F.when(energy > 0, energy))
    return F.coalesce(value, F.lit(zero)) if zero is not None else value


# -- order ---------------------------------------------------------------------------------------------------------


def best_first(metric: Metric, score: str = "score", row: str = "row_id") -> list[Column]:
    """The total order: better score, then the smaller row."""
    return [F.col(score).desc() if metric.higher_is_better else F.col(score).asc(), F.col(row).asc()]


def rank_distance(metric: Metric, score: Column) -> Column:
    if metric is Metric.L2:
        return score
    if metric is Metric.COSINE:
        return F.lit(1.0) - score
    raise ValueError("dot scores have no distance")
