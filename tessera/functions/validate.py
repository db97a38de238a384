"""Checks of banks, queries, segments and bias. Table checks are one aggregate each and name the first bad row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import (
    MAX_CHANNELS,
    MAX_DIMS,
    MAX_ROWS,
    MAX_SEGMENTS,
    Bank,
    CapacityExceeded,
    Channel,
    DimensionMismatch,
    InvalidArgument,
    Metric,
    NonFiniteInput,
    NonFiniteQuery,
    Quantization,
    QuerySpec,
    Segment,
    UnsupportedMode,
    ZeroNormQuery,
    ZeroNormRow,
)
from .bake import norm_squared
from .vectors import dequantized, dot_int, part


def not_finite(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())


def bad_source_rows(rows: DataFrame, dims: int, metric: Metric) -> DataFrame:
    """One row: n_bad, first_bad_size, first_not_finite, first_zero (row ids or null)."""
    size = F.col("vec").isNull() | (F.size("vec") != dims)
    odd = ~size & not_finite(F.col("vec"))
    zero = ~size & ~odd & (norm_squared(F.col("vec")) == 0) & F.lit(metric is Metric.COSINE)
    return rows.agg(*[f(F.when(c, F.col("row_id"))).alias(n) for f, c, n in ((F.count, size | odd | zero, "n_bad"), (F.min, size, "first_bad_size"), (F.min, odd, "first_not_finite"), (F.min, zero, "first_zero"))])


def validate_source_rows(rows: DataFrame, dims: int, metric: Metric) -> None:
    if not 0 < dims <= MAX_DIMS:
        raise InvalidArgument(f"dims {dims}")
    found = bad_source_rows(rows, dims, metric).first()
    if found["first_bad_size"] is not None:
        raise DimensionMismatch(f"row {found['first_bad_size']} has not {dims} lanes")
    if found["first_not_finite"] is not None:
        raise NonFiniteInput(f"row {found['first_not_finite']} is not finite", found["first_not_finite"])
    if found["first_zero"] is not None:
        raise ZeroNormRow(f"row {found['first_zero']} has no direction", found["first_zero"])


def bad_bank_rows(bank: Bank) -> DataFrame:
    """One row: n_bad and first_bad of baked rows (size, lanes, scale, and unit length in a cosine bank)."""
    if bank.is_int8:
        size = F.size("q8") != bank.dims
        lanes = F.exists("q8", lambda x: x == -128) | F.isnan("scale") | (F.abs("scale") == float("inf")) | (F.col("scale") < 0)
        lanes |= (F.col("scale") == 0) & F.exists("q8", lambda x: x != 0)
        norm, slack = F.sqrt(norm_squared(dequantized(F.col("q8"), F.col("scale")))), F.col("scale").cast("double") * 0.5 * math.sqrt(bank.dims)
    else:
        size, lanes = F.size("vec") != bank.dims, not_finite(F.col("vec"))
        norm, slack = F.sqrt(norm_squared(F.col("vec"))), F.lit(0.0)
    bad = size | lanes
    if bank.metric is Metric.COSINE:
        bad |= F.abs(norm - 1) > slack + 1e-3
    return bank.df.agg(F.count(F.when(bad, 1)).alias("n_bad"), F.min(F.when(bad, F.col("row_id"))).alias("first_bad"))


def validate_bank(bank: Bank, data: bool = False) -> None:
    if not 0 < bank.dims <= MAX_DIMS:
        raise InvalidArgument(f"dims {bank.dims}")
    check_channels(bank.channels, bank.dims, bank.quantization)
    if data:
        if bank.df.count() > MAX_ROWS:
            raise CapacityExceeded("too many rows")
        first = bad_bank_rows(bank).first()["first_bad"]
        if first is not None:
            raise NonFiniteInput(f"row {first} is invalid", first)


def check_channels(channels, dims: int, quantization: Quantization) -> None:
    if len(channels) > MAX_CHANNELS:
        raise InvalidArgument(f"more than {MAX_CHANNELS} channels")
    names = [c.name for c in channels]
    if any(not n for n in names) or len(set(names)) != len(names):
        raise InvalidArgument("channel names must be unique and not empty")
    _ranges([(c.offset, c.length) for c in channels], dims, quantization)


def _ranges(ranges: list[tuple[int, int]], dims: int, quantization: Quantization) -> None:
    g = quantization.grid
    end, most = 0, -(-dims // g) * g
    for offset, length in ranges:
        if length <= 0 or offset < 0 or offset % g or length % g and offset + length != dims:
            raise InvalidArgument(f"range {offset}+{length} is off the grid of {g}")
        if offset < end:
            raise InvalidArgument("ranges must ascend and not overlap")
        end = offset + length
        if end > most:
            raise InvalidArgument(f"range {offset}+{length} ends beyond {dims}")


def check_segments(bank: Bank, segments: tuple[Segment, ...]) -> None:
    if len(segments) > MAX_SEGMENTS:
        raise InvalidArgument(f"more than {MAX_SEGMENTS} segments")
    if any(not math.isfinite(s.weight) for s in segments):
        raise InvalidArgument("weights must be finite")
    _ranges([(s.offset, s.length) for s in segments], bank.dims, bank.quantization)


def check_spec(bank: Bank, spec: QuerySpec) -> None:
    if spec.k < 0:
        raise InvalidArgument("k is negative")
    check_segments(bank, spec.segments)
    if spec.exact_int and not bank.is_int8:
        raise UnsupportedMode("the integer mode needs an int8 bank")


def validate_queries(bank: Bank, queries: DataFrame, segments: tuple[Segment, ...] = ()) -> None:
    """One pass over (query_id, q): sizes, finite lanes, and a direction if the bank is a cosine bank."""
    zero = F.lit(False)
    if bank.metric is Metric.COSINE:
        zero = norm_squared(F.col("q")) == 0
        for s in segments:
            if s.weight != 0:
                zero |= norm_squared(part(F.col("q"), s.offset, s.length)) == 0
    size = F.col("q").isNull() | (F.size("q") != bank.dims)
    odd = F.coalesce(not_finite(F.col("q")), F.lit(False))
    found = queries.agg(*[F.max(c.cast("int")).alias(n) for c, n in ((size, "size"), (odd, "odd"), (~odd & zero, "zero"))]).first()
    if found["size"]:
        raise DimensionMismatch(f"a query has not {bank.dims} lanes")
    if found["odd"]:
        raise NonFiniteQuery("a query is not finite")
    if found["zero"]:
        raise ZeroNormQuery("a query has no direction")


def validate_payloads(bank: Bank, payloads: DataFrame) -> None:
    """One pass over (query_id, q8, q_scale, q_sq): sizes, lanes, a finite scale that is not negative, and a sum of squares
    that is the lanes' own."""
    if not bank.is_int8:
        raise UnsupportedMode("payloads need an int8 bank")
    lanes, scale = F.col("q8"), F.col("q_scale")
    size = lanes.isNull() | (F.size(lanes) != bank.dims)
    odd = scale.isNull() | F.isnan(scale) | (scale < 0) | (scale == float("inf")) | F.exists(lanes, lambda x: x.isNull())
    odd |= F.col("q_sq").isNull() | (F.col("q_sq") != dot_int(lanes, lanes))
    zero = (F.col("q_sq") == 0) & F.lit(bank.metric is Metric.COSINE)
    found = payloads.agg(*[F.max(F.coalesce(c, F.lit(True)).cast("int")).alias(n) for c, n in ((size, "size"), (~size & odd, "odd"), (zero, "zero"))]).first()
    if found["size"]:
        raise DimensionMismatch(f"a payload has not {bank.dims} lanes")
    if found["odd"]:
        raise InvalidArgument("a payload's scale or sum of squares is not its own")
    if found["zero"]:
        raise ZeroNormQuery("a payload has no direction")


#: The group of rows without one.
NO_GROUP = -(1 << 63)


def validate_group_bias(bias: DataFrame) -> None:
    """Pairs of a query and a group must be unique and finite; no row need be of the group."""
    odd = F.col("bias").isNull() | F.isnan("bias") | (F.abs("bias") == float("inf"))
    none = F.col("query_id").isNull() | F.col("group").isNull() | (F.col("group") == NO_GROUP)
    found = bias.groupBy("query_id", "group").agg(F.count("*").alias("n"), F.max(odd.cast("int")).alias("odd"), F.max(none.cast("int")).alias("none")).agg(*[F.max(c).alias(c) for c in ("n", "odd", "none")]).first()
    if found["odd"]:
        raise NonFiniteQuery("a bias is not finite")
    if found["none"] or (found["n"] or 0) > 1:
        raise InvalidArgument("bias pairs must be unique queries and groups")


def validate_bias(bank: Bank, bias: DataFrame) -> None:
    """Pairs must be unique, in the bank and finite."""
    keys = [c for c in ("query_id", "row_id") if c in bias.columns]
    found = bias.join(bank.df.select("row_id", F.lit(1).alias("_in")), "row_id", "left").groupBy(*keys).agg(F.count("*").alias("n"), F.max((F.col("bias").isNull() | F.isnan("bias") | (F.abs("bias") == float("inf"))).cast("int")).alias("odd"), F.max("_in").alias("_in")).agg(F.max("n").alias("n"), F.max("odd").alias("odd"), F.count(F.when(F.col("_in").isNull(), 1)).alias("out")).first()
    if found["odd"]:
        raise NonFiniteQuery("a bias is not finite")
    if found["out"] or (found["n"] or 0) > 1:
        raise InvalidArgument("bias pairs must be unique rows of the bank")
