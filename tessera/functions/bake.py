"""Baking: from source rows to a bank, and from vectors to integer query payloads."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Bank, Channel, Metric, Quantization
from .vectors import _fold, as_double, dequantized, dot_int, let, part


def max_abs(v: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x))), F.lit(0.0))


def norm_squared(v: Column) -> Column:
    return _fold(F.transform(as_double(v), lambda x: x * x))


def inverse_norm(v: Column) -> Column:
    """float32 of 1 / |v|, 0 for a vector without energy."""
    return let(norm_squared(v), lambda n: F.when(n > 0, F.lit(1.0) / F.sqrt(n)).otherwise(F.lit(0.0))).cast("float")


def with_columns(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def unit(v: Column) -> Column:
    """The vector at unit length, one float32 product a lane; zeros stay."""
    return let(v, lambda w: let(inverse_norm(w), lambda inv: F.transform(w, lambda x: x * inv)))


def normalized(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn(vec, unit(F.col(vec)))


def _rounded(v: Column, inv: Column) -> Column:
    """v * inv in the type of both, to whole numbers; 0 * infinity (of a vector of subnormal lanes) is 0."""
    zero = F.lit(0.0)
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(F.nanvl(x * inv, zero)))).cast("tinyint"))


def quantized(df: DataFrame, vec: str = "vec") -> DataFrame:
    """q8 and scale instead of ``vec``: half-even rounding of v * (127 / max), in float32. Spark divides floats as doubles, so
    the quotient is cast before it multiplies a lane; a product near a half would round otherwise."""
    one, zero = F.lit(127.0).cast("float"), F.lit(0.0).cast("float")

    def lanes(v: Column, top: Column) -> Column:
        return let(F.when(top > 0, (one / top).cast("float")).otherwise(zero), lambda inv: F.struct(_rounded(v, inv).alias("q8"), (top / one).cast("float").alias("scale")))

    both = let(F.col(vec), lambda v: let(max_abs(v).cast("float"), lambda top: lanes(v, top)))
    return df.withColumn("_both", both).withColumns({"q8": F.col("_both.q8"), "scale": F.col("_both.scale")}).drop(vec, "_both")


def channel_inverse_norms(q8: Column, scale: Column, channels: tuple[Channel, ...]) -> Column:
    return let(dequantized(q8, scale), lambda lanes: F.array(*[inverse_norm(part(lanes, c.offset, c.length)) for c in channels]))


def bake(rows: DataFrame, dims: int, metric: Metric, quantization: Quantization = Quantization.FLOAT32, channels: tuple[Channel, ...] = (), normalize: bool = True, validate: bool = False) -> Bank:
    """A bank of ``rows`` (row_id, vec). A cosine bank is normalised here; the lanes stay whatever their layout."""
    from .validate import check_channels, validate_source_rows

    check_channels(channels, dims, quantization)
    if validate:
        validate_source_rows(rows, dims, metric)
    df = rows.withColumn("vec", F.col("vec").cast("array<float>"))
    if metric is Metric.COSINE and normalize:
        df = normalized(df)
    if quantization is Quantization.INT8:
        df = quantized(df)
    bank = Bank(df, dims, metric, quantization, tuple(channels))
    return with_channels(bank, tuple(channels)) if channels else bank


def with_channels(bank: Bank, channels: tuple[Channel, ...]) -> Bank:
    """The bank under another channel table; stored rows stay, sub-norms are derived anew."""
    df = bank.df.drop("inv_norms")
    if channels and bank.metric is Metric.COSINE:
        lanes = channel_inverse_norms(F.col("q8"), F.col("scale"), channels) if bank.is_int8 else F.array(*[inverse_norm(part(F.col("vec"), c.offset, c.length)) for c in channels])
        df = df.withColumn("inv_norms", lanes)
    return replace(bank, df=df, channels=tuple(channels))


def rows_as_queries(bank: Bank, where: Column | str | None = None) -> DataFrame:
    """(query_id, q) of a bank's rows; int8 rows as the float32 lanes they stand for."""
    df = bank.df if where is None else bank.df.where(where)
    lanes = dequantized(F.col("q8"), F.col("scale")) if bank.is_int8 else F.col("vec")
    return df.select(F.col("row_id").alias("query_id"), lanes.alias("q"))


def quantized_queries(queries: DataFrame) -> DataFrame:
    """Integer payloads (query_id, q8, q_scale, q_sq) of (query_id, q): everything in double."""
    one = F.lit(127.0)

    def lanes(v: Column, top: Column) -> Column:
        return let(F.when(top > 0, one / top).otherwise(F.lit(0.0)), lambda inv: F.struct(_rounded(v, inv).alias("q8"), (top / one).alias("q_scale")))

    both = let(as_double(F.col("q")), lambda v: let(max_abs(v), lambda top: lanes(v, top)))
    df = queries.select("query_id", both.alias("_both")).select("query_id", "_both.q8", "_both.q_scale")
    return df.select("query_id", "q8", "q_scale", let(F.col("q8"), lambda v: dot_int(v, v)).alias("q_sq"))


def payload_part(payloads: DataFrame, offset: int, length: int) -> DataFrame:
    """Payloads on a range of lanes: the scale stays that of the whole, the sum of squares is the range's own."""
    lanes = part(F.col("q8"), offset, length)
    return payloads.select("query_id", lanes.alias("q8"), "q_scale", let(lanes, lambda v: dot_int(v, v)).alias("q_sq"))


def rows_as_payloads(bank: Bank) -> DataFrame:
    """Integer payloads of an int8 bank's rows: as they are stored, never quantised anew."""
    return bank.df.select(F.col("row_id").alias("query_id"), "q8", F.col("scale").cast("double").alias("q_scale"), dot_int(F.col("q8"), F.col("q8")).alias("q_sq"))


def half_even_quotient(num: Column, den: Column) -> Column:
    """num / den of bigints, rounded half to even, without leaving integers."""
    n = F.abs(num)
    q = F.call_function("div", n, den)
    twice = (n - q * den) * 2
    up = (twice > den) | ((twice == den) & (q % 2 == 1))
    out = q + F.when(up, F.lit(1)).otherwise(F.lit(0))
    return F.when(num < 0, -out).otherwise(out)
