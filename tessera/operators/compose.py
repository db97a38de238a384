"""Queries built from rows: centroids, integer-pooled centroids and directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bake import half_even_quotient, inverse_norm, max_abs
from ..functions.vectors import dequantized, dot_int, let
from ..model import Bank, Metric


def _lanes(bank: Bank) -> Column:
    return dequantized(F.col("q8"), F.col("scale")) if bank.is_int8 else F.col("vec")


def centroid(bank: Bank, rows: DataFrame) -> DataFrame:
    """The mean vector of each group of ``rows`` (query_id, row_id): query_id, q. Rows named twice count twice.

    Lanes are summed in double, partly before the shuffle, so a group of any size costs dims rows a task; a cosine
    bank's mean is brought to unit length (null if it has none)."""
    pairs = rows.join(bank.df.select("row_id", _lanes(bank).cast("array<double>").alias("v")), "row_id")
    lane = pairs.select("query_id", F.posexplode("v").alias("pos", "x"))
    mean = lane.groupBy("query_id", "pos").agg((F.sum("x") * (F.lit(1.0) / F.count("*"))).cast("float").alias("x"))
    return _unit(_gathered(mean), bank.metric)


def _gathered(lanes: DataFrame, name: str = "q") -> DataFrame:
    """(query_id, pos, x) as (query_id, array by pos): one list of dims lanes each."""
    return lanes.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias(name))


def _unit(queries: DataFrame, metric: Metric) -> DataFrame:
    if metric is not Metric.COSINE:
        return queries
    q = let(F.col("q"), lambda v: let(inverse_norm(v), lambda inv: F.when(inv > 0, F.transform(v, lambda x: x * inv))))
    return queries.select("query_id", q.alias("q"))


def direction(a: DataFrame, b: DataFrame) -> DataFrame:
    """The unit vector from b to a, for (query_id, q) of both: query_id, q; null where they are equal."""
    both = a.join(b.select("query_id", F.col("q").alias("_b")), "query_id")
    diff = both.select("query_id", F.zip_with("q", "_b", lambda x, y: x - y).alias("q"))
    return _unit(diff, Metric.COSINE)


def pooled(bank: Bank, rows: DataFrame, offset: int = 0, length: int | None = None, zero_as_zeros: bool = False) -> DataFrame:
    """Weighted pooling of int8 rows in integers: payloads (query_id, q8, q_scale, q_sq) of ``rows`` (query_id, row_id[,
    weight bigint]).

    A row counts weight * rint(scale / largest scale * 2**24); lane sums are exact bigints, so the result does not depend
    on order or partitioning. Groups that pool to nothing give no row, or zeros with ``zero_as_zeros``."""
    length = bank.dims - offset if length is None else length
    weight = F.col("weight").cast("bigint") if "weight" in rows.columns else F.lit(1).cast("bigint")
    pairs = rows.select("query_id", "row_id", weight.alias("_w")).where("_w <> 0").join(bank.df.select("row_id", F.slice("q8", offset + 1, length).alias("_lanes"), F.col("scale").cast("double").alias("_s")), "row_id")
    top = pairs.groupBy("query_id").agg(F.max("_s").alias("_top"), F.sum("_w").alias("_weights"))
    scaled = pairs.join(top, "query_id").withColumn("_m", F.col("_w") * F.when(F.col("_top") > 0, F.rint(F.col("_s") / F.col("_top") * F.lit(float(1 << 24)))).otherwise(0.0).cast("bigint"))
    lanes = scaled.select("query_id", "_m", F.posexplode("_lanes").alias("pos", "_x")).groupBy("query_id", "pos").agg(F.sum(F.col("_x").cast("bigint") * F.col("_m")).alias("x"))
    whole = _gathered(lanes, "_acc").join(top, "query_id").withColumn("_most", F.coalesce(max_abs(F.col("_acc")).cast("bigint"), F.lit(0).cast("bigint")))
    den = F.greatest(F.col("_most"), F.lit(1).cast("bigint"))
    q8 = let(den, lambda most: F.transform("_acc", lambda x: half_even_quotient(x * F.lit(127).cast("bigint"), most).cast("tinyint")))
    scale = (F.col("_most").cast("double") / (F.col("_weights").cast("double") * 127.0)) * F.col("_top") * F.lit(2.0**-24)
    out = whole.select("query_id", q8.alias("q8"), scale.alias("q_scale"), F.col("_most"))
    if not zero_as_zeros:
        out = out.where("_most > 0")
    return out.select("query_id", "q8", "q_scale", dot_int(F.col("q8"), F.col("q8")).alias("q_sq"))


