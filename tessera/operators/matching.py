"""Mutual nearest matches of a sample of one bank in another, with CSLS margins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bake import rows_as_queries
from ..model import Bank, Metric, QuerySpec
from ..storage import materialize
from .query import query_batch


def _similarity(metric: Metric) -> Column:
    score = F.col("score").cast("double")
    return -score if metric is Metric.L2 else score


def _mean(order: str, value: str) -> Column:
    """The mean of the k values of a query, added up in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return F.aggregate(listed, F.lit(0.0), lambda acc, e: acc + e["v"]) / F.count("*")


def _written(bank: Bank) -> Bank:
    lanes = ("q8", "scale") if bank.is_int8 else ("vec",)
    return replace(bank, df=materialize(bank.df.select("row_id", *lanes), "bank"))


def mutual_matches(a: Bank, b: Bank, sample: DataFrame, k: int) -> DataFrame:
    """For each sampled row of a (row_id) the row of b that is its nearest, if it is that row's nearest in all of a too:
    source_a, source_b (-1: none), csls (0.0: none).

    csls = 2 * sim - mean similarity of each side's k nearest. Only the candidates that some sample row chose are searched
    back, each once. The banks and both searches are written: several plans read them, and each would bake and search anew."""
    spec = QuerySpec(k=k, exact_int=a.is_int8 and b.is_int8)
    metric = a.metric
    a, b = _written(a), _written(b)
    chosen = sample.select("row_id").distinct()
    forward = query_batch(b, rows_as_queries(a).join(chosen.withColumnRenamed("row_id", "query_id"), "query_id", "left_semi"), spec, validate=False)
    forward = materialize(forward, "forward").withColumn("sim", _similarity(metric))
    best = forward.where("rank = 1").select(F.col("query_id").alias("source_a"), F.col("row_id").alias("source_b"), "sim")
    mean_a = forward.groupBy(F.col("query_id").alias("source_a")).agg(_mean("rank", "sim").alias("mean_a"))
    back_ids = best.select(F.col("source_b").alias("query_id")).distinct()
    back = query_batch(a, rows_as_queries(b).join(back_ids, "query_id", "left_semi"), spec, validate=False)
    back = materialize(back, "back").withColumn("sim", _similarity(metric))
    chosen_back = back.where("rank = 1").select(F.col("query_id").alias("source_b"), F.col("row_id").alias("_back"))
    mean_b = back.groupBy(F.col("query_id").alias("source_b")).agg(_mean("rank", "sim").alias("mean_b"))
    joined = best.join(mean_a, "source_a").join(chosen_back, "source_b").join(mean_b, "source_b")
    kept = joined.where("_back = source_a").select("source_a", "source_b", (2.0 * F.col("sim") - F.col("mean_a") - F.col("mean_b")).cast("float").alias("csls"))
    out = chosen.withColumnRenamed("row_id", "source_a").join(kept, "source_a", "left")
    return out.select("source_a", F.coalesce("source_b", F.lit(-1).cast("bigint")).alias("source_b"), F.coalesce("csls", F.lit(0.0).cast("float")).alias("csls"))
