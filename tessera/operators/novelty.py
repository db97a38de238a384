"""Novelty: distances to the k-th neighbour, a bank's own baseline of them, and ranks within it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bake import payload_part, quantized_queries, rows_as_payloads
from ..functions.ids import before, ranged
from ..functions.vectors import dot_int, floor_to_float, rank_distance, xd_pair
from ..model import Bank, InvalidArgument, Metric, QuerySpec, UnsupportedMode, ZeroNormQuery
from .analytics import _payload
from .graph import knn_graph
from .query import query_batch


def _distance(metric: Metric, score: Column) -> Column:
    if metric is Metric.DOT:
        raise UnsupportedMode("dot scores have no distance")
    return rank_distance(metric, score.cast("float")).cast("float")


def kth_distance(bank: Bank, queries: DataFrame, k: int, spec: QuerySpec | None = None) -> DataFrame:
    """Distance of each query to its k-th nearest row: query_id, distance (float). Queries of fewer rows have none."""
    hits = query_batch(bank, queries, replace(spec or QuerySpec(exact_int=bank.is_int8), k=k))
    return hits.where(F.col("rank") == k).select("query_id", _distance(bank.metric, F.col("score")).alias("distance"))


def baseline(bank: Bank, k: int, limit: int | None = None) -> DataFrame:
    """Every row's distance to its k-th nearest other row: row_id, distance (float). A bank of more than ``limit`` rows, or of
    too few to have k others, is refused: a baseline of a sample is one of a bank of that sample."""
    if bank.metric is Metric.DOT:
        raise UnsupportedMode("dot scores have no distance")
    rows = bank.df.count()
    if k < 1 or k >= rows or limit is not None and rows > limit:
        raise InvalidArgument(f"no baseline of {rows} rows for k {k} and a limit of {limit}")
    return knn_graph(bank, k).where(F.col("slot") == k - 1).select("row_id", _distance(bank.metric, F.col("score")).alias("distance"))


def ascending(distances: DataFrame) -> DataFrame:
    """The baseline as a sorted list: pos (from 0), distance. Positions by ranges, not in one task."""
    return before(ranged(distances.select("distance"), "distance"), "distance", F.lit(1), "pos").select("pos", "distance")


def score(base: DataFrame, probes: DataFrame) -> DataFrame:
    """The share of baseline distances strictly less than each probe's: query_id, novelty. ``probes``: query_id, distance.

    Baseline and probes are merged by distance and counted by a running sum, in ranges, so neither is broadcast."""
    both = base.select(F.lit(None).cast("bigint").alias("query_id"), "distance", F.lit(1).alias("_base")).unionByName(probes.select("query_id", "distance", F.lit(0).alias("_base")))
    levels = both.groupBy("distance").agg(F.sum("_base").alias("_n"))
    less = before(ranged(levels, "distance"), "distance", F.col("_n"), "_less").select("distance", "_less")
    total = base.agg(F.count("*").alias("_total"))
    return probes.join(less, "distance").crossJoin(F.broadcast(total)).select("query_id", F.when(F.col("_total") > 0, (F.col("_less") / F.col("_total")).cast("float")).otherwise(F.lit(0.0).cast("float")).alias("novelty"))


def probe_distance(bank: Bank, probes: DataFrame, pairs: DataFrame, channel: int | None = None, validate: bool = True) -> DataFrame:
    """Exact distance of probes (query_id, q) to rows, whole or on a channel, for ``pairs`` (query_id, row_id):
    query_id, row_id, distance (float). A probe is quantised whole, and a channel takes its lanes of it and of the row.

    A cosine distance needs energy on both sides: ``validate`` raises where a pair has none, else such a distance is null."""
    if bank.metric is Metric.DOT:
        raise UnsupportedMode("dot scores have no distance")
    p, rows = quantized_queries(probes), rows_as_payloads(bank)
    if channel is not None:
        c = bank.channel(channel)
        p, rows = (payload_part(x, c.offset, min(c.length, bank.dims - c.offset)) for x in (p, rows))
    both = pairs.join(_payload(p, "a", "query_id"), "query_id").join(_payload(rows, "b", "row_id"), "row_id")
    if validate and bank.metric is Metric.COSINE and not both.where("a_sq = 0 or b_sq = 0").isEmpty():
        raise ZeroNormQuery("a probe or a row has no direction there")
    value = xd_pair(bank.metric, dot_int(F.col("a_q8"), F.col("b_q8")), F.col("a_sq"), F.col("b_sq"), F.col("a_s"), F.col("b_s"))
    return both.select("query_id", "row_id", floor_to_float(value).alias("distance"))
