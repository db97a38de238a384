"""Set analytics in the integer mode: centroid distance, nearest-neighbour divergence, spread, projection.

Sets are (set_id, row_id) tables. Results per set or pair of sets. Means add up in double, partly before the shuffle, and
are floored to float once; the order of additions lies far below that rounding.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bake import payload_part, rows_as_payloads
from ..functions.vectors import dot, dot_int, floor_to_float, xd_pair
from ..model import Bank, Metric, QuerySpec
from ..plans import block
from .compose import pooled
from .query import RowScorer, floored, query_batch, resolve, whole_products


def _payload(df: DataFrame, name: str, key: str) -> DataFrame:
    return df.select(F.col("query_id").alias(key), F.col("q8").alias(f"{name}_q8"), F.col("q_scale").alias(f"{name}_s"), F.col("q_sq").alias(f"{name}_sq"))


def pair_scores(metric: Metric, a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distance (dot: similarity) of payloads a and b for ``pairs`` (a, b): a, b, distance (float)."""
    both = pairs.join(_payload(a, "a", "a"), "a").join(_payload(b, "b", "b"), "b")
    cross = dot_int(F.col("a_q8"), F.col("b_q8"))
    value = xd_pair(metric, cross, F.col("a_sq"), F.col("b_sq"), F.col("a_s"), F.col("b_s"), zero=0.0)
    return both.select("a", "b", floor_to_float(value).alias("distance"))


def centroid_distance(bank: Bank, sets: DataFrame, pairs: DataFrame, channel: int | None = None) -> DataFrame:
    """Distance of the pooled centroids of each pair of sets: a, b, distance. On a channel, a set without energy pools to
    zeros, and a cosine distance with such a side is 0."""
    rows = sets.select(F.col("set_id").alias("query_id"), "row_id")
    if channel is None:
        pool = pooled(bank, rows)
    else:
        c = bank.channel(channel)
        pool = pooled(bank, rows, c.offset, min(c.length, bank.dims - c.offset), zero_as_zeros=True)
    return pair_scores(bank.metric, pool, pool, pairs)


def nearest(bank: Bank, sets: DataFrame, channel: int | None = None) -> DataFrame:
    """For each row of a set and each set b, the distance to the nearest row of b: query_id, b, distance (float).

    A whole-row cosine distance is 1 - the query score; on a channel it is the normalised form. For dot, the best
    similarity stands in place of a distance. Blocks of rows meet blocks of rows, and each pair of blocks yields one row
    for a query and set, never a row for a pair."""
    if channel is None:
        rows, payloads, kind = bank.df.select("row_id", "q8", "scale"), rows_as_payloads(bank), None
    else:
        payloads, kind = channel_payloads(bank, channel), channel
        rows = payloads.select(F.col("query_id").alias("row_id"), "q8", F.col("q_scale").alias("scale"), F.col("q_sq").alias("sq"))
    members = sets.select("set_id", "row_id")
    targets = rows.join(members, "row_id")
    sources = payloads.join(members.select(F.col("row_id").alias("query_id")).distinct(), "query_id", "left_semi").select("query_id", F.col("q8").alias("_q8"), "q_scale", "q_sq")
    scorer = RowScorer(bank, resolve(bank, QuerySpec(exact_int=True))) if kind is None else _ChannelScorer(bank.metric)
    best = block.group_best(targets, sources, scorer, "set_id", 8 * bank.dims)
    value = F.col("score").cast("float")
    if kind is None and bank.metric is Metric.COSINE:
        value = (F.lit(1.0) - value.cast("double")).cast("float")
    return best.select("query_id", F.col("group_id").alias("b"), value.alias("distance"))


class _ChannelScorer:
    """Distances (dot: similarities) of payloads to payloads, floored to float."""

    def __init__(self, metric: Metric):
        self.metric, self.sign = metric, -1.0 if metric is Metric.DOT else 1.0

    def all(self, q: dict, b: dict) -> np.ndarray:
        cross, qs, rs = whole_products(q["_q8"], b["q8"]), q["q_scale"][:, None], b["scale"].astype(np.float64)
        q_sq, r_sq = q["q_sq"].astype(np.float64)[:, None], b["sq"].astype(np.float64)
        if self.metric is Metric.DOT:
            out = cross * (qs * rs)
        elif self.metric is Metric.L2:
            out = ((rs * rs) * r_sq + (qs * qs) * q_sq) - ((qs * rs) * cross) * 2.0
        else:
            energy = q_sq * r_sq
            out = np.where(energy > 0, 1.0 - cross / np.sqrt(np.where(energy > 0, energy, 1.0)), 0.0)
        return floored(out)


def channel_payloads(bank: Bank, channel: int) -> DataFrame:
    c = bank.channel(channel)
    return payload_part(rows_as_payloads(bank), c.offset, min(c.length, bank.dims - c.offset))


def nearest_divergence(bank: Bank, sets: DataFrame, pairs: DataFrame, reduce: str = "mean", channel: int | None = None) -> DataFrame:
    """Mean or greatest nearest distance from the rows of a to b: a, b, value (for dot: of the best similarities)."""
    found = nearest(bank, sets, channel).join(sets.select(F.col("set_id").alias("a"), F.col("row_id").alias("query_id")), "query_id").join(pairs, ["a", "b"])
    value = F.avg(F.col("distance").cast("double")) if reduce == "mean" else F.max("distance").cast("double")
    return found.groupBy("a", "b").agg(floor_to_float(value).alias("value"))


def nearest_one(bank: Bank, target: DataFrame, source: DataFrame) -> DataFrame:
    """For one target set (row_id) and one source set (query_id, q), by a block scan: query_id, row_id, score."""
    rows = Bank(bank.df.join(target, "row_id", "left_semi"), bank.dims, bank.metric, bank.quantization, bank.channels)
    return query_batch(rows, source, QuerySpec(k=1, exact_int=True)).drop("rank")


def spread(bank: Bank, sets: DataFrame, reduce: str = "mean", channel: int | None = None) -> DataFrame:
    """Mean or greatest distance of a set's rows to its own pooled centroid: set_id, value."""
    rows = sets.select(F.col("set_id").alias("query_id"), "row_id")
    if channel is None:
        pool, payloads = pooled(bank, rows), rows_as_payloads(bank)
    else:
        c = bank.channel(channel)
        pool = pooled(bank, rows, c.offset, min(c.length, bank.dims - c.offset), zero_as_zeros=True)
        payloads = channel_payloads(bank, channel)
    both = sets.select("set_id", "row_id").join(_payload(pool, "a", "set_id"), "set_id").join(_payload(payloads, "b", "row_id"), "row_id")
    value = xd_pair(bank.metric, dot_int(F.col("a_q8"), F.col("b_q8")), F.col("a_sq"), F.col("b_sq"), F.col("a_s"), F.col("b_s"), zero=0.0)
    each = both.select("set_id", "row_id", floor_to_float(value).alias("distance"))
    total = F.avg(F.col("distance").cast("double")) if reduce == "mean" else F.max("distance").cast("double")
    return each.groupBy("set_id").agg(floor_to_float(total).alias("value"))


def projections(bank: Bank, direction: DataFrame) -> DataFrame:
    """The dot of each row with a direction (one row: q): row_id, projection (float)."""
    q = F.broadcast(direction.select("q").limit(1))
    rows = bank.df.crossJoin(q)
    value = F.col("scale").cast("double") * dot(F.col("q"), F.col("q8")) if bank.is_int8 else dot(F.col("q"), F.col("vec"))
    return rows.select("row_id", value.cast("float").alias("projection"))


def separation(projected: DataFrame, group: Column) -> DataFrame:
    """Cohen's d of the projections of rows in and out of ``group``: one row, n_in, n_out, mean_in, mean_out, separation.

    Population variances; 0 where the pooled deviation is 0."""
    x = F.col("projection").cast("double")
    inside = projected.withColumn("_in", group)
    a, b = F.when(F.col("_in"), x), F.when(~F.col("_in"), x)
    s = inside.agg(F.count(a).alias("n_in"), F.count(b).alias("n_out"), F.avg(a).alias("mean_in"), F.avg(b).alias("mean_out"), F.var_pop(a).alias("_va"), F.var_pop(b).alias("_vb"))
    pooled_sd = F.sqrt((F.col("_va") * F.col("n_in") + F.col("_vb") * F.col("n_out")) / (F.col("n_in") + F.col("n_out")))
    d = F.when(pooled_sd > 0, (F.col("mean_in") - F.col("mean_out")) / pooled_sd).otherwise(F.lit(0.0))
    return s.select("n_in", "n_out", "mean_in", "mean_out", d.alias("separation"))


def drift(bank: Bank, sets: DataFrame) -> DataFrame:
    """Centroid distance of each set to the one before it, by set_id: set_id, drift."""
    from pyspark.sql.window import Window

    ids = sets.select("set_id").distinct().withColumn("_before", F.lag("set_id").over(Window.orderBy("set_id"))).where("_before is not null")
    found = centroid_distance(bank, sets, ids.select(F.col("set_id").alias("a"), F.col("_before").alias("b")))
    return found.select(F.col("a").alias("set_id"), F.col("distance").alias("drift"))
