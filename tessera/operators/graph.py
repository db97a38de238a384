"""The mutual k-nearest-neighbour graph, duplicate groups and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bake import rows_as_queries
from ..model import Bank, QuerySpec
from ..storage import shared_dir
from .query import query_batch


def knn_graph(bank: Bank, k: int, exact_int: bool | None = None) -> DataFrame:
    """Each row's k best others: row_id, slot (from 0), neighbor, score. A bank of fewer rows gives fewer slots."""
    spec = QuerySpec(k=k, exclude_self=True, exact_int=bank.is_int8 if exact_int is None else exact_int)
    hits = query_batch(bank, rows_as_queries(bank), spec, validate=False)
    return hits.select(F.col("query_id").alias("row_id"), (F.col("rank") - 1).alias("slot"), F.col("row_id").alias("neighbor"), "score")


def padded(graph: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The graph with every slot of every row; -1 where there is no neighbour."""
    slots = rows.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    return slots.join(graph.select("row_id", "slot", "neighbor"), ["row_id", "slot"], "left").select("row_id", "slot", F.coalesce("neighbor", F.lit(-1).cast("bigint")).alias("neighbor"))


def mutual(graph: DataFrame) -> DataFrame:
    """Edges that both ends have: row_id, slot, neighbor."""
    back = graph.select(F.col("row_id").alias("neighbor"), F.col("neighbor").alias("row_id"))
    return graph.select("row_id", "slot", "neighbor").join(back, ["row_id", "neighbor"], "left_semi")


def duplicate_groups(bank: Bank) -> DataFrame:
    """Rows of identical content: row_id, group_of, the least row of the group. 0.0 and -0.0 differ, as bytes do."""
    lanes = F.concat_ws(",", F.col("q8").cast("array<string>"), F.col("scale").cast("string")) if bank.is_int8 else F.concat_ws(",", F.col("vec").cast("array<string>"))
    keyed = bank.df.select("row_id", F.sha2(lanes, 256).alias("_key"))
    least = keyed.groupBy("_key").agg(F.min("row_id").alias("group_of"))
    return keyed.join(least, "_key").select("row_id", "group_of")


def _checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def components(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components of ``rows`` (row_id) under ``edges`` (row_id, neighbor): row_id, component_id (least member).

    Large and small stars in turn: each round is two grouped minima and two joins, and a graph of n nodes takes
    O(log n) rounds."""
    now = _checkpoint(edges.where("row_id <> neighbor").select(F.greatest("row_id", "neighbor").alias("u"), F.least("row_id", "neighbor").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        now = _checkpoint(large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    return rows.select("row_id").join(now.select(F.col("u").alias("row_id"), F.col("v").alias("_c")), "row_id", "left").select("row_id", F.coalesce("_c", "row_id").alias("component_id"))


def bank_components(bank: Bank, k: int) -> DataFrame:
    """Components of the bank under mutual edges and identical rows."""
    same = duplicate_groups(bank).select("row_id", F.col("group_of").alias("neighbor"))
    edges = mutual(knn_graph(bank, k)).select("row_id", "neighbor").unionByName(same)
    return components(bank.df, edges)
