"""Text embeddings: a word and its lanes on each line, separated by blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bake import bake
from ..functions.ids import dense_ids
from ..model import Bank, Metric, Quantization, QuerySpec
from ..operators.query import query


def read_vectors(spark: SparkSession, path: str, dims: int, most: int | None = None) -> DataFrame:
    """(row_id, id, vec) of well-formed lines in the order of the files; lines of another length, with odd numbers, or
    with a quote or backslash in the word are left out. ``most`` keeps the first lines."""
    lines = spark.read.text(path).select("value")
    lines = lines.withColumn("_at", F.monotonically_increasing_id())
    cells = F.split(F.rtrim("value"), " ")
    vec = F.transform(F.slice(cells, 2, dims), lambda x: x.try_cast("float"))
    rows = lines.select("_at", cells.alias("_cells"), F.get(cells, F.lit(0)).alias("id"), vec.alias("vec"))
    good = (F.size("_cells") == dims + 1) & (F.length("id") > 0) & ~F.col("id").rlike(r'["\\]')
    good &= ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    numbered = dense_ids(rows.where(good).select("_at", "id", "vec"), "_at").drop("_at")
    return numbered if most is None else numbered.where(F.col("row_id") < most)


def word_bank(spark: SparkSession, path: str, dims: int, most: int | None = None) -> tuple[Bank, DataFrame]:
    """A cosine int8 bank of a text file, and its words (row_id, id)."""
    rows = read_vectors(spark, path, dims, most)
    return bake(rows.select("row_id", "vec"), dims, Metric.COSINE, Quantization.INT8), rows.select("row_id", "id")


def nearest_words(bank: Bank, words: DataFrame, word: str, k: int = 10) -> DataFrame:
    """The k nearest other words: rank, id, score."""
    from ..functions.bake import rows_as_queries

    me = words.where(F.col("id") == word).select("row_id")
    q = rows_as_queries(bank).join(F.broadcast(me.withColumnRenamed("row_id", "query_id")), "query_id", "left_semi").limit(1)
    hits = query(bank, q, QuerySpec(k=k, exclude_self=True))
    return hits.join(words, "row_id").select("rank", "id", "score")
