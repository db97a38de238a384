"""Dense row ids without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize


def ranged(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of ``order``, with the number of its range in ``_part``; written, for two plans that deal by
    ranges draw their bounds apart, and ``_part`` would mean something else in each."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(ranges, order).withColumn("_part", F.spark_partition_id()), "ranged")


def before(parts: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """``parts`` (from ``ranged``) with the sum of ``value`` over all rows that come before in ``order``. Only one sum a range
    meets in one task."""
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_part", first.alias("_start"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_own")).cast("bigint")).drop("_part", "_own", "_start")


def dense_ids(df: DataFrame, order: str, name: str = "row_id", start: int = 0) -> DataFrame:
    """``df`` with ``name`` counting up from ``start`` in the order of the unique column ``order``."""
    return before(ranged(df, order), order, F.lit(1), name).withColumn(name, F.col(name) + start)
