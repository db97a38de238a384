"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts) into shards of near equal bytes.

Groups of ``1 / FINE`` of a shard or more are packed one by one; there are ``shards * FINE`` of them at most. All smaller
groups fall by hash of their text into ``BUNDLES`` bundles a shard, which are packed as wholes. So what the driver packs
is bounded by the number of shards, not by the data. A group larger than a shard's share has a shard to itself.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

FINE, BUNDLES = 256, 256
#: Rows of a shard that one task numbers.
ROWS_PER_BUCKET = 50_000


class _Remaining:
    """Remaining capacities in order; a sorted list does what a balanced tree does, for a bounded number of bins."""

    def __init__(self, capacities: list[int]):
        self.order = sorted((c, i) for i, c in enumerate(capacities))

    def take(self, size: int) -> int:
        """The bin of the tightest remaining capacity that holds ``size``; else the one with the most room."""
        at = bisect.bisect_left(self.order, (size, -1))
        room, i = self.order.pop(at if at < len(self.order) else -1)
        bisect.insort(self.order, (room - size, i))
        return i


def pack(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Best-fit-decreasing of (size, name) into ``shards`` bins of the least capacity that holds them all."""
    items = sorted(items, key=lambda x: (-x[0], x[1]))
    total = sum(s for s, _ in items)
    capacities, left = [], shards
    for s, _ in items:  # an item above the share of what is left gets a bin of its own
        if left > 1 and s * left > total:
            capacities.append(s)
            total, left = total - s, left - 1
        else:
            break

    def fit(share: int) -> tuple[dict[str, int], bool]:
        bins = _Remaining(capacities + [share] * left)
        where, whole = {}, True
        for s, name in items:
            whole &= bins.order[-1][0] >= s
            where[name] = bins.take(s)
        return where, whole

    low, high = -(-total // left), 2 * (-(-total // left)) + (items[0][0] if items else 0)
    while low < high:  # fewest bytes a shard such that nothing spills
        middle = (low + high) // 2
        low, high = (low, middle) if fit(middle)[1] else (middle + 1, high)
    return fit(low)[0]


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row: id_col, size, text_crc32, law, shard, slot, grown_shard.

    Rows of equal text share a shard; a null text is placed as an empty one. ``slot`` counts a shard's rows from 0 by
    bucket, id and text hash. Repeated rows each have a slot, and so have rows without an id; an empty table gives no rows;
    texts of any length are one row each; other columns are ignored. Each text is hashed once, into a narrow table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("_group"))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    rows = rows.withColumn("_bundle", F.pmod(F.xxhash64("_group"), F.lit(shards * BUNDLES)).cast("int"))
    groups = rows.groupBy("_group", "_bundle").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    least = max(1, -(-total["b"] // (shards * FINE)))  # shards * FINE groups reach it at most
    large = groups.where(F.col("bytes") >= least).select(F.hex("_group").alias("name"), "bytes").collect()
    named = {r["name"] for r in large}
    small = groups.where(F.col("bytes") < least).groupBy("_bundle").agg(F.sum("bytes").alias("bytes")).collect()
    where = pack([(r["bytes"], r["name"]) for r in large] + [(r["bytes"], f"#{r['_bundle']}") for r in small], shards)

    spark = docs.sparkSession
    of_large = spark.createDataFrame([(bytearray.fromhex(k), v) for k, v in where.items() if k in named], "_group binary, _large int")
    of_bundle = spark.createDataFrame([(int(k[1:]), v) for k, v in where.items() if k not in named], "_bundle int, _small int")
    placed = rows.join(F.broadcast(of_large), "_group", "left").join(F.broadcast(of_bundle), "_bundle", "left")
    placed = placed.withColumn("shard", F.coalesce("_large", "_small"))
    return _slots(placed, total["n"]).select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _slots(placed: DataFrame, n: int) -> DataFrame:
    """Number the rows of each shard from 0: within hash buckets of bounded size, then by the buckets' running totals. Rows of
    one id, or of none, and even rows that are all alike, are spread over the buckets."""
    buckets = max(8, -(-n // ROWS_PER_BUCKET))
    at: Column = F.pmod(F.xxhash64("_id", "_group", F.col("_row") % buckets), F.lit(buckets)).cast("int")
    placed = placed.withColumn("_bucket", at)
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "_bucket", before.alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(F.col("_id").asc_nulls_first(), "_group", "_row")
    numbered = placed.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "_bucket"]).withColumn("slot", (F.col("_start") + F.col("_at")).cast("long"))
