"""Min-max hashing, banding, exact verification and connected components.

Each permutation gives two values of a set, its minimum and its maximum, for one evaluation of the hash. Bands of
several values name buckets; sets that share one are candidates. Of each other pair's 1-bit values a sketch is kept,
which rejects candidates that lie far below the threshold (six standard deviations), before sets are compared in full.

A bucket's members are not paired with each other. Each is compared with the bucket's least member; in a second round a few
members of each component are compared with a few of the others; what links shares a component. What then still meets members of other components goes through an exact prefix filter. A set's
elements are put in order: those that no other component holds, which no link between components can share, then the
rest by how many sets hold them. The first element that two sets share bounds their overlap by what follows it in either,
so it must lie early in both; how early depends on the sizes, and classes of sizes are part of the join's key. Sets that
share a frequent passage alone, or differ in enough elements of their own, do not meet. No link between components is
lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import intermediates, kept, mapped, materialize, mix, release


def fingerprints(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set of distinct values; 0 of an empty one."""
    full = np.flatnonzero(np.diff(offsets))
    f1, f2 = np.zeros(len(offsets) - 1, np.uint64), np.zeros(len(offsets) - 1, np.uint64)
    if len(full):
        f1[full] = np.add.reduceat(mix(values), offsets[:-1][full])
        f2[full] = np.bitwise_xor.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), offsets[:-1][full])
    return f1, f2


@dataclass(frozen=True)
class Scheme:
    """``bands`` bands of ``rows`` values each; a pair of similarity s shares a bucket with 1 - (1 - s ** rows) ** bands."""

    rows: int
    bands: int
    sketch_words: int = 2

    @property
    def hashes(self) -> int:
        return (max(self.rows * self.bands, 64 * self.sketch_words) + 1) // 2

    def most_differing(self, similarity: float) -> int:
        bits, p = 64 * self.sketch_words, (1 - similarity) / 2
        return int(bits * p + 6 * sqrt(bits * p * (1 - p))) + 1

    @property
    def fields(self) -> str:
        return ", ".join(["n bigint", "f1 bigint", "f2 bigint", "keys array<bigint>", *(f"s{i} bigint" for i in range(self.sketch_words))])

    @property
    def names(self) -> list[str]:
        return ["n", "f1", "f2", "keys", *(f"s{i}" for i in range(self.sketch_words))]

    def arrays(self, values: np.ndarray, offsets: np.ndarray) -> list:
        """Arrow columns of ``fields`` for sets of distinct values one after another; an empty set has no keys."""
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        starts, n = offsets[:-1][full], len(size)
        f1, f2 = fingerprints(values, offsets)
        keys, sketch = np.zeros((len(full), self.bands), np.uint64), np.zeros((len(full), self.sketch_words), np.uint64)
        if len(full):
            for k in range(self.hashes):
                a, b = mix(np.array([2 * k + 1, 2 * k + 2], np.uint64))
                h = values * (a | np.uint64(1)) + b
                for side, v in enumerate((np.minimum.reduceat(h, starts), np.maximum.reduceat(h, starts))):
                    i = 2 * k + side
                    v = mix(v)
                    if i < self.rows * self.bands:
                        keys[:, i // self.rows] = mix(keys[:, i // self.rows] ^ v + np.uint64(i + 1))
                    if i < 64 * self.sketch_words:
                        sketch[:, i // 64] |= (v & np.uint64(1)) << np.uint64(i % 64)
        at = np.zeros(n + 1, np.int32)
        np.cumsum((size > 0) * self.bands, out=at[1:])
        spread = np.zeros((n, self.sketch_words), np.uint64)
        spread[full] = sketch
        return [pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1).view(np.int64))), *(pa.array(spread[:, i].copy().view(np.int64)) for i in range(self.sketch_words))]


#: Members of a bucket that those of other components are compared with in the second round.
PIVOTS = 16
#: Edges (16 bytes) that one task joins up.
TASK_EDGES = 1_000_000
#: Ids (8 bytes) that are broadcast, and rows of a few numbers; more are joined by shuffle.
BROADCAST_IDS, BROADCAST_ROWS = 1_000_000, 200_000
#: Sets of one class differ in size by this factor at most.
SIZE_CLASS = 1.05


def few(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``df`` (a written table), to be broadcast if it has ``most`` rows or fewer."""
    return F.broadcast(df) if df.count() <= most else df


def _postings(content: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """(id, token, at) of the elements that a link between components can be found by; ``at`` elements precede it."""
    tokens = content.join(rest.select("id", "comp"), "id").select("id", "comp", F.explode("set").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("_df"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
    shared = held.where("_lo < _hi").select("token", "_df")
    own = Window.partitionBy("id")
    listed = tokens.join(shared, "token").select("id", "token", F.row_number().over(own.orderBy("_df", "token")).alias("_k"), F.count("*").over(own).alias("_of"))
    placed = listed.join(rest, "id").withColumn("at", F.col("n") - F.col("_of") + F.col("_k") - 1)
    return placed.where(100 * (F.col("n") - F.col("at")) >= percent * F.col("n")).drop("_k", "_of")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / log(SIZE_CLASS)).cast("int")


def _meetings(posted: DataFrame, percent: int, side: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pairs of postings that may be the first element that a linked pair shares; x is the larger set."""
    n, after = F.col("n"), (100 + percent) * (F.col("n") - F.col("at"))
    smaller = posted.where(after >= 2 * percent * n).withColumn("class", _size_class(n))
    lo, hi = F.ceil(percent * n / 100), F.least(n, F.floor(after / percent) - n)
    larger = posted.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi and _hi > 0")
    larger = larger.withColumn("class", F.explode(F.sequence(_size_class(F.greatest(F.col("_lo"), F.lit(1))), _size_class(F.col("_hi"))))).drop("_lo", "_hi")
    both = side(smaller, "y").join(side(larger, "x"), (F.col("y_token") == F.col("x_token")) & (F.col("y_class") == F.col("x_class")))
    least = percent * (F.col("x_n") + F.col("y_n"))
    ordered = (F.col("y_n") < F.col("x_n")) | (F.col("y_n") == F.col("x_n")) & (F.col("y_id") < F.col("x_id"))
    return both.where(ordered & ((100 + percent) * (F.col("x_n") - F.col("x_at")) >= least) & ((100 + percent) * (F.col("y_n") - F.col("y_at")) >= least))


def link(items: DataFrame, sets: Callable[[DataFrame], DataFrame], scheme: Scheme, percent: int = 80) -> DataFrame:
    """Links (a, b) of distinct sets whose Jaccard similarity is ``percent`` / 100 or more: verified ones, and as many as
    make the components.

    ``items`` has id (bigint) and the scheme's fields, an id once; ``sets(ids)`` gives (id, set array<bigint>) of the ids.
    """
    with intermediates():
        return kept(materialize(_linked(items, sets, scheme, percent), "links"))


def _linked(items: DataFrame, sets: Callable[[DataFrame], DataFrame], scheme: Scheme, percent: int) -> DataFrame:
    sketch = [f"s{i}" for i in range(scheme.sketch_words)]
    rows = items.select(F.explode("keys").alias("key"), "id")
    buckets = materialize(rows.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "buckets")
    members = materialize(rows.join(few(buckets), "key").select("key", "id"), "members")
    release(buckets)
    ids = materialize(members.select("id").distinct(), "ids")
    traits = materialize(items.select("id", "n", *sketch).join(few(ids), "id", "left_semi").dropDuplicates(["id"]), "traits")
    content = materialize(sets(few(ids)), "sets")
    if not content.groupBy("id").count().where("count > 1").isEmpty():  # repeated rows; else no set moves
        content = materialize(content.dropDuplicates(["id"]), "sets")
    cand = materialize(members.join(few(traits, BROADCAST_ROWS), "id").select("key", "id", "n", *sketch), "candidates")
    release(members)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c if c == "key" else f"{name}_{c}") for c in df.columns])

    def close(pairs: DataFrame) -> DataFrame:
        """What size and sketch allow, each pair once."""
        few, many = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
        differ = sum((F.bit_count(F.col(f"x_{s}").bitwiseXOR(F.col(f"y_{s}"))) for s in sketch[1:]), F.bit_count(F.col(f"x_{sketch[0]}").bitwiseXOR(F.col(f"y_{sketch[0]}"))))
        pairs = pairs.where((100 * few >= percent * many) & (differ <= scheme.most_differing(percent / 100)))
        return pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link. A pivot of many pairs makes a large partition on its side, which Spark splits."""
        left, right = content.select(F.col("id").alias("a"), F.col("set").alias("_sa")), content.select(F.col("id").alias("b"), F.col("set").alias("_sb"))
        common = F.size(F.array_intersect("_sa", "_sb"))
        return pairs.join(right, "b").join(left, "a").where(100 * common >= percent * (F.size("_sa") + F.size("_sb") - common)).select("a", "b")

    least = cand.groupBy("key").agg(F.min("id").alias("x_id"))
    first = close(side(cand, "y").join(least.join(side(traits, "x"), "x_id"), "key").where("x_id <> y_id"))
    links = materialize(verified(first), "links")

    def still() -> DataFrame:
        """Members of the buckets that hold several components."""
        labels = components(links)
        now = materialize(cand.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "labelled")
        mixed = now.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("key")
        return now.join(mixed, "key", "left_semi")

    # a component of a bucket sends a member of each slot at most, and they meet the first of every slot
    member = F.struct("id", "comp", "n", *sketch)
    sent = still().groupBy("key", "comp", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("_slot")).agg(F.min(member).alias("_m"))
    sent = materialize(sent.select("key", "_slot", "_m"), "sent")
    if not sent.isEmpty():
        met = sent.groupBy("key", "_slot").agg(F.min("_m").alias("_m"))
        pairs = side(sent.select("key", "_m.*"), "y").join(side(met.select("key", "_m.*"), "x"), "key").where(F.col("x_comp") != F.col("y_comp"))
        links = links.unionByName(materialize(verified(close(pairs)), "links"))
        rest = materialize(still().drop("key").dropDuplicates(["id"]), "rest")
        if not rest.isEmpty():
            posted = materialize(_postings(content, rest, percent), "postings")
            pairs = _meetings(posted, percent, side).where(F.col("x_comp") != F.col("y_comp"))
            links = links.unionByName(verified(close(pairs)))
    return links


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) as (id, comp), comp the least id.

    Up to ``TASK_EDGES`` edges are joined up in one task; more by alternating large and small stars, where every step is a
    grouped minimum and a join, so that no node's neighbours meet in one task."""
    with intermediates():
        edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        if edges.count() <= TASK_EDGES:
            return kept(materialize(mapped(edges.coalesce(1), _joined_up, "id bigint, comp bigint"), "components"))
        stars = _stars(edges)
        return kept(materialize(stars.unionByName(stars.select(F.col("comp").alias("id"), "comp").distinct()), "components"))


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        lo, hi = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "comp"])


def _stars(now: DataFrame) -> DataFrame:
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        after = materialize(large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "small")
        release(now, low, large)
        now = after
        # stars: a node has one parent, and no parent has one
        twice = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        nested = now.select(F.col("v").alias("u")).distinct().join(now.select("u"), "u", "left_semi")
        if twice.unionByName(nested).isEmpty():
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp"))
