from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import sharding
from tessera.llm.queries import op8_sharding


def laws(rows, docs, shards: int) -> list[int]:
    """Check the contract's columns; the bytes of each shard."""
    text = defaultdict(list)
    for i, t in docs:
        text[i].append((t or "").encode())
    assert len(rows) == len(docs)
    slots, size, where = defaultdict(list), [0] * shards, {}
    for r in rows:
        assert any((r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t)) for t in text[r["doc_id"]])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
        assert where.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size


def test_query(spark, sf, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    size = laws(op8_sharding(spark, sf).collect(), docs, 16)
    assert max(size) - min(size) <= 0.02 * max(size)


def plain(docs: list[tuple], shards: int) -> dict[str, int]:
    """The shard of each text: best fit by looking at every bin, for the least share that holds all."""
    size = defaultdict(int)
    for _, t in docs:
        size[t or ""] += len((t or "").encode()) + 1
    total, names, weight = sum(size.values()), {}, defaultdict(int)
    least = max(1, -(-total // (shards * sharding.FINE)))
    for t, b in size.items():
        group = hashlib.sha256(t.encode()).digest()[:16]
        bundle = xxhash.xxh64_intdigest(group, seed=42)
        bundle -= (bundle >> 63) << 64
        names[t] = group.hex().upper() if b >= least else f"#{bundle % (shards * sharding.BUNDLES)}"
        weight[names[t]] += b
    items = sorted(weight.items(), key=lambda x: (-x[1], x[0]))
    own, rest, left = [], total, shards
    for _, b in items:
        if not (left > 1 and b * left > rest):
            break
        own.append(b)
        rest, left = rest - b, left - 1

    def fit(share):
        room, where, whole = own + [share] * left, {}, True
        for name, b in items:
            fits = [(c, i) for i, c in enumerate(room) if c >= b]
            whole &= bool(fits)
            i = min(fits)[1] if fits else max((c, i) for i, c in enumerate(room))[1]
            room[i] -= b
            where[name] = i
        return where, whole

    low, high = -(-rest // left), 2 * -(-rest // left) + (items[0][1] if items else 0)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fit(middle)[1] else (middle + 1, high)
    where = fit(low)[0]
    return {t: where[names[t]] for t in size}


def test_query_against_plain_packing(spark, sf, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    want, text = plain(docs, 16), dict(docs)
    assert all(r["shard"] == want[text[r["doc_id"]] or ""] for r in op8_sharding(spark, sf).collect())


@pytest.mark.parametrize("n", [0, 1, 15, 17])
def test_few_rows(spark, n):
    docs = [(i, f"{i}") for i in range(n)]
    laws(sharding.shard(spark.createDataFrame(docs, "doc_id bigint, text string"), 16).collect(), docs, 16)


def test_no_row_is_lost(spark):
    docs = [(i, f"{chr(65 + i // 74)}{chr(48 + i % 74)}") for i in range(5461)]
    laws(sharding.shard(spark.createDataFrame(docs, "doc_id bigint, text string"), 16).collect(), docs, 16)


def test_rows_without_an_id_and_rows_alike_are_spread(spark):
    df = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 10).alias("text"))
    docs = [(None, r["text"]) for r in df.collect()]
    placed = sharding.shard(df, 4)
    laws(placed.collect(), docs, 4)


def test_pack_against_plain_best_fit():
    rng = random.Random(1)
    for _ in range(50):
        bins = [rng.randint(20, 60) for _ in range(8)]
        tree, plain = sharding._Remaining(bins), list(bins)
        for size in sorted((rng.randint(1, 25) for _ in range(12)), reverse=True):
            fits = [(c, i) for i, c in enumerate(plain) if c >= size]
            want = min(fits) if fits else max((c, i) for i, c in enumerate(plain))
            assert tree.take(size) == want[1]
            plain[want[1]] -= size


def test_pack_is_whole_and_even():
    rng = random.Random(2)
    items = [(rng.randint(1, 1000), str(i)) for i in range(2000)]
    where = sharding.pack(items, 7)
    load = [0] * 7
    for s, name in items:
        load[where[name]] += s
    assert max(load) <= 1.0001 * sum(load) / 7
    assert sharding.pack([], 4) == {}


def test_a_group_above_a_share_has_a_shard(spark):
    docs = spark.createDataFrame([(i, "same" * 50) for i in range(300)] + [(1000 + i, f"other {i}") for i in range(300)], "doc_id bigint, text string")
    rows = sharding.shard(docs, 4).collect()
    laws(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 4)
    hot = {r["shard"] for r in rows if r["doc_id"] < 1000}
    assert len(hot) == 1 and not hot & {r["shard"] for r in rows if r["doc_id"] >= 1000}


def test_edges(messy, empty):
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    laws(sharding.shard(messy, 3).collect(), docs, 3)
    assert sharding.shard(empty, 16).count() == 0


def test_many_groups_of_equal_size(spark):
    docs = [(i, f"{i:09d}") for i in range(4300)]
    laws(sharding.shard(spark.createDataFrame(docs, "doc_id bigint, text string"), 16).collect(), docs, 16)
