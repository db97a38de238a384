from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import lsh, minhash
from tessera.llm.common import materialize
from tessera.llm.queries import op3_minhash_dedup

from . import brute
from .conftest import sentence


def _by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_query_is_exact(spark, sf, documents):
    got = _by_id(op3_minhash_dedup(spark, sf))
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    want = brute.near_duplicates(docs, 2)
    assert {i: r["component_id"] for i, r in got.items()} == want
    for i, t in docs:
        assert got[i]["n_shingles"] == len(brute.shingles(t, 2))
        assert got[i]["kept"] == (want[i] == i)


def test_five_words(spark, sf, documents):
    got = _by_id(minhash.near_duplicates(documents))
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert {i: r["component_id"] for i, r in got.items()} == brute.near_duplicates(docs, 5)


@pytest.mark.parametrize("most", [lsh.TASK_EDGES, 0])
def test_chains_across_shared_passages(spark, monkeypatch, most):
    """Every document of a large group meets every other in some bucket; links between far ends must not be lost."""
    monkeypatch.setattr(lsh, "TASK_EDGES", most)
    rng = random.Random(3)
    words = sentence(rng, 60).split()
    docs, text = [], list(words)
    for i in range(120):
        docs.append((1000 - i, " ".join(text)))
        text[rng.randrange(60)] = f"w{i}"
        if i % 40 == 39:
            text = [*words[:30], *sentence(rng, 30).split()]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = _by_id(minhash.near_duplicates(df, words=2))
    assert {i: r["component_id"] for i, r in got.items()} == brute.near_duplicates(docs, 2)


def test_prefix_filter_finds_what_pivots_miss(spark):
    """Sets in one bucket, of many components that only some pairs link."""
    rng = random.Random(4)
    sets = {}
    for g in range(25):
        core = [rng.getrandbits(62) for _ in range(40)]
        for j in range(6):
            sets[100 * g + j + 1] = sorted({*core[j : 30 + j], *range(5)})
    items = spark.createDataFrame([(i, s) for i, s in sets.items()], "id bigint, set array<bigint>")
    scheme = lsh.Scheme(rows=5, bands=32)
    flat = items.select("id", F.size("set").cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("f1"), F.lit(1).cast("bigint").alias("f2"), F.array(F.lit(7).cast("bigint")).alias("keys"), *[F.lit(0).cast("bigint").alias(f"s{i}") for i in range(scheme.sketch_words)])
    labels = lsh.components(lsh.link(materialize(flat, "flat"), lambda ids: items.join(ids, "id", "left_semi"), scheme))
    got = {r["id"]: r["comp"] for r in labels.collect()}
    edges = [(a, b) for a in sets for b in sets if a < b and 10 * len({*sets[a]} & {*sets[b]}) >= 8 * len({*sets[a]} | {*sets[b]})]
    want = brute.components(sets, edges)
    assert {i: got.get(i, i) for i in sets} == want


@pytest.mark.parametrize("most", [lsh.TASK_EDGES, 0])
def test_components_of_a_long_path(spark, monkeypatch, most):
    monkeypatch.setattr(lsh, "TASK_EDGES", most)
    order = list(range(200))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:], strict=False), (500, 501), (501, 502), (7, 7)], "a bigint, b bigint")
    got = {r["id"]: r["comp"] for r in lsh.components(edges).collect()}
    assert got == {i: 0 for i in order} | {500: 500, 501: 500, 502: 500}
    assert lsh.components(edges.limit(0)).count() == 0


def test_min_max_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(6)
    scheme = lsh.Scheme(rows=1, bands=256)
    core = rng.integers(1, 2**62, 1000).astype(np.uint64)
    a, b = np.unique(core[:900]), np.unique(core[100:])
    keys = scheme.arrays(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))[3].to_pylist()
    same = np.mean([x == y for x, y in zip(*keys, strict=True)])
    assert abs(same - 0.8) < 0.08


def test_an_id_with_several_texts(spark):
    rng = random.Random(8)
    a, b, c = (sentence(rng, 80) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (7, a + " tail"), (9, b + " tail"), (2, c), (11, c), (12, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, words=2).collect()]
    want = brute.near_duplicates(rows, 2)
    assert sorted(got) == sorted((i, want[i], want[i] == i) for i, _ in rows)


def test_intermediate_tables_are_deleted(spark):
    import os

    from tessera.storage import shared_dir

    df = spark.createDataFrame([(i, f"the same words again and again {i % 3}") for i in range(30)], "doc_id bigint, text string")
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    minhash.near_duplicates(df, words=2).collect()
    assert len(set(os.listdir(folder)) - before) == 2  # what the result itself reads


def test_edges(messy, empty):
    rows = minhash.near_duplicates(messy, words=2).collect()
    assert len(rows) == messy.count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        elif r["doc_id"] in (0, 1, 2):
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (0, r["doc_id"], True)
    comp = {r["doc_id"]: r["component_id"] for r in rows}
    assert {comp[i] for i in (5, 6, 7, 8, 10**12)} == {5} and comp[9] == 9
    assert minhash.near_duplicates(empty).count() == 0
