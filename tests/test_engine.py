"""Identities between strategies and modes, edges, errors, mutable banks and sources."""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import Bank, Channel, Metric, Quantization, QuerySpec, Segment, queries
from tessera.functions import validate
from tessera.functions.bake import bake, quantized_queries, rows_as_queries, with_channels
from tessera.functions.ids import dense_ids
from tessera.model import BadFormat, CapacityExceeded, DimensionMismatch, InvalidArgument, NonFiniteInput, NonFiniteQuery, UnsupportedMode, ZeroNormQuery, ZeroNormRow
from tessera.operators import analytics, compose, graph, matching, novelty, pca
from tessera.operators.query import RowScorer, decompose, query, query_batch, query_intersect, resolve
from tessera.plans import block
from tessera.sources import sidecar, text
from tessera.streaming.scratch import ScratchBank

SEGMENTS = (Segment(0, 16, 0.5), Segment(32, 16, -2.0))


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "row_id bigint, vec array<float>")


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(1)
    return frame(spark, np.round(rng.normal(size=(60, 48)), 2))


def hits(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("kind", list(Quantization))
@pytest.mark.parametrize("segments", [(), SEGMENTS])
def test_columns_and_blocks_agree(small, metric, kind, segments):
    b = bake(small, 48, metric, kind)
    q = rows_as_queries(b)
    for exact in {False, kind is Quantization.INT8}:
        spec = dict(k=4, segments=segments, exact_int=exact, exclude="row_id % 5 = 1")
        a, c = (query_batch(b, q, QuerySpec(strategy=s, **spec)) for s in ("columns", "block"))
        assert hits(a) == hits(c)


def test_batch_is_many_singles(small):
    b = bake(small, 48, Metric.L2)
    batch = query_batch(b, rows_as_queries(b), QuerySpec(k=3))
    for i in (0, 17, 59):
        one = query(b, rows_as_queries(b, F.col("row_id") == i), QuerySpec(k=3))
        assert hits(one) == hits(batch.where(F.col("query_id") == i).drop("query_id"))
    for spec in (QuerySpec(k=5), QuerySpec(k=5, segments=SEGMENTS, exclude="row_id < 9")):
        assert hits(query_intersect(b, rows_as_queries(b), spec)) == hits(query_intersect(b, rows_as_queries(b), replace(spec, strategy="columns")))
    single = rows_as_queries(b, F.col("row_id") == 5)
    assert hits(query_intersect(b, single, QuerySpec(k=3))) == hits(query(b, single, QuerySpec(k=3)))


def test_blocks_of_queries_meet_blocks_of_rows(small, monkeypatch):
    b = bake(small, 48, Metric.COSINE, Quantization.INT8)
    spec = QuerySpec(k=4, exact_int=True, exclude_self=True)
    want = hits(query_batch(b, rows_as_queries(b), spec))
    sets = small.select((F.col("row_id") % 4).alias("set_id"), "row_id")
    near = hits(analytics.nearest(b, sets))
    monkeypatch.setattr(block, "BROADCAST_BYTES", 0)
    assert hits(query_batch(b, rows_as_queries(b), spec)) == want
    assert hits(analytics.nearest(b, sets)) == near
    for spec in (QuerySpec(k=5), QuerySpec(k=5, exact_int=True, segments=SEGMENTS)):
        assert hits(query_intersect(b, rows_as_queries(b), spec)) == hits(query_intersect(b, rows_as_queries(b), replace(spec, strategy="columns")))


def test_searches_run_once(small, monkeypatch):
    """A blocked scan deals queries to tasks: each keeps its k hits in one. A match reads both searches from their tables."""
    b = bake(small, 48, Metric.COSINE, Quantization.INT8)
    found = matching.mutual_matches(b, b, small.select("row_id"), 3)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert {(r["source_a"], r["source_b"]) for r in found.collect()} == {(i, i) for i in range(60)}
    for name, value in (("BROADCAST_BYTES", 0), ("QUERY_BLOCK", 1), ("SENT_BLOCKS", 1)):
        monkeypatch.setattr(block, name, value, raising=False)
    floats = bake(small, 48, Metric.L2)
    q, plan = rows_as_queries(floats), resolve(floats, QuerySpec())
    assert block.scan(floats.df, q, RowScorer(floats, plan), 3, True, 8 * 48).count() == 60 * 3


def test_dense_ids_of_many_rows(spark):
    df = spark.range(2_000_000).select(F.xxhash64("id").alias("ord"), F.sha2(F.col("id").cast("string"), 256).alias("payload")).dropDuplicates(["ord"])
    n = df.count()
    found = dense_ids(df, "ord").select("row_id", "ord")
    assert found.agg(F.count("*"), F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first()[:] == (n, n, 0, n - 1)
    assert found.orderBy("row_id").limit(3).collect() == found.orderBy("ord").limit(3).collect()


def test_appended_and_frozen_ids(spark, tmp_path):
    made = ScratchBank.create(spark, f"file://{tmp_path}/bank", 16, Metric.DOT)
    rows = spark.range(300_000).select(F.xxhash64("id").alias("ord"), F.array(*[F.rand(i).cast("float") for i in range(16)]).alias("vec")).dropDuplicates(["ord"])
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    made.append(rows.where("ord % 2 = 0"))
    made.append(rows.where("ord % 2 <> 0"))
    made.verify()
    made.remove(made.snapshot().df.where("row_id % 3 = 0").select("row_id"))
    frozen, ids = made.freeze()
    live = made.live_count()
    assert frozen.df.agg(F.count("*"), F.count_distinct("row_id"), F.max("row_id")).first()[:] == (live, live, live - 1)
    assert ids.where("new_id >= 0").agg(F.count_distinct("new_id")).first()[0] == live


@pytest.mark.parametrize("seed", range(4))
def test_bounds_lose_no_row(spark, seed):
    """Blocks against columns on lanes of wild sizes, with ties, zeros, repeated rows, bias and negative weights."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 48)) * 10.0 ** rng.integers(-3 - 6 * seed, 3 + 4 * seed, (300, 1))
    x[::7] = x[3]
    x[5::11] = 0
    x[::13, ::2] = 0
    df = frame(spark, x)
    bias = spark.createDataFrame([(i, j, float(rng.normal())) for i in range(0, 60, 3) for j in range(0, 300, 5)], "query_id bigint, row_id bigint, bias float")
    for metric, kind in ((Metric.DOT, Quantization.FLOAT32), (Metric.L2, Quantization.FLOAT32), (Metric.L2, Quantization.INT8), (Metric.DOT, Quantization.INT8)):
        b = bake(df, 48, metric, kind)
        q = rows_as_queries(b, F.col("row_id") < 60)
        for spec in (dict(), dict(segments=SEGMENTS), dict(bias=bias), dict(bias=bias.where("query_id = 0").drop("query_id")), dict(exact_int=kind is Quantization.INT8, bias=bias, exclude_self=True)):
            a, c = (query_batch(b, q, QuerySpec(k=6, strategy=s, **spec)) for s in ("columns", "block"))
            assert hits(a) == hits(c)


def test_bias_of_groups(spark, small, monkeypatch):
    """A bias by query and group is that of all pairs; no table of pairs is made, so a plan has as many rows as queries."""
    b = bake(small.withColumn("set", F.when(F.col("row_id") != 7, F.col("row_id") % 4)), 48, Metric.L2, Quantization.INT8)
    q = rows_as_queries(b, "row_id < 20")
    group = spark.createDataFrame([(i, g, (-1.0) ** g * 40.5 * (i + 1)) for i in range(0, 20, 3) for g in (0, 1, 3, 9)], "query_id bigint, group bigint, bias float")
    pairs = group.join(b.df.select("row_id", F.col("set").alias("group")), "group").select("query_id", "row_id", "bias")
    for exact in (False, True):
        spec = QuerySpec(k=5, exact_int=exact, exclude_self=True)
        want = hits(query_batch(b, q, replace(spec, bias=pairs)))
        for strategy in ("block", "columns"):
            assert hits(query_batch(b, q, replace(spec, bias=group, bias_group="set", strategy=strategy))) == want
        with monkeypatch.context() as m:
            m.setattr(block, "BROADCAST_BYTES", 0)
            assert hits(query_batch(b, q, replace(spec, bias=group, bias_group="set"))) == want
            m.setattr(block, "BIAS_PAIRS", 9)
            assert hits(query_batch(b, q, replace(spec, bias=pairs))) == want
    for odd in (group.union(group), group.withColumn("bias", F.lit(float("nan"))), group.withColumn("group", F.lit(None).cast("bigint"))):
        with pytest.raises((InvalidArgument, NonFiniteQuery)):
            query_batch(b, q, QuerySpec(bias=odd, bias_group="set"))
    with pytest.raises(UnsupportedMode):
        query_intersect(b, q, QuerySpec(bias=group, bias_group="set"))


def test_payloads_are_checked(spark, small):
    b = bake(small, 48, Metric.COSINE, Quantization.INT8)
    good = quantized_queries(rows_as_queries(b, "row_id < 2"))
    assert hits(query_batch(b, good, QuerySpec(k=3, exact_int=True))) == hits(query_batch(b, rows_as_queries(b, "row_id < 2"), QuerySpec(k=3, exact_int=True)))
    for column, value, error in (("q_scale", "-1.0D", InvalidArgument), ("q_scale", "double('inf')", InvalidArgument), ("q_sq", "q_sq + 1", InvalidArgument), ("q8", "slice(q8, 1, 4)", DimensionMismatch)):
        with pytest.raises(error):
            query_batch(b, good.withColumn(column, F.expr(value)), QuerySpec(exact_int=True))
    with pytest.raises(ZeroNormQuery):
        query_batch(b, good.withColumn("q8", F.transform("q8", lambda x: F.lit(0).cast("tinyint"))).withColumn("q_sq", F.lit(0).cast("bigint")), QuerySpec(exact_int=True))


def test_lanes_are_quantized_in_float32(spark):
    """Products beside a half, which float32 and double round to different whole numbers; subnormal lanes."""
    pairs = [(1.1360278129577637, -1.0778846740722656, -120), (2.584702253341675, 2.5338222980499268, 124), (2.828348159790039, -2.0822877883911133, -94), (1.3519607782363892, -0.49500927329063416, -46), (1e-40, -1e-40, -127)]
    b = bake(frame(spark, [[m, x, 0, 0] for m, x, _ in pairs]), 4, Metric.DOT, Quantization.INT8)
    assert [r["q8"] for r in b.df.orderBy("row_id").collect()] == [[127, q, 0, 0] for *_, q in pairs]


def test_contributions_add_up(small):
    b = bake(small, 48, Metric.L2)
    spec = QuerySpec(k=4, segments=SEGMENTS)
    top = query_batch(b, rows_as_queries(b), spec)
    parts = decompose(b, rows_as_queries(b), top, spec).groupBy("query_id", "row_id").agg(F.sum("contribution").alias("total"))
    assert all(abs(r["score"] - r["total"]) < 1e-9 for r in top.join(parts, ["query_id", "row_id"]).collect())


def test_a_whole_segment_is_no_segment(small):
    b = bake(small, 48, Metric.L2, Quantization.INT8)
    q = rows_as_queries(b)
    for exact in (False, True):
        assert hits(query_batch(b, q, QuerySpec(k=3, exact_int=exact))) == hits(query_batch(b, q, QuerySpec(k=3, exact_int=exact, segments=(Segment(0, 48, 1.0),))))


def test_ties_go_to_the_smaller_row(spark):
    b = bake(frame(spark, [[1, 0, 0, 0]] * 5), 4, Metric.DOT)
    assert [r["row_id"] for r in query(b, rows_as_queries(b, "row_id = 3"), QuerySpec(k=3)).orderBy("rank").collect()] == [0, 1, 2]
    assert query(b, rows_as_queries(b, "row_id = 3"), QuerySpec(k=99)).count() == 5


def test_edges(spark, small):
    b = bake(small, 48, Metric.L2)
    q = rows_as_queries(b)
    assert query_batch(b, q, QuerySpec(k=0)).count() == 0
    assert query_batch(b, q, QuerySpec(k=2, exclude=F.lit(True))).count() == 0
    empty = bake(small.limit(0), 48, Metric.L2)
    assert query_batch(empty, q, QuerySpec(k=2)).count() == 0
    assert query_batch(b, q.limit(0), QuerySpec(k=2)).count() == 0
    assert pca.principal_components(empty, 2)[1].shape == (2, 48)
    zero = bake(frame(spark, [[0] * 16, [1] * 16]), 16, Metric.DOT, Quantization.INT8)
    assert {r["scale"] for r in zero.df.where("row_id = 0").collect()} == {0.0}


def test_errors(spark, small):
    b = bake(small, 48, Metric.COSINE)
    q = rows_as_queries(b)
    for spec in (QuerySpec(k=-1), QuerySpec(segments=(Segment(1, 4),)), QuerySpec(segments=(Segment(0, 8), Segment(4, 8))), QuerySpec(segments=(Segment(0, 4, float("nan")),)), QuerySpec(segments=(Segment(48, 16),))):
        with pytest.raises(InvalidArgument):
            query_batch(b, q, spec)
    with pytest.raises(UnsupportedMode):
        query_batch(b, q, QuerySpec(exact_int=True))
    bad = lambda v: spark.createDataFrame([(0, v)], "query_id bigint, q array<float>")
    for values, error in (([1.0] * 4, DimensionMismatch), ([float("nan")] * 48, NonFiniteQuery), ([0.0] * 48, ZeroNormQuery), (None, DimensionMismatch)):
        for ask in (query, query_batch, query_intersect):
            with pytest.raises(error):
                ask(b, bad(values), QuerySpec())
    with pytest.raises(ZeroNormQuery):
        query_batch(b, bad([1.0] + [0.0] * 47), QuerySpec(segments=(Segment(4, 4),)))
    for vectors, error in (([[1] * 4], DimensionMismatch), ([[float("inf")] * 48], NonFiniteInput), ([[0] * 48], ZeroNormRow)):
        with pytest.raises(error):
            bake(frame(spark, vectors), 48, Metric.COSINE, validate=True)
    for channels in ((Channel("a", 0, 16), Channel("a", 16, 16)), (Channel("", 0, 16),), (Channel("a", 2, 4),), tuple(Channel(str(i), 4 * i, 4) for i in range(9))):
        with pytest.raises(InvalidArgument):
            bake(small, 48, Metric.L2, channels=channels)
    with pytest.raises(UnsupportedMode):
        novelty.baseline(bake(small, 48, Metric.DOT), 3).count()
    bias = spark.createDataFrame([(0, 1.0), (0, 2.0)], "row_id bigint, bias float")
    with pytest.raises(InvalidArgument):
        query_batch(b, q, QuerySpec(bias=bias))
    validate.validate_bank(b, data=True)
    with pytest.raises(NonFiniteInput):
        validate.validate_bank(Bank(small, 48, Metric.COSINE), data=True)


def test_bias_and_exclusion(spark, small):
    b = bake(small, 48, Metric.L2)
    bias = spark.createDataFrame([(59, -1e6)], "row_id bigint, bias float")
    top = query_batch(b, rows_as_queries(b), QuerySpec(k=1, bias=bias))
    assert {r["row_id"] for r in top.collect()} == {59}
    assert 59 not in {r["row_id"] for r in query_batch(b, rows_as_queries(b), QuerySpec(k=1, bias=bias, exclude="row_id = 59")).collect()}


def test_subnormal_scores_are_zero(spark):
    b = Bank(spark.createDataFrame([(0, [1] * 16, 2.0**-149), (1, [0] * 16, 0.0)], "row_id bigint, q8 array<tinyint>, scale float"), 16, Metric.DOT, Quantization.INT8)
    q = spark.createDataFrame([(0, [0.5] * 16)], "query_id bigint, q array<float>")
    assert {r["score"] for r in query_batch(b, q, QuerySpec(k=2, exact_int=True)).collect()} == {0.0}
    tiny = quantized_queries(spark.createDataFrame([(0, [2.0**-140, 0.0])], "query_id bigint, q array<float>")).first()
    assert tiny["q8"] == [127, 0]


def test_directions_and_centroids(spark):
    b = bake(frame(spark, [[1, 0, 0, 0], [-1, 0, 0, 0], [0, 2, 0, 0]]), 4, Metric.COSINE)
    sets = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 2)], "query_id bigint, row_id bigint")
    got = {r["query_id"]: r["q"] for r in compose.centroid(b, sets).collect()}
    assert got[0] is None and np.allclose(got[1], [0.5**0.5, 0.5**0.5, 0, 0])
    a, c = (spark.createDataFrame([(0, v)], "query_id bigint, q array<float>") for v in ([3.0, 0.0], [0.0, 4.0]))
    assert np.allclose(compose.direction(a, c).first()["q"], [0.6, -0.8])
    assert compose.direction(a, a).first()["q"] is None


def test_weights_are_repeats(small):
    b = bake(small, 48, Metric.DOT, Quantization.INT8)
    weighted = small.select((F.col("row_id") % 3).alias("query_id"), "row_id", (F.col("row_id") % 2 + 1).alias("weight"))
    repeated = weighted.select("query_id", "row_id", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).select("query_id", "row_id")
    assert hits(compose.pooled(b, weighted)) == hits(compose.pooled(b, repeated))


def test_duplicates_are_by_bytes(spark):
    b = bake(frame(spark, [[0.0, 1, 0, 0], [-0.0, 1, 0, 0], [0.0, 1, 0, 0]]), 4, Metric.DOT)
    assert hits(graph.duplicate_groups(b)) == [(0, 0), (1, 1), (2, 0)]


def test_a_bank_matches_itself(small):
    b = bake(small, 48, Metric.COSINE, Quantization.INT8)
    found = matching.mutual_matches(b, b, b.df.select("row_id"), 3).collect()
    assert len(found) == 60 and all(r["source_a"] == r["source_b"] for r in found)


def test_components_of_a_path(spark):
    ids = spark.createDataFrame([(i,) for i in range(40)], "row_id bigint")
    edges = spark.createDataFrame([(i, i + 2) for i in range(38)], "row_id bigint, neighbor bigint")
    assert hits(graph.components(ids, edges)) == [(i, i % 2) for i in range(40)]


def test_principal_components(small):
    x = np.array([r["vec"] for r in small.orderBy("row_id").collect()])
    mean, found = pca.principal_components(bake(small, 48, Metric.L2), 2, iterations=500)
    assert np.allclose(mean, x.mean(0), atol=1e-6)
    _, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert abs(found[0] @ vectors[:, -1]) > 0.99 and abs(found[0] @ found[1]) < 1e-9


def test_principal_components_of_many_lanes(small, monkeypatch):
    b = bake(small, 48, Metric.L2)
    mean, found = pca.principal_components(b, 2, iterations=8)
    monkeypatch.setattr(pca, "MAX_DIMS", 0)
    again = pca.principal_components(b, 2, iterations=8)
    assert np.allclose(again[0], mean) and np.allclose(again[1], found)


def test_novelty_refuses(spark, small):
    b = bake(small, 48, Metric.COSINE, Quantization.INT8, (Channel("a", 0, 16), Channel("b", 16, 32)))
    for k, limit in ((0, None), (60, None), (3, 59)):
        with pytest.raises(InvalidArgument):
            novelty.baseline(b, k, limit)
    assert novelty.baseline(b, 3, 60).count() == 60
    pairs = spark.createDataFrame([(0, 1)], "query_id bigint, row_id bigint")
    probe = spark.createDataFrame([(0, [0.0] * 16 + [1.0] * 32)], "query_id bigint, q array<float>")
    with pytest.raises(ZeroNormQuery):
        novelty.probe_distance(b, probe, pairs, 0)
    assert novelty.probe_distance(b, probe, pairs, 0, validate=False).first()["distance"] is None
    assert novelty.probe_distance(b, probe, pairs, 1).first()["distance"] > 0


def test_scratch_life(spark, small, tmp_path):
    path = f"file://{tmp_path}/bank"
    made = ScratchBank.create(spark, path, 48, Metric.COSINE, capacity=80, channels=(Channel("a", 0, 16),), retain_floats=True)
    rows = small.withColumnRenamed("row_id", "ord")
    assert made.append(rows.where("ord < 40")) == 0 and made.append(rows.where("ord >= 40")) == 40
    report = made.recall(k=3)
    assert report.sample_count == 60 and report.recall > 0.9 and not made.stale(report)
    gone = spark.createDataFrame([(3,), (3,), (59,)], "row_id bigint")
    made.remove(gone)
    before = made.generation
    made.remove(gone)
    assert made.generation == before and made.live_count() == 58 and made.stale(report)
    with pytest.raises(InvalidArgument):
        made.remove(spark.createDataFrame([(60,)], "row_id bigint"))
    with pytest.raises(CapacityExceeded):
        made.append(rows)
    made.grow(200)
    frozen, ids = made.freeze()
    live = made.snapshot()
    fresh = bake(live.df.join(small, "row_id").select("row_id", "vec"), 48, Metric.COSINE, Quantization.INT8, (Channel("a", 0, 16),))
    assert hits(live.df.select("row_id", "q8", "scale", "inv_norms")) == hits(fresh.df.select("row_id", "q8", "scale", "inv_norms"))
    assert {(r["old_id"], r["new_id"]) for r in ids.collect()} >= {(0, 0), (3, -1), (4, 3), (59, -1)} and frozen.df.count() == 58
    made.relabel((Channel("a", 0, 16), Channel("b", 16, 32)))
    assert hits(made.snapshot().df.select("row_id", "inv_norms")) == hits(with_channels(fresh, made.channels).df.select("row_id", "inv_norms"))
    assert made.retained_mismatches().count() == 0
    again = ScratchBank.load(spark, path)
    assert again.manifest == made.manifest and ScratchBank.load(spark, path, 1).count == 40
    with pytest.raises(InvalidArgument):
        ScratchBank.create(spark, path, 48, Metric.COSINE)
    *_, reports = made.freeze_with_recall(3)
    assert [r.sample_count for r in reports] == [58, 58] and all(r.recall > 0.9 and not r.informative for r in reports)
    info = ScratchBank.peek(spark, path)
    assert (info.count, info.row_bytes, info.padded_dims) == (60, 48 + 4 + 4 * 48, 48) and info.stored_bytes > 0
    made.destroy()
    with pytest.raises(BadFormat):
        ScratchBank.load(spark, path)


def test_recall_of_few_rows(spark, small, tmp_path):
    made = ScratchBank.create(spark, f"file://{tmp_path}/few", 48, Metric.DOT, retain_floats=True)
    assert made.recall().recall == 0.0
    made.append(small.where("row_id < 4").withColumnRenamed("row_id", "ord"))
    report = made.recall()
    assert (report.k, report.sample_count, report.recall) == (3, 4, 1.0)


def test_damaged_archives(spark, small, tmp_path):
    path = tmp_path / "bank"
    made = ScratchBank.create(spark, f"file://{path}", 48, Metric.COSINE, capacity=80, channels=(Channel("a", 0, 16),), retain_floats=True)
    made.append(small.withColumnRenamed("row_id", "ord"))
    ScratchBank.load(spark, f"file://{path}")
    manifest = path / "manifest" / f"{made.manifest.version}.json"
    good = json.loads(manifest.read_text())

    def stored(m) -> None:
        manifest.write_text(json.dumps(m))
        for f in (path / "manifest").glob(".*crc"):
            f.unlink()

    for change in ({"format": 9}, {"format": 2}, {"dims": 0}, {"dims": 1 << 18}, {"capacity": 1 << 29}, {"count": 81}, {"count": -1}, {"count": 59}, {"metric": "l7"}, {"channels": [["a", 0, 16], ["a", 16, 16]]}, {"channels": [["a", 3, 5]]}, {"data": ["data/none"]}, {"data": []}):
        stored(good | change)
        with pytest.raises(BadFormat):
            ScratchBank.load(spark, f"file://{path}")
    rows = made._rows().cache()
    rows.count()
    for name, df in (
        ("ids", rows.withColumn("row_id", F.when(F.col("row_id") == 3, F.lit(4)).otherwise(F.col("row_id")))),
        ("lanes", rows.withColumn("q8", F.when(F.col("row_id") == 3, F.slice("q8", 1, 4)).otherwise(F.col("q8")))),
        ("scale", rows.withColumn("scale", F.when(F.col("row_id") == 3, F.lit(float("nan"))).otherwise(F.col("scale")).cast("float"))),
        ("floats", rows.withColumn("retained", F.when(F.col("row_id") == 3, F.reverse("retained")).otherwise(F.col("retained")))),
        ("nofloats", rows.withColumn("retained", F.when(F.col("row_id") != 3, F.col("retained")))),
    ):
        df.write.parquet(f"file://{path}/data/{name}")
        stored(good | {"data": [f"data/{name}"]})
        with pytest.raises(BadFormat):
            ScratchBank.load(spark, f"file://{path}")
    spark.createDataFrame([(60,)], "row_id bigint").write.parquet(f"file://{path}/removed/odd")
    stored(good | {"removed": ["removed/odd"]})
    with pytest.raises(BadFormat):
        ScratchBank.load(spark, f"file://{path}")


def test_two_writers(spark, small, tmp_path):
    """The slower of two writers of one version fails, and nothing of its change is seen."""
    first = ScratchBank.create(spark, f"file://{tmp_path}/bank", 48, Metric.L2)
    second = ScratchBank.load(spark, f"file://{tmp_path}/bank")
    rows = small.withColumnRenamed("row_id", "ord")
    first.append(rows.where("ord < 10"))
    with pytest.raises(Exception):  # noqa: B017  the file system's own error
        second.append(rows)
    assert ScratchBank.load(spark, f"file://{tmp_path}/bank").count == 10


def test_a_refused_batch_leaves_no_removals(spark, small, tmp_path):
    made = ScratchBank.create(spark, f"file://{tmp_path}/bank", 48, Metric.L2, capacity=61)
    made.append(small.withColumnRenamed("row_id", "ord"))
    log = spark.createDataFrame([(1, "append", None, [1.0] * 48), (2, "append", None, [1.0] * 48), (3, "remove", 5, None)], "seq bigint, op string, row_id bigint, vec array<float>")
    with pytest.raises(CapacityExceeded):
        made.apply(log, 0)
    assert not (tmp_path / "bank" / "removed").exists() and made.live_count() == 60


def test_stream(spark, small, tmp_path):
    log = small.select(F.col("row_id").alias("seq"), F.lit("append").alias("op"), F.lit(None).cast("bigint").alias("row_id"), "vec")
    log = log.unionByName(spark.createDataFrame([(100, "remove", 7, None)], log.schema))
    log.repartition(1).write.parquet(f"{tmp_path}/log")
    made = ScratchBank.create(spark, f"file://{tmp_path}/bank", 48, Metric.L2)
    made.follow(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"), f"{tmp_path}/cp").awaitTermination()
    assert made.count == 60 and made.live_count() == 59
    made.apply(log, 0)
    assert made.count == 60
    assert hits(made.snapshot().df.select("row_id", "q8")) == hits(bake(small, 48, Metric.L2, Quantization.INT8).df.where("row_id <> 7").select("row_id", "q8"))


def test_sidecar(spark, small, tmp_path):
    path = f"file://{tmp_path}/x"
    sidecar.write(small.withColumn("id", F.concat(F.lit("n"), "row_id")), path, Metric.L2, (Channel("a", 0, 16),), "about")
    back, header = sidecar.read(spark, path)
    assert hits(back.select("row_id", "vec")) == hits(small) and header["description"] == "about"
    assert sidecar.read_bank(spark, path).channels == (Channel("a", 0, 16),)
    assert (Bank(small, 48, Metric.L2).partitions(60), Bank(small, 48, Metric.L2).partitions(10**7)) == (1, 29)
    good = (tmp_path / "x.wvbank.json").read_text()
    for old, new in (('"schemaVersion": 2', '"schemaVersion": 9'), ('"metric": "l2"', '"metric": "l3"'), ('"dtype": "float32"', '"dtype": "int4"'), ('"n1"', '"n0"'), ('"count": 60', '"count": 59')):
        assert old in good
        (tmp_path / "x.wvbank.json").write_text(good.replace(old, new))
        for f in tmp_path.glob(".*crc"):
            f.unlink()
        with pytest.raises(BadFormat):
            sidecar.read(spark, path)


def test_text_embeddings(spark, tmp_path):
    (tmp_path / "v.txt").write_text('the 1 0 0 0\nof 0.9 0.1 0 0\nshort 1 0\nodd 1 x 0 0\nq"t 1 1 1 1\nnan nan 0 0 0\nto 0 0 1 0\n')
    b, words = text.word_bank(spark, f"{tmp_path}/v.txt", 4)
    assert [r["id"] for r in words.orderBy("row_id").collect()] == ["the", "of", "to"]
    assert [r["id"] for r in text.nearest_words(b, words, "the", 2).orderBy("rank").collect()] == ["of", "to"]


def test_plans(spark, sf):
    """The batch keeps k hits a task and reads no column it does not need; the single query is a top-k without a sort."""
    b = queries.bank(spark, sf, "l2", True)
    plan = query_batch(b, rows_as_queries(b), QuerySpec(k=5, exact_int=True))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    one = query(b, rows_as_queries(b, "row_id = 0"), QuerySpec(k=5))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in one
