"""The engine's registered queries on the ``embeddings`` table, each with its DuckDB oracle where SQL can express it.

Three banks: ``cos`` (unit rows), and ``dot`` and ``l2`` (rows scaled by 1 + label, so that the metrics disagree). Queries
are the rows whose id is divisible by 50, against all rows; set analytics take each label as a set, and all pairs of sets.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sql, validate
from .functions.bake import bake, quantized_queries, rows_as_payloads, rows_as_queries
from .functions.vectors import dequantized
from .model import BadFormat, Bank, Channel, Metric, Quantization, QuerySpec, Segment
from .operators import analytics, compose, graph, matching, novelty, pca
from .operators.query import decompose, margins, query, query_batch, query_intersect
from .plans import oracle as o
from .sources import sidecar, text
from .storage import shared_dir
from .streaming.scratch import RECALL_SEED, ScratchBank

DIMS, K = 64, 10
METRICS = {"cos": Metric.COSINE, "dot": Metric.DOT, "l2": Metric.L2}
CHANNELS = tuple(Channel(f"c{i}", a, n) for i, (a, n) in enumerate(o.CHANNELS))
SEGMENTS = (Segment(0, 16, 0.5), Segment(16, 16, 0.0), Segment(32, 32, -1.25))
#: Two segments are channels, one is not.
CHANNEL_SEGMENTS = (Segment(0, 16, 1.0), Segment(16, 32, 0.25), Segment(48, 16, 2.0))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


# -- inputs --------------------------------------------------------------------------------------------------------


def rows(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    """row_id, vec, label of the whole table."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vec = F.col("embedding").cast("array<float>")
    if scaled:
        vec = F.transform(vec, lambda x: x * (F.col("label") + 1).cast("float"))
    return table.select(F.col("vec_id").cast("bigint").alias("row_id"), vec.alias("vec"), "label")


def bank(spark: SparkSession, sf_dir: str, metric: str, int8: bool = False, channels: tuple[Channel, ...] = ()) -> Bank:
    kind = Quantization.INT8 if int8 else Quantization.FLOAT32
    return bake(rows(spark, sf_dir, metric != "cos"), DIMS, METRICS[metric], kind, channels)


def _asked(b: Bank) -> DataFrame:
    return rows_as_queries(b, F.col("row_id") % 50 == 0)


def _sets(b: Bank) -> DataFrame:
    return b.df.select(F.col("label").cast("bigint").alias("set_id"), "row_id")


def _pairs(sets: DataFrame) -> DataFrame:
    ids = sets.select("set_id").distinct()
    return ids.select(F.col("set_id").alias("a")).join(ids.select(F.col("set_id").alias("b")), F.col("a") != F.col("b"))


def _listed(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(key, F.posexplode(value).alias("pos", "value"))


ASKED = "row_id % 50 = 0"
BIAS = "(label - 4.5) / 8"


# -- top-k ---------------------------------------------------------------------------------------------------------


def _top(metric: str, int8: bool, spec: QuerySpec, channels: tuple[Channel, ...] = (), bias: bool = False, by_query: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b, s = bank(spark, sf_dir, metric, int8, channels), spec
        if bias:
            pairs = b.df.select("row_id", F.expr(BIAS).cast("float").alias("bias"))
            if by_query:
                pairs = b.df.where(ASKED).select(F.col("row_id").alias("query_id"), F.col("label").cast("bigint").alias("group"), F.lit(-0.75).cast("float").alias("bias"))
                s = replace(s, bias_group="label")
            s = replace(s, bias=pairs)
        return query_batch(b, _asked(b), s)

    return run


def _xd(metric: str) -> tuple[str, str]:
    """SQL of the int8 bank and of the payloads asked."""
    b8 = o.int8(o.BANKS[metric])
    return b8, o.payload(f"(SELECT row_id AS query_id, {o.lanes()} AS q FROM {b8} WHERE {ASKED})")


def _segments_sql(parts, score: Callable[[int, int], str]) -> str:
    return "0::DOUBLE" + "".join(f" + ({s.weight})::DOUBLE * {score(s.offset, s.length)}" for s in parts if s.weight)


SELF = QuerySpec(k=K, exclude_self=True)
XD = QuerySpec(k=K, exclude_self=True, exact_int=True)
for _m in METRICS:
    _b, _q, _hi = o.BANKS[_m], o.query_set(o.BANKS[_m], ASKED), _m != "l2"
    _b8, _q8 = _xd(_m)
    _lane_q = f"(SELECT row_id AS query_id, {o.lanes()} AS q FROM {_b8} WHERE {ASKED})"
    _i8 = o.l2("q.q", "list_transform(b.q8, lambda x: x::DOUBLE * b.scale::DOUBLE)") if _m == "l2" else f"(b.scale::DOUBLE * {o.dot('q.q', 'b.q8')})"
    _add(f"topk_batch_{_m}_f32", _top(_m, False, SELF), o.top(o.scored(_b, _q, o.float_score(_m)), _hi))
    _add(f"topk_batch_{_m}_i8", _top(_m, True, SELF), o.top(o.scored(_b8, _lane_q, _i8), _hi))
    _add(f"topk_batch_{_m}_xd", _top(_m, True, XD), o.top(o.scored(_b8, _q8, o.xd_score(_m)), _hi))

_l2, _l2q = o.BANKS["l2"], o.query_set(o.BANKS["l2"], ASKED)
_add("topk_score_as_dot", _top("l2", False, QuerySpec(k=K, exclude_self=True, score_as_dot=True)), o.top(o.scored(_l2, _l2q, o.dot("q.q", "b.vec")), True))
_add("topk_excluded", _top("l2", False, QuerySpec(k=K, exclude="label >= 7")), o.top(o.scored(_l2, _l2q, o.l2("q.q", "b.vec"), "NOT b.label >= 7"), False))
_add("topk_bias_f32", _top("dot", False, SELF, bias=True), o.top(o.scored(o.BANKS["dot"], o.query_set(o.BANKS["dot"], ASKED), f"{o.dot('q.q', 'b.vec')} + ({BIAS})::FLOAT::DOUBLE"), True))
_b8, _q8 = _xd("l2")
_add("topk_bias_xd", _top("l2", True, XD, bias=True), o.top(o.scored(_b8, _q8, o.floor(f"({o.xd_score('l2')}::DOUBLE + ({BIAS})::FLOAT::DOUBLE)")), False))
_add("topk_bias_by_query", _top("l2", False, SELF, bias=True, by_query=True), o.top(o.scored(_l2, f"(SELECT s.*, e.label AS own FROM {_l2q} s JOIN embeddings e ON e.vec_id = s.query_id)", f"{o.l2('q.q', 'b.vec')} + (CASE WHEN b.label = q.own THEN -0.75::DOUBLE ELSE 0::DOUBLE END)"), False))


def _folded(parts, q: str = "q.q") -> str:
    """Weights into the query in float32, gaps 0."""
    w = np.zeros(DIMS, np.float32)
    for s in parts:
        w[s.offset : s.offset + s.length] = s.weight
    return f"list_transform(list_zip({q}, [{', '.join(repr(float(x)) for x in w)}]::FLOAT[]), lambda z: (z[1] * z[2])::FLOAT)"


_add("topk_segments_dot_f32", _top("dot", False, QuerySpec(k=K, exclude_self=True, segments=SEGMENTS)), o.top(o.scored(o.BANKS["dot"], o.query_set(o.BANKS["dot"], ASKED), o.dot(_folded(SEGMENTS), "b.vec")), True))
_add("topk_segments_l2_f32", _top("l2", False, QuerySpec(k=K, exclude_self=True, segments=SEGMENTS)), o.top(o.scored(_l2, _l2q, _segments_sql(SEGMENTS, lambda a, n: o.l2(o.part("q.q", a, n), o.part("b.vec", a, n)))), False))


def _xd_part(metric: str) -> Callable[[int, int], str]:
    def score(a: int, n: int) -> str:
        x, y = o.part("q.q8", a, n), o.part("b.q8", a, n)
        if metric == "l2":
            return o.xd_l2(o.dot(x, y), o.dot(y, y), o.dot(x, x), "b.scale", "q.q_scale")
        return o.xd_dot(o.dot(x, y), "b.scale", "q.q_scale")

    return score


for _m in ("dot", "l2"):
    _b8, _q8 = _xd(_m)
    _add(f"topk_segments_{_m}_xd", _top(_m, True, QuerySpec(k=K, exclude_self=True, exact_int=True, segments=SEGMENTS)), o.top(o.scored(_b8, _q8, o.floor(_segments_sql(SEGMENTS, _xd_part(_m)))), _m != "l2"))


def _channel_part(int8: bool) -> Callable[[int, int], str]:
    def score(a: int, n: int) -> str:
        base = f"(b.scale::DOUBLE * {o.dot(o.part('q.q', a, n), o.part('b.q8', a, n))})" if int8 else o.dot(o.part("q.q", a, n), o.part("b.vec", a, n))
        if (a, n) not in o.CHANNELS:
            return base
        lanes = o.part(o.lanes("b.q8", "b.scale") if int8 else "b.vec", a, n)
        return f"({base} * {o.inverse_norm(lanes)}::DOUBLE)"

    return score


_cos8 = o.int8(o.BANKS["cos"])
_cos8q = f"(SELECT row_id AS query_id, {o.lanes()} AS q FROM {_cos8} WHERE {ASKED})"
_add("topk_channels_cos_i8", _top("cos", True, QuerySpec(k=K, exclude_self=True, segments=CHANNEL_SEGMENTS), CHANNELS), o.top(o.scored(_cos8, _cos8q, _segments_sql(CHANNEL_SEGMENTS, _channel_part(True))), True))


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bank(spark, sf_dir, "l2")
    whole = compose.centroid(b, b.df.select(F.lit(0).cast("bigint").alias("query_id"), "row_id"))
    return query(b, whole, QuerySpec(k=K))


def _centroid_sql(b: str, key: str, unit: bool) -> str:
    """(query_id, q): mean lanes of each key."""
    lanes = f"SELECT {key} AS query_id, generate_subscripts(vec, 1) AS pos, unnest(vec)::DOUBLE AS x FROM {b}"
    mean = f"SELECT query_id, list(x ORDER BY pos) AS q FROM (SELECT query_id, pos, (sum(x) * (1::DOUBLE / count(*)))::FLOAT AS x FROM ({lanes}) GROUP BY query_id, pos) GROUP BY query_id"
    return f"(SELECT query_id, list_transform(q, lambda x: (x * {o.inverse_norm('q')})::FLOAT) AS q FROM ({mean}))" if unit else f"({mean})"


_near_mean = o.scored(_l2, _centroid_sql(_l2, "0", False), f"round({o.l2('q.q', 'b.vec')}, 6)", "true")
_add("topk_single", lambda s, d: _single(s, d).withColumn("score", F.round("score", 6)), f"SELECT rank, row_id, score FROM ({o.top(_near_mean, False)})")


def _intersect(metric: str, int8: bool, spec: QuerySpec) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = bank(spark, sf_dir, metric, int8)
        return query_intersect(b, _asked(b), spec)

    return run


def _intersect_sql(pairs: str, higher: bool) -> str:
    fused = f"(SELECT 0 AS query_id, row_id, {'min' if higher else 'max'}(score) AS score FROM {pairs} GROUP BY row_id)"
    return f"SELECT rank, row_id, score FROM ({o.top(fused, higher)})"


for _m in METRICS:
    _b8, _q8 = _xd(_m)
    _add(f"intersect_{_m}_f32", _intersect(_m, False, QuerySpec(k=K)), _intersect_sql(o.scored(o.BANKS[_m], o.query_set(o.BANKS[_m], ASKED), o.float_score(_m), "true"), _m != "l2"))
    _add(f"intersect_{_m}_xd", _intersect(_m, True, QuerySpec(k=K, exact_int=True)), _intersect_sql(o.scored(_b8, _q8, o.xd_score(_m), "true"), _m != "l2"))
_add("intersect_segments_l2_f32", _intersect("l2", False, QuerySpec(k=K, segments=SEGMENTS)), _intersect_sql(o.scored(_l2, _l2q, _segments_sql(SEGMENTS, lambda a, n: o.l2(o.part("q.q", a, n), o.part("b.vec", a, n))), "true"), False))
_b8, _q8 = _xd("dot")
_add("intersect_segments_dot_xd", _intersect("dot", True, QuerySpec(k=K, exact_int=True, segments=SEGMENTS)), _intersect_sql(o.scored(_b8, _q8, o.floor(_segments_sql(SEGMENTS, _xd_part("dot"))), "true"), True))


def _decomposed(metric: str, int8: bool, exact: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = bank(spark, sf_dir, metric, int8)
        spec = QuerySpec(k=K, exclude_self=True, segments=SEGMENTS, exact_int=exact)
        return decompose(b, _asked(b), query_batch(b, _asked(b), spec), spec)

    return run


def _decompose_sql(b: str, q: str, hits: str, part: Callable[[int, int], str], floor: bool) -> str:
    live = [s for s in SEGMENTS if s.weight]
    shape = o.floor if floor else (lambda x: x)
    each = ", ".join(shape(f"(({s.weight})::DOUBLE * {part(s.offset, s.length)})") for s in live)
    return f"SELECT query_id, row_id, generate_subscripts(c, 1)::INTEGER - 1 AS segment, unnest(c) AS contribution FROM (SELECT h.query_id, h.row_id, [{each}] AS c FROM ({hits}) h JOIN {q} q USING (query_id) JOIN {b} b ON b.row_id = h.row_id)"


_add("decompose_l2_f32", _decomposed("l2", False, False), _decompose_sql(_l2, _l2q, ORACLE["topk_segments_l2_f32"], lambda a, n: o.l2(o.part("q.q", a, n), o.part("b.vec", a, n)), False))
_b8, _q8 = _xd("dot")
_add("decompose_dot_xd", _decomposed("dot", True, True), _decompose_sql(_b8, _q8, ORACLE["topk_segments_dot_xd"], _xd_part("dot"), True))
_add("margins", lambda s, d: margins(QUERIES["topk_batch_l2_f32"](s, d), Metric.L2), f"SELECT query_id, rank, lead(score) OVER (PARTITION BY query_id ORDER BY rank) - score AS margin FROM ({ORACLE['topk_batch_l2_f32']})")


# -- baking and validation -----------------------------------------------------------------------------------------

_add("bake_normalized", lambda s, d: _listed(bake(rows(s, d, True), DIMS, Metric.COSINE).df, "row_id", "vec"), o.exploded(f"(SELECT row_id, list_transform(vec, lambda x: (x * {o.inverse_norm('vec')})::FLOAT) AS vec FROM {o.SCALED})", "row_id", "vec"))
_add("bake_quantized", lambda s, d: _listed(bank(s, d, "dot", True).df.withColumn("q8", F.col("q8").cast("array<int>")), "row_id", "q8"), o.exploded(o.int8(o.SCALED), "row_id", "q8"))
_add("bake_scales", lambda s, d: bank(s, d, "dot", True).df.select("row_id", "scale"), f"SELECT row_id, scale FROM {o.int8(o.SCALED)}")
_add("dequantized", lambda s, d: _listed(bank(s, d, "dot", True).df.select("row_id", dequantized(F.col("q8"), F.col("scale")).alias("q")), "row_id", "q"), o.exploded(f"(SELECT row_id, {o.lanes()} AS q FROM {o.int8(o.SCALED)})", "row_id", "q"))
_add("channel_inverse_norms", lambda s, d: _listed(bank(s, d, "cos", True, CHANNELS).df, "row_id", "inv_norms"), o.exploded(f"(SELECT row_id, [{', '.join(o.inverse_norm(o.part(o.lanes(), a, n)) for a, n in o.CHANNELS)}] AS inv FROM {_cos8})", "row_id", "inv"))
_add("query_payloads", lambda s, d: quantized_queries(rows_as_queries(bank(s, d, "l2"))).select("query_id", F.posexplode(F.col("q8").cast("array<int>")).alias("pos", "value"), "q_scale", "q_sq"), f"SELECT query_id, (generate_subscripts(q8, 1) - 1)::INTEGER AS pos, unnest(q8) AS value, q_scale, q_sq FROM {o.payload(f'(SELECT row_id AS query_id, vec AS q FROM {_l2})')}")


_add("row_payloads", lambda s, d: rows_as_payloads(bank(s, d, "l2", True)).select("query_id", F.posexplode(F.col("q8").cast("array<int>")).alias("pos", "value"), "q_scale", "q_sq"), f"SELECT query_id, (generate_subscripts(q8, 1) - 1)::INTEGER AS pos, unnest(q8) AS value, q_scale, q_sq FROM {o.stored_payload(o.int8(o.SCALED))}")


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of label 3 without a lane, of label 5 with a NaN, of label 7 zero."""
    bad = F.when(F.col("label") == 3, F.slice("vec", 1, DIMS - 1)).when(F.col("label") == 5, F.transform("vec", lambda x, i: F.when(i == 9, F.lit(float("nan"))).otherwise(x).cast("float")))
    return rows(spark, sf_dir).withColumn("vec", bad.when(F.col("label") == 7, F.transform("vec", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("vec")))


_add("validate_rows", lambda s, d: validate.bad_source_rows(_damaged(s, d), DIMS, Metric.COSINE), "SELECT count(*) FILTER (label IN (3, 5, 7)) AS n_bad, min(vec_id) FILTER (label = 3) AS first_bad_size, min(vec_id) FILTER (label = 5) AS first_not_finite, min(vec_id) FILTER (label = 7) AS first_zero FROM embeddings")
_add("validate_bank", lambda s, d: validate.bad_bank_rows(bank(s, d, "cos", True)).unionByName(validate.bad_bank_rows(Bank(bank(s, d, "dot").df, DIMS, Metric.COSINE))), "SELECT 0::BIGINT AS n_bad, NULL::BIGINT AS first_bad UNION ALL SELECT count(*), min(vec_id) FROM embeddings WHERE label > 0")


# -- query construction --------------------------------------------------------------------------------------------


def _by_label(b: Bank) -> DataFrame:
    return b.df.select(F.col("label").cast("bigint").alias("query_id"), "row_id")


for _m in ("cos", "l2"):
    _add(f"centroid_{_m}", lambda s, d, m=_m: _listed(compose.centroid(bank(s, d, m), _by_label(bank(s, d, m))), "query_id", "q").withColumn("value", F.round(F.col("value").cast("double"), 6)), f"SELECT query_id, pos, round(value::DOUBLE, 6) AS value FROM ({o.exploded(_centroid_sql(o.BANKS[_m], 'label::BIGINT', _m == 'cos'), 'query_id', 'q')})")


def _direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each row to the same row in the scaled bank turned by one lane: both of the whole table."""
    plain = rows_as_queries(bank(spark, sf_dir, "cos"))
    turned = rows_as_queries(bank(spark, sf_dir, "l2")).select("query_id", F.concat(F.slice("q", 2, DIMS - 1), F.slice("q", 1, 1)).alias("q"))
    return _listed(compose.direction(turned, plain), "query_id", "q")


_diff = f"(SELECT c.row_id AS query_id, list_transform(list_zip(list_concat(list_slice(s.vec, 2, 64), list_slice(s.vec, 1, 1)), c.vec), lambda z: (z[1] - z[2])::FLOAT) AS q FROM {o.COS} c JOIN {o.SCALED} s USING (row_id))"
_add("direction", _direction, o.exploded(f"(SELECT query_id, list_transform(q, lambda x: (x * {o.inverse_norm('q')})::FLOAT) AS q FROM {_diff})", "query_id", "q"))


def _pooled(weighted: bool, channel: tuple[int, int] | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = bank(spark, sf_dir, "dot", True)
        members = _by_label(b)
        if weighted:
            members = b.df.select(F.col("label").cast("bigint").alias("query_id"), "row_id", (F.col("row_id") % 3 + 1).alias("weight"))
        made = compose.pooled(b, members, *(channel or ()))
        return made.select("query_id", F.posexplode(F.col("q8").cast("array<int>")).alias("pos", "value"), "q_scale", "q_sq")

    return run


def _pooled_sql(b8: str, weight: str, *span: int) -> str:
    return o.pooled(b8, f"(SELECT label::BIGINT AS query_id, vec_id AS row_id, {weight} AS weight FROM embeddings)", *span)


_dot8 = o.int8(o.SCALED)
for _n, _w, _c in (("pooled", "1", None), ("pooled_weighted", "(vec_id % 3 + 1)", None), ("pooled_channel", "1", (16, 16))):
    _add(_n, _pooled(_w != "1", _c), f"SELECT query_id, (generate_subscripts(q8, 1) - 1)::INTEGER AS pos, unnest(q8) AS value, q_scale, q_sq FROM {_pooled_sql(_dot8, _w, *(_c or ()))}")


# -- set analytics -------------------------------------------------------------------------------------------------


def _analytic(metric: str, run: Callable[[Bank, DataFrame], DataFrame], channels: tuple[Channel, ...] = ()) -> Query:
    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = bank(spark, sf_dir, metric, True, channels)
        return run(b, _sets(b))

    return go


def _rounded(df: DataFrame, column: str) -> DataFrame:
    """Means to seven digits: the last bit of a float depends on the order of additions once in ten million times."""
    return df.withColumn(column, F.round(F.col(column).cast("double"), 6))


_payload_rows = lambda b8: o.payload(o.rows_as_queries(b8))
for _m in METRICS:
    _b8 = o.int8(o.BANKS[_m])
    _set = "(SELECT vec_id AS row_id, label::BIGINT AS set_id FROM embeddings)"
    _higher = _m == "dot"
    for _channel in (None, 1):
        _tag = f"{_m}_channel" if _channel is not None else _m
        _chs = CHANNELS if _channel is not None else ()
        _pool = _pooled_sql(_b8, "1", *((16, 16) if _channel is not None else ()))
        _rowsp = o.stored_payload(_b8, *((16, 16) if _channel is not None else ()))
        _dist = o.floor(o.xd_pair(_m))
        _add(f"centroid_distance_{_tag}", _analytic(_m, lambda b, s, c=_channel: analytics.centroid_distance(b, s, _pairs(s), c), _chs), f"WITH p AS MATERIALIZED {_pool} SELECT a.query_id AS a, b.query_id AS b, {_dist} AS distance FROM p a JOIN p b ON a.query_id <> b.query_id")
        if _channel is None:
            _score = o.xd_score(_m)
            _near = f"(1::DOUBLE - {_score}::DOUBLE)::FLOAT" if _m == "cos" else _score
            _each = f"SELECT q.query_id, s.set_id AS b, {'max' if _higher else 'min'}({_near}) AS distance FROM rows8 b JOIN {_set} s USING (row_id), pay q GROUP BY 1, 2"
        else:
            _each = f"SELECT a.query_id, s.set_id AS b, {'max' if _higher else 'min'}({_dist}) AS distance FROM pay b JOIN {_set} s ON s.row_id = b.query_id, pay a GROUP BY 1, 2"
        _with = f"WITH rows8 AS MATERIALIZED {_b8}, pay AS MATERIALIZED {_rowsp}, near AS MATERIALIZED ({_each})"
        for _r, _f in (("mean", "avg(distance::DOUBLE)"), ("max", "max(distance)::DOUBLE")):
            _add(f"divergence_{_r}_{_tag}", _analytic(_m, lambda b, s, c=_channel, r=_r: _rounded(analytics.nearest_divergence(b, s, _pairs(s), r, c), "value"), _chs), f"{_with} SELECT s.set_id AS a, n.b, round(({_f})::FLOAT::DOUBLE, 6) AS value FROM near n JOIN {_set} s ON s.row_id = n.query_id WHERE s.set_id <> n.b GROUP BY 1, 2")
            _add(f"spread_{_r}_{_tag}", _analytic(_m, lambda b, s, c=_channel, r=_r: _rounded(analytics.spread(b, s, r, c), "value"), _chs), f"WITH p AS MATERIALIZED {_pool}, pay AS MATERIALIZED {_rowsp} SELECT set_id, round(({_f})::FLOAT::DOUBLE, 6) AS value FROM (SELECT s.set_id, {_dist} AS distance FROM {_set} s JOIN p a ON a.query_id = s.set_id JOIN pay b ON b.query_id = s.row_id) GROUP BY set_id")
_add("drift", _analytic("l2", analytics.drift), f"WITH p AS MATERIALIZED {_pooled_sql(o.int8(o.SCALED), '1')} SELECT a.query_id AS set_id, {o.floor(o.xd_pair('l2'))} AS drift FROM p a JOIN p b ON b.query_id = (SELECT max(query_id) FROM p WHERE query_id < a.query_id)")


def _projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bank(spark, sf_dir, "l2")
    return analytics.projections(b, compose.centroid(b, b.df.select(F.lit(0).cast("bigint").alias("query_id"), "row_id")))


def _separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bank(spark, sf_dir, "l2")
    labelled = _projections(spark, sf_dir).join(b.df.select("row_id", "label"), "row_id")
    found = analytics.separation(labelled, F.col("label") >= 5)
    return found.select("n_in", "n_out", *[F.round(c, 6).alias(c) for c in ("mean_in", "mean_out", "separation")])


_proj = f"(SELECT row_id, label, {o.dot('q.q', 'b.vec')}::FLOAT AS projection FROM {o.SCALED} b, {_centroid_sql(o.SCALED, '0', False)} q)"
_add("projection", lambda s, d: _rounded(_projections(s, d), "projection"), f"SELECT row_id, round(projection::DOUBLE, 6) AS projection FROM {_proj}")
_add(
    "separation",
    _separation,
    f"SELECT n_in, n_out, round(m1, 6) AS mean_in, round(m0, 6) AS mean_out, round((m1 - m0) / sqrt((v1 * n_in + v0 * n_out) / (n_in + n_out)), 6) AS separation FROM (SELECT count(*) FILTER (label >= 5) AS n_in, count(*) FILTER (label < 5) AS n_out, avg(projection::DOUBLE) FILTER (label >= 5) AS m1, avg(projection::DOUBLE) FILTER (label < 5) AS m0, var_pop(projection::DOUBLE) FILTER (label >= 5) AS v1, var_pop(projection::DOUBLE) FILTER (label < 5) AS v0 FROM {_proj})",
)


def _pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components as (component, pos, value)."""
    _, found = pca.principal_components(bank(spark, sf_dir, "l2"), 4)
    listed = [(c, j, float(x)) for c, row in enumerate(found) for j, x in enumerate(row)]  # components x dims
    return spark.createDataFrame(listed, "component int, pos int, value double")


def _pca_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bank(spark, sf_dir, "l2")
    return pca.projected(b, *pca.principal_components(b, 4))


_parts = o.components(o.SCALED, DIMS, 4, 64)
_listed_parts = " UNION ALL ".join(f"SELECT {c}::INTEGER AS component, v FROM found{c + 1}" for c in range(4))
_add("pca_components", lambda s, d: _pca(s, d).withColumn("value", F.round("value", 6)), f"WITH RECURSIVE {_parts} SELECT component, (generate_subscripts(v, 1) - 1)::INTEGER AS pos, round(unnest(v), 6) AS value FROM ({_listed_parts})")
_coord = "list_inner_product(list_transform(list_zip(b.vec::DOUBLE[], mean.m), lambda z: z[1] - z[2]), f.v)"
_add("pca_projection", lambda s, d: _pca_projected(s, d).withColumn("coord", F.round("coord", 6)), f"WITH RECURSIVE {_parts} SELECT b.row_id, f.component, round({_coord}, 6) AS coord FROM {o.SCALED} b, mean, ({_listed_parts}) f")


# -- graph, novelty, matching --------------------------------------------------------------------------------------


def _whole(metric: str) -> str:
    """All pairs of an int8 bank in the integer mode."""
    return o.scored("rows8", "pay", o.xd_score(metric))


def _whole_with(metric: str) -> str:
    b8 = o.int8(o.BANKS[metric])
    return f"rows8 AS MATERIALIZED {b8}, pay AS MATERIALIZED {_payload_rows(b8)}"


_knn = {m: f"SELECT query_id AS row_id, rank - 1 AS slot, row_id AS neighbor, score FROM ({o.top(_whole(m), m != 'l2', 5)})" for m in METRICS}
for _m in METRICS:
    _add(f"knn_graph_{_m}", lambda s, d, m=_m: graph.knn_graph(bank(s, d, m, True), 5), f"WITH {_whole_with(_m)} {_knn[_m]}")
_edges = f"{_whole_with('cos')}, g AS MATERIALIZED ({_knn['cos']}), m AS MATERIALIZED (SELECT g.row_id, g.slot, g.neighbor FROM g JOIN g h ON g.row_id = h.neighbor AND g.neighbor = h.row_id)"
_add("knn_mutual", lambda s, d: graph.mutual(graph.knn_graph(bank(s, d, "cos", True), 5)), f"WITH {_edges} SELECT * FROM m")
_add("knn_padded", lambda s, d: graph.padded(graph.mutual(graph.knn_graph(bank(s, d, "cos", True), 5)), bank(s, d, "cos").df, 5), f"WITH {_edges} SELECT e.vec_id AS row_id, s.slot::INTEGER AS slot, coalesce(m.neighbor, -1) AS neighbor FROM embeddings e CROSS JOIN range(5) s(slot) LEFT JOIN m ON m.row_id = e.vec_id AND m.slot = s.slot")


def _doubled(spark: SparkSession, sf_dir: str) -> Bank:
    """The bank with a copy of every row of labels 0 to 4 under another id."""
    b = bank(spark, sf_dir, "dot", True)
    return Bank(b.df.unionByName(b.df.where("label < 5").withColumn("row_id", F.col("row_id") + 1_000_000_000)), DIMS, Metric.DOT, Quantization.INT8)


_add("duplicate_groups", lambda s, d: graph.duplicate_groups(_doubled(s, d)), "SELECT vec_id AS row_id, vec_id AS group_of FROM embeddings UNION ALL SELECT vec_id + 1000000000, vec_id FROM embeddings WHERE label < 5")
_add("components", lambda s, d: graph.bank_components(bank(s, d, "cos", True), 5), f"WITH RECURSIVE {_edges}, walk AS (SELECT vec_id AS row_id, vec_id AS c FROM embeddings UNION SELECT m.neighbor, w.c FROM walk w JOIN m ON m.row_id = w.row_id) SELECT row_id, min(c) AS component_id FROM walk GROUP BY row_id")

_base = {m: f"(SELECT query_id AS row_id, {'(1::FLOAT - score::FLOAT)' if m == 'cos' else 'score::FLOAT'}::FLOAT AS distance FROM ({o.top(_whole(m), m != 'l2', 5)}) WHERE rank = 5)" for m in ("cos", "l2")}
for _m in ("cos", "l2"):
    _add(f"novelty_baseline_{_m}", lambda s, d, m=_m: novelty.ascending(novelty.baseline(bank(s, d, m, True), 5)), f"WITH {_whole_with(_m)} SELECT row_number() OVER (ORDER BY distance) - 1 AS pos, distance FROM {_base[_m]}")
    _kth = f"(SELECT query_id, {'(1::FLOAT - score::FLOAT)' if _m == 'cos' else 'score::FLOAT'}::FLOAT AS distance FROM ({o.top(o.scored('rows8', 'turned', o.xd_score(_m), 'true'), _m != 'l2', 5)}) WHERE rank = 5)"
    _turn = f"turned AS MATERIALIZED {o.payload(f'(SELECT row_id AS query_id, list_reverse(vec) AS q FROM {o.BANKS[_m]} WHERE {ASKED})')}"
    _add(f"kth_distance_{_m}", lambda s, d, m=_m: novelty.kth_distance(bank(s, d, m, True), _turned(s, d, m), 5), f"WITH {_whole_with(_m)}, {_turn} SELECT query_id, distance FROM {_kth}")
    _add(f"novelty_score_{_m}", lambda s, d, m=_m: novelty.score(novelty.baseline(bank(s, d, m, True), 5), novelty.kth_distance(bank(s, d, m, True), _turned(s, d, m), 5)), f"WITH {_whole_with(_m)}, {_turn}, base AS MATERIALIZED (SELECT * FROM {_base[_m]}) SELECT query_id, ((SELECT count(*) FROM base b WHERE b.distance < k.distance)::DOUBLE / (SELECT count(*) FROM base))::FLOAT AS novelty FROM {_kth} k")


def _turned(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    """Probes outside the bank: the asked rows with their lanes reversed."""
    b = bank(spark, sf_dir, metric)
    return rows_as_queries(b, ASKED).select("query_id", F.reverse("q").alias("q"))


def _probe(channel: int | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = bank(spark, sf_dir, "cos", True, CHANNELS)
        probes = rows_as_queries(bank(spark, sf_dir, "cos")).select("query_id", F.reverse("q").alias("q"))
        return novelty.probe_distance(b, probes, b.df.select(F.col("row_id").alias("query_id"), "row_id"), channel)

    return run


for _channel in (None, 2):
    _span = (0, 64) if _channel is None else (32, 16)
    _pr = o.payload_part(o.payload(f"(SELECT row_id AS query_id, list_reverse(vec) AS q FROM {o.COS})"), *_span)
    _rr = o.stored_payload(_cos8, *_span)
    _add("probe_distance" + ("_channel" if _channel is not None else ""), _probe(_channel), f"SELECT a.query_id, b.query_id AS row_id, {o.floor(o.xd_pair('cos', zero='NULL'))} AS distance FROM {_pr} a JOIN {_rr} b USING (query_id)")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = bank(spark, sf_dir, "cos", True), bake(_jittered(spark, sf_dir), DIMS, Metric.COSINE, Quantization.INT8)
    return matching.mutual_matches(a, b, a.df.select("row_id"), 5)


def _jittered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's lanes with those of odd labels turned by one: half of the rows have a true match."""
    turned = F.concat(F.slice("vec", 2, DIMS - 1), F.slice("vec", 1, 1))
    return rows(spark, sf_dir).withColumn("vec", F.when(F.col("label") % 2 == 1, turned).otherwise(F.col("vec")))


_jit = "(SELECT vec_id AS row_id, CASE WHEN label % 2 = 1 THEN list_concat(list_slice(embedding, 2, 64), list_slice(embedding, 1, 1)) ELSE embedding END AS vec, label FROM embeddings)"
_jit = f"(SELECT row_id, list_transform(vec, lambda x: (x * {o.inverse_norm('vec')})::FLOAT) AS vec, label FROM {_jit})"
_add(
    "mutual_matches",
    _matches,
    f"WITH a8 AS MATERIALIZED {_cos8}, b8 AS MATERIALIZED {o.int8(_jit)}, ap AS MATERIALIZED {o.payload(o.rows_as_queries('a8'))}, bp AS MATERIALIZED {o.payload(o.rows_as_queries('b8'))}, "
    f"fwd AS MATERIALIZED ({o.top(o.scored('b8', 'ap', o.xd_score('cos'), 'true'), True, 5)}), back AS MATERIALIZED ({o.top(o.scored('a8', 'bp', o.xd_score('cos'), 'true'), True, 5)}), "
    f"ma AS (SELECT query_id, {o.ordered_mean('score', 'rank')} AS m FROM fwd GROUP BY query_id), mb AS (SELECT query_id, {o.ordered_mean('score', 'rank')} AS m FROM back GROUP BY query_id), "
    "kept AS (SELECT f.query_id AS a, f.row_id AS b, (2::DOUBLE * f.score::DOUBLE - ma.m - mb.m)::FLOAT AS csls FROM fwd f JOIN back k ON k.query_id = f.row_id AND k.rank = 1 AND k.row_id = f.query_id JOIN ma ON ma.query_id = f.query_id JOIN mb ON mb.query_id = f.row_id WHERE f.rank = 1) "
    "SELECT e.vec_id AS source_a, coalesce(k.b, -1) AS source_b, coalesce(k.csls, 0::FLOAT) AS csls FROM embeddings e LEFT JOIN kept k ON k.a = e.vec_id",
)


# -- mutable banks, sources ----------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, sf_dir: str, name: str) -> ScratchBank:
    """All rows appended label group by label group, and those of label 3 removed."""
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}/{name}"
    made = ScratchBank.create(spark, path, DIMS, Metric.COSINE, channels=CHANNELS, retain_floats=True)
    made.append(rows(spark, sf_dir).where("label < 5").select(F.col("row_id").alias("ord"), "vec"))
    made.append(rows(spark, sf_dir).where("label >= 5").select(F.col("row_id").alias("ord"), "vec"))
    ids = _scratch_ids(spark, sf_dir)
    made.remove(ids.where("label = 3").select("row_id"))
    return made


def _scratch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and the id that ``_scratch`` gives the row."""
    from .functions.ids import dense_ids

    first = rows(spark, sf_dir).where("label < 5").select(F.col("row_id").alias("vec_id"), "label")
    rest = rows(spark, sf_dir).where("label >= 5").select(F.col("row_id").alias("vec_id"), "label")
    return dense_ids(first, "vec_id", "row_id").unionByName(dense_ids(rest, "vec_id", "row_id", first.count()))


_ids = "(SELECT vec_id, label, embedding, (row_number() OVER (ORDER BY label >= 5, vec_id) - 1)::BIGINT AS row_id FROM embeddings)"
_scratch_rows = f"(SELECT row_id, label, list_transform(embedding, lambda x: (x * {o.inverse_norm('embedding')})::FLOAT) AS vec FROM {_ids} WHERE label <> 3)"


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(_scratch(spark, sf_dir, "snapshot").snapshot().df.select("row_id", F.col("q8").cast("array<int>").alias("q8")), "row_id", "q8")


_add("scratch_snapshot", _snapshot, o.exploded(o.int8(_scratch_rows), "row_id", "q8"))
_add("scratch_freeze", lambda s, d: _scratch(s, d, "freeze").freeze()[1], f"SELECT row_id AS old_id, CASE WHEN label = 3 THEN -1 ELSE sum((label <> 3)::INTEGER) OVER (ORDER BY row_id) - 1 END::BIGINT AS new_id FROM {_ids}")


def _relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _scratch(spark, sf_dir, "relabel")
    made.relabel((Channel("left", 0, 32), Channel("right", 32, 32)))
    return _listed(made.snapshot().df, "row_id", "inv_norms")


_scr8 = o.int8(_scratch_rows)
_add("scratch_relabel", _relabelled, o.exploded(f"(SELECT row_id, [{o.inverse_norm(o.part(o.lanes(), 0, 32))}, {o.inverse_norm(o.part(o.lanes(), 32, 32))}] AS inv FROM {_scr8})", "row_id", "inv"))


def _damaged_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank with the retained floats of label 2 doubled in store."""
    made = _scratch(spark, sf_dir, "retained")
    ids = _scratch_ids(spark, sf_dir).where("label = 2").select("row_id", F.lit(2.0).cast("float").alias("_by"))
    rows = made._rows().join(ids, "row_id", "left")
    rows = rows.withColumn("retained", F.transform("retained", lambda x: x * F.coalesce("_by", F.lit(1.0).cast("float")))).drop("_by")
    rows.write.parquet(f"{made.path}/data/damaged")
    return replace(made, manifest=replace(made.manifest, data=("data/damaged",))).retained_mismatches()


_add("scratch_retained", _damaged_retained, f"SELECT row_id FROM {_ids} WHERE label = 2")


def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = _scratch(spark, sf_dir, "frozen").freeze_with_recall(K, 100)
    lanes = F.concat(F.col("q8").cast("array<double>"), F.col("inv_norms").cast("array<double>"))
    return rows.df.select("row_id", F.posexplode(lanes).alias("pos", "value"))


_dense8 = f"(SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, q8, [{', '.join(o.inverse_norm(o.part(o.lanes(), a, n)) for a, n in o.CHANNELS)}] AS inv FROM {_scr8})"
_add("scratch_freeze_rows", _frozen, o.exploded(f"(SELECT row_id, list_concat(q8::DOUBLE[], inv::DOUBLE[]) AS v FROM {_dense8})", "row_id", "v"))


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bank tells of itself: before a row goes, after it, grown, loaded anew (all rows checked) and destroyed."""
    made = _scratch(spark, sf_dir, "accounts")
    held = made.snapshot()  # a reader of this version
    report = made.recall(K, 10)
    stale = made.stale(report)
    made.remove(spark.createDataFrame([(0,)], "row_id bigint"))
    made.grow(1 << 20)
    again, info = ScratchBank.load(spark, made.path), ScratchBank.peek(spark, made.path)
    bits = made.tombstone_words().agg(F.sum(F.bit_count("bits"))).first()[0]
    row = (again.count, again.live_count(), held.df.count(), info.capacity, made.generation, bits, info.row_bytes, stale, made.stale(report), again.retained(held.df.select("row_id")).count())
    made.destroy()
    try:
        ScratchBank.peek(spark, made.path)
        gone = False
    except BadFormat:
        gone = True
    return spark.createDataFrame([(*row, gone)], "n bigint, live bigint, held bigint, capacity bigint, generation bigint, removed bigint, row_bytes bigint, stale_before boolean, stale_after boolean, retained bigint, gone boolean")


_live = "count(*) FILTER (label <> 3)"
_add("scratch_accounts", _accounts, f"SELECT count(*) AS n, {_live} - 1 AS live, {_live} AS held, 1048576::BIGINT AS capacity, 4::BIGINT AS generation, count(*) - {_live} + 1 AS removed, (64 + 4 + 4 * 64)::BIGINT AS row_bytes, false AS stale_before, true AS stale_after, {_live} AS retained, true AS gone FROM {_ids}")


def _recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all live rows as queries: the whole row (channel -1) and each channel."""
    made = _scratch(spark, sf_dir, "recall")
    every = 1 << 28
    reports = [asdict(made.recall(K, every)) | {"channel": -1}, *(asdict(made.recall(K, every, channel=c)) | {"channel": c} for c in range(len(CHANNELS)))]
    return spark.createDataFrame(reports, "channel int, recall double, k int, sample_count int, live_rows bigint, seed bigint, generation bigint, informative boolean")


def _recall_sql() -> str:
    parts = []
    for c, (a, n) in enumerate([(0, DIMS), *o.CHANNELS], -1):
        f = f"(SELECT row_id, {o.part('vec', a, n)} AS vec, label FROM srows)"
        i = f"(SELECT row_id, {o.part('q8', a, n)} AS q8, scale, label FROM srows8)"
        near = o.top(o.scored("f", "(SELECT row_id AS query_id, vec AS q FROM f)", o.float_score("cos")), True, K)
        fast = o.top(o.scored("i", o.payload("(SELECT row_id AS query_id, vec AS q FROM f)"), o.xd_score("cos")), True, K)
        parts.append(f"(WITH f AS MATERIALIZED {f}, i AS MATERIALIZED {i} SELECT {c} AS channel, (SELECT count(*) FROM ({near}) x JOIN ({fast}) y USING (query_id, row_id))::DOUBLE / (count(*) * {K}) AS recall, {K} AS k, count(*)::INTEGER AS sample_count, count(*) AS live_rows, {RECALL_SEED}::BIGINT AS seed, 3::BIGINT AS generation, count(*) >= 100 AS informative FROM f)")
    return f"WITH srows AS MATERIALIZED {_scratch_rows}, srows8 AS MATERIALIZED {_scr8} " + " UNION ALL ".join(parts)


_add("scratch_recall", _recall, _recall_sql())


def _recall_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference ranking of a recall: retained floats in double, each row without itself."""
    made = _scratch(spark, sf_dir, "reference")
    floats = Bank(made.retained().join(made.snapshot().df.select("row_id"), "row_id", "left_semi"), DIMS, Metric.COSINE)
    return query_batch(floats, rows_as_queries(floats, ASKED), SELF)


_add("scratch_recall_topk", _recall_topk, o.top(o.scored(_scratch_rows, o.query_set(_scratch_rows, ASKED), o.float_score("cos")), True))


def _sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}/bank"
    named = rows(spark, sf_dir, True).select("row_id", "vec", F.concat(F.lit("v"), F.col("row_id").cast("string")).alias("id"))
    sidecar.write(named, path, Metric.L2, CHANNELS)
    back, _ = sidecar.read(spark, path)
    return back.select("row_id", "id", F.posexplode("vec").alias("pos", "value"))


_add("source_sidecar", _sidecar, f"SELECT row_id, 'v' || row_id AS id, (generate_subscripts(vec, 1) - 1)::INTEGER AS pos, unnest(vec) AS value FROM {o.SCALED}")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}/words"
    line = F.concat_ws(" ", F.concat(F.lit("w"), F.col("row_id").cast("string")), F.array_join(F.col("vec").cast("array<string>"), " "))
    rows(spark, sf_dir).select(F.when(F.col("label") == 0, F.concat(line, F.lit(" 1"))).otherwise(line).alias("value")).write.text(path)
    return text.read_vectors(spark, path, DIMS).select("id", F.posexplode("vec").alias("pos", "value"))


_add("source_words", _words, "SELECT 'w' || vec_id AS id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos, unnest(embedding) AS value FROM embeddings WHERE label <> 0")


def _ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest words of the first word, in a file of all rows as words."""
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}/ask"
    line = F.concat_ws(" ", F.concat(F.lit("w"), F.col("row_id").cast("string")), F.array_join(F.col("vec").cast("array<string>"), " "))
    rows(spark, sf_dir).select(line.alias("value")).repartitionByRange(2, "value").write.text(path)
    words, named = text.word_bank(spark, path, DIMS)
    return text.nearest_words(words, named, "w0", K).select("rank", "id", F.round("score", 6).alias("score"))


_w8 = f"(SELECT 'w' || row_id AS row_id, q8, scale, label FROM {_cos8})"
_add("ask_words", _ask, f"SELECT rank, row_id AS id, round(score, 6) AS score FROM ({o.top(o.scored(_w8, f'(SELECT row_id AS query_id, {o.lanes()} AS q FROM {_w8} WHERE row_id = ' + chr(39) + 'w0' + chr(39) + ')', o.dot('q.q', 'list_transform(b.q8, lambda x: x::DOUBLE * b.scale::DOUBLE)')), True)})")

# -- payloads as queries -------------------------------------------------------------------------------------------


def _by_payload(metric: str, single: bool) -> Query:
    """Pooled labels as queries, which enter as payloads: all, or the first alone."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = bank(spark, sf_dir, metric, True)
        pool = compose.pooled(b, _by_label(b))
        if single:
            return query(b, pool.where("query_id = 0"), QuerySpec(k=K, exact_int=True))
        return query_batch(b, pool, QuerySpec(k=K, exact_int=True))

    return run


for _m in METRICS:
    _b8 = o.int8(o.BANKS[_m])
    _hits = o.top(o.scored(_b8, _pooled_sql(_b8, "1"), o.xd_score(_m), "true"), _m != "l2")
    _add(f"topk_payload_batch_{_m}", _by_payload(_m, False), _hits)
    _add(f"topk_payload_single_{_m}", _by_payload(_m, True), f"SELECT rank, row_id, score FROM ({_hits}) WHERE query_id = 0")


# -- SQL functions -------------------------------------------------------------------------------------------------


def _by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the SQL functions say of each row and the row turned round."""
    sql.register(spark)
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: (x * (F.col("label") + 1)).cast("float")).alias("v")).createOrReplaceTempView("tessera_rows")
    return spark.sql(
        "SELECT vec_id AS row_id, bank_dot(v, reverse(v)) AS dot, bank_l2(v, reverse(v)) AS l2, bank_scale(v) AS scale, aggregate(bank_q8(v), 0, (s, x) -> s * 3 % 1000003 + x) AS q8, "
        "bank_unit(v)[5] AS unit, bank_lanes(bank_q8(v), bank_scale(v))[7] AS lane, bank_part(v, 16, 16)[0] AS first FROM tessera_rows"
    )


_i8 = o.int8(o.SCALED)
_add(
    "sql_functions",
    _by_sql,
    f"SELECT s.row_id, {o.dot('s.vec', 'list_reverse(s.vec)')} AS dot, {o.l2('s.vec', 'list_reverse(s.vec)')} AS l2, q.scale, list_reduce(list_prepend(0, q.q8), lambda s, x: s * 3 % 1000003 + x) AS q8, "
    f"(s.vec[6] * {o.inverse_norm('s.vec')})::FLOAT AS unit, ({o.lanes('q.q8', 'q.scale')})[8] AS lane, s.vec[17] AS first FROM {o.SCALED} s JOIN {_i8} q USING (row_id)",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other rows of each row asked, exact, in the integer mode."""
    return QUERIES["topk_batch_cos_xd"](spark, sf_dir)
