"""Exact top-k queries: single, batch and intersection, with exclusion, segments, channels, bias and the integer mode.

Two strategies give equal results: ``columns`` (a broadcast of the queries and column expressions; best for few pairs) and
``block`` (numpy over batches; best for many). Both filter excluded rows before scoring and never move the bank.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bake import quantized_queries
from ..functions.validate import NO_GROUP, check_spec, validate_bias, validate_group_bias, validate_payloads, validate_queries
from ..functions.vectors import (
    best_first,
    dot,
    dot_int,
    floor_to_float,
    part,
    scaled_double,
    squared_distance,
    xd_dot,
    xd_l2,
)
from ..model import FLT_MIN, Bank, InvalidArgument, Metric, QuerySpec, Segment, UnsupportedMode
from ..plans import block

#: Queries of one call that the column strategy takes; more go to the block strategy.
COLUMN_QUERIES = 4
#: Bytes of queries that are computed once, before anything else.
SETTLED_BYTES = 4 << 20
#: Rows of bias that are broadcast; more are joined by shuffle.
BROADCAST_BIAS = 1_000_000


@dataclass(frozen=True)
class Plan:
    """What is left of a spec once weights are folded: parts of (offset, length, weight, channel index or None)."""

    metric: Metric
    exact_int: bool
    parts: tuple[tuple[int, int, float, int | None], ...]
    fold: tuple[float, ...] | None


def resolve(bank: Bank, spec: QuerySpec) -> Plan:
    metric = spec.metric(bank)
    segments = tuple(s for s in spec.segments if s.weight != 0)
    if not spec.segments:
        return Plan(metric, spec.exact_int, (), None)
    of = {(c.offset, c.length): i for i, c in enumerate(bank.channels)}
    # a channel's cosine needs the bank's own metric and a segment that is exactly the channel
    cosine = bank.metric is Metric.COSINE and not spec.score_as_dot and not spec.exact_int and "inv_norms" in bank.df.columns
    parts = tuple((s.offset, min(s.length, bank.dims - s.offset), float(s.weight), of.get((s.offset, s.length)) if cosine else None) for s in segments)
    if metric is not Metric.L2 and not spec.exact_int and all(p[3] is None for p in parts):
        weights = np.zeros(bank.dims, np.float32)
        for o, n, w, _ in parts:
            weights[o : o + n] = np.float32(w)
        return Plan(metric, False, (), tuple(float(w) for w in weights))
    return Plan(metric, spec.exact_int, parts or ((0, 0, 0.0, None),), None)


def fold(queries: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights into the query, in float32; lanes outside all segments become 0."""
    w = F.array(*[F.lit(x).cast("float") for x in weights])
    return queries.withColumn("q", F.zip_with(F.col("q").cast("array<float>"), w, lambda a, b: a * b))


# -- column strategy -----------------------------------------------------------------------------------------------


def _weighted(values: list[tuple[float, Column]]) -> Column:
    total = F.lit(0.0)
    for w, v in values:
        total = total + F.lit(w) * v
    return total


def part_scores(bank: Bank, plan: Plan) -> list[Column]:
    """The contribution of each part, weight included, of a query (q, or q8, q_scale, q_sq) to a row."""
    out = []
    for offset, length, weight, channel in plan.parts or ((0, bank.dims, None, None),):
        if plan.exact_int:
            a, b = part(F.col("_q8"), offset, length), part(F.col("q8"), offset, length)
            cross = dot_int(a, b)
            v = xd_l2(cross, dot_int(b, b), dot_int(a, a), F.col("scale"), F.col("q_scale")) if plan.metric is Metric.L2 else xd_dot(cross, F.col("scale"), F.col("q_scale"))
        else:
            q = part(F.col("q"), offset, length)
            if plan.metric is Metric.L2:
                row = scaled_double(F.col("q8"), F.col("scale")) if bank.is_int8 else F.col("vec")
                v = squared_distance(q, part(row, offset, length))
            elif bank.is_int8:
                v = F.col("scale").cast("double") * dot(q, part(F.col("q8"), offset, length))
            else:
                v = dot(q, part(F.col("vec"), offset, length))
            if channel is not None:
                v = v * F.get(F.col("inv_norms"), F.lit(channel)).cast("double")
        out.append(v if weight is None else F.lit(weight) * v)
    return out


def score_column(bank: Bank, plan: Plan) -> Column:
    values = part_scores(bank, plan)
    total = values[0] if not plan.parts else _weighted([(1.0, v) for v in values])
    return floor_to_float(total) if plan.exact_int else total


def prepared(bank: Bank, queries: DataFrame, plan: Plan) -> DataFrame:
    """Queries as the plan scores them; (query_id, q), or payloads (query_id, q8, q_scale, q_sq) in the integer mode."""
    if plan.exact_int:
        payload = queries if "q_scale" in queries.columns else quantized_queries(queries)
        return payload.select("query_id", F.col("q8").alias("_q8"), "q_scale", "q_sq")
    return fold(queries.select("query_id", "q"), plan.fold) if plan.fold else queries.select("query_id", "q")


def with_bias(scored: DataFrame, spec: QuerySpec, exact_int: bool) -> DataFrame:
    if spec.bias is None:
        return scored
    keys = ["query_id", "group"] if spec.bias_group is not None else [c for c in ("query_id", "row_id") if c in spec.bias.columns]
    bias = spec.bias.select(*keys, F.col("bias").cast("double").alias("_bias"))
    bias = _few(bias, bias, BROADCAST_BIAS)
    total = F.col("score").cast("double") + F.col("_bias")
    total = floor_to_float(total) if exact_int else total
    return scored.join(bias, keys, "left").withColumn("score", F.coalesce(total, F.col("score"))).drop("_bias", "group")


def all_scores(bank: Bank, queries: DataFrame, spec: QuerySpec | None = None) -> DataFrame:
    """(query_id, row_id, score) of all pairs that are not excluded, bias included."""
    spec = spec or QuerySpec()
    plan = resolve(bank, spec)
    rows = bank.df if spec.exclude is None else bank.df.where(~_predicate(spec.exclude))
    asked = prepared(bank, queries, plan)
    pairs = rows.crossJoin(_few(asked, asked, max(1, block.BROADCAST_BYTES // (8 * bank.dims))))
    if spec.exclude_self:
        pairs = pairs.where("query_id <> row_id")
    scored = pairs.select("query_id", "row_id", score_column(bank, plan).alias("score"), *_group(spec))
    return with_bias(scored, spec, plan.exact_int)


def _group(spec: QuerySpec) -> list[Column]:
    """The group of a row, where a bias goes by groups."""
    if spec.bias is None or spec.bias_group is None:
        return []
    group = F.expr(spec.bias_group) if isinstance(spec.bias_group, str) else spec.bias_group
    return [F.coalesce(group.cast("bigint"), F.lit(NO_GROUP)).alias("group")]


def _predicate(condition: Column | str) -> Column:
    return F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))


# -- block strategy ------------------------------------------------------------------------------------------------


def floored(scores: np.ndarray) -> np.ndarray:
    scores[np.abs(scores) < FLT_MIN] = 0.0
    return scores.astype(np.float32).astype(np.float64)


class RowScorer(block.Scorer):
    """Scores of queries and bank rows, bias included in ``pairs``.

    ``left`` and ``right`` are the lanes whose product is the score, and two lanes more: what L2 and bias add, less the most
    that rounding can come to. That is at most (lanes + 3) roundings of the sum of |x||y|, of which twice as many are taken."""

    def __init__(self, bank: Bank, plan: Plan):
        self.int8, self.dims, self.plan = bank.is_int8, bank.dims, plan
        self.parts = plan.parts or ((0, bank.dims, 1.0, None),)
        self.l2, self.exact = plan.metric is Metric.L2, plan.exact_int
        self.sign = 1.0 if self.l2 else -1.0
        self._seen: tuple | None = None

    def slack(self, dtype: type) -> float:
        return (self.dims + 32) * (2.0**-23 if dtype is np.float32 else 2.0**-51) + 2.0**-22 * self.exact

    def _query(self, q: dict) -> np.ndarray:
        return q["_q8"].astype(np.float64) * q["q_scale"][:, None] if self.exact else q["q"].astype(np.float64)

    def _row(self, b: dict) -> np.ndarray:
        return b["q8"].astype(np.float64) * b["scale"].astype(np.float64)[:, None] if self.int8 else b["vec"].astype(np.float64)

    def _augmented(self, lanes: np.ndarray, make: Callable[[type], tuple[np.ndarray, np.ndarray]]) -> np.ndarray | None:
        """The lanes with two more, in the narrower type if it will do."""
        with np.errstate(over="ignore", invalid="ignore"):
            fits = block.safe(lanes)
            if fits is None:
                return None
            extra = make(np.float32 if fits.dtype == np.float32 else np.float64)
            if fits.dtype == np.float32 and max((np.abs(e).max(initial=0.0) for e in extra), default=0.0) > 1e30:
                extra = make(np.float64)
                fits = lanes
        out = np.column_stack([fits, *extra]).astype(fits.dtype)
        return out if np.isfinite(out).all() else None

    def left(self, q: dict) -> np.ndarray | None:
        x = self._query(q)
        lanes, plus, size = np.zeros_like(x), np.zeros(len(x)), np.zeros(len(x))
        for offset, length, weight, _ in self.parts:
            here = x[:, offset : offset + length]
            lanes[:, offset : offset + length] = here * (-2 * weight if self.l2 else -weight)
            square = (here * here).sum(1)
            plus, size = plus + weight * square, size + abs(weight) * square
        one = np.ones(len(x))
        if self.l2:
            return self._augmented(lanes, lambda t: (plus - 2 * self.slack(t) * size, one))
        return self._augmented(lanes, lambda t: (-self.slack(t) * np.sqrt((lanes * lanes).sum(1)), one))

    def right(self, b: dict) -> np.ndarray | None:
        y = self._row(b)
        lanes, plus, size = np.zeros_like(y), np.zeros(len(y)), np.zeros(len(y))
        for offset, length, weight, channel in self.parts:
            here = y[:, offset : offset + length]
            lanes[:, offset : offset + length] = here if channel is None else here * b["inv_norms"][:, channel].astype(np.float64)[:, None]
            square = (here * here).sum(1)
            plus, size = plus + weight * square, size + abs(weight) * square
        bias = np.zeros(len(y))
        if "_bias" in b and b["_bias"].dtype != object:
            bias = np.nan_to_num(b["_bias"].astype(np.float64))
        most = lambda t: self.sign * bias - self.slack(t) * np.abs(bias) - 2 * FLT_MIN * (t is np.float64)
        if self.l2:
            return self._augmented(lanes, lambda t: (np.ones(len(y)), plus - 2 * self.slack(t) * size + most(t)))
        return self._augmented(lanes, lambda t: (np.sqrt((lanes * lanes).sum(1)), most(t)))

    def _biases(self, q: dict, b: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Query, row and bias of the pairs that have one, by query and row."""
        if "_bias_of" not in b:
            return None
        has = np.flatnonzero([x is not None and len(x) > 0 for x in b["_bias_of"]])
        if not len(has):
            return None
        of, value = np.concatenate([b["_bias_of"][k] for k in has]), np.concatenate([b["_bias"][k] for k in has])
        row = np.repeat(has, [len(b["_bias_of"][k]) for k in has])
        order = np.argsort(q["query_id"], kind="stable")
        at = np.minimum(np.searchsorted(q["query_id"], of, sorter=order), len(order) - 1)
        here = np.flatnonzero(q["query_id"][order[at]] == of)
        if not len(here):
            return None
        i, j, v = order[at[here]], row[here], value[here]
        by = np.lexsort((j, i))
        return i[by], j[by], v[by]

    def _group_biases(self, q: dict, b: dict) -> tuple[np.ndarray, np.ndarray] | None:
        """Bias of each query in each group of the rows (NaN: none), and the place of each row's group."""
        if "_bias_group" not in q:
            return None
        if self._seen is None or self._seen[0] is not q or self._seen[1] is not b:
            groups, place = np.unique(b["group"], return_inverse=True)
            table = np.full((len(q["query_id"]), len(groups)), np.nan)
            has = np.flatnonzero([x is not None and len(x) > 0 for x in q["_bias_group"]])
            if len(has) and len(groups):
                of, value = np.concatenate([q["_bias_group"][k] for k in has]), np.concatenate([q["_bias_value"][k] for k in has])
                query = np.repeat(has, [len(q["_bias_group"][k]) for k in has])
                at = np.minimum(np.searchsorted(groups, of), len(groups) - 1)
                here = groups[at] == of
                table[query[here], at[here]] = value[here]
            self._seen = (q, b, table, place)
        return self._seen[2:]

    def adjust(self, lower: np.ndarray, q: dict, b: dict) -> None:
        if (grouped := self._group_biases(q, b)) is not None:
            table, place = grouped
            more = np.nan_to_num(self.sign * table - 2.0**-20 * np.abs(table)).astype(lower.dtype)
            lower += more[:, place]
            lower -= np.abs(lower) * lower.dtype.type(2.0**-20)
        if (found := self._biases(q, b)) is not None:
            i, j, v = found
            lower[i, j] += (self.sign * v - 2.0**-20 * np.abs(v)).astype(lower.dtype)
            lower[i, j] -= np.abs(lower[i, j]) * lower.dtype.type(2.0**-20)

    def pairs(self, q: dict, i: np.ndarray, b: dict, j: np.ndarray) -> np.ndarray:
        some, rows = (block.rows_of({k: v for k, v in x.items() if not k.startswith("_bias")}, at) for x, at in ((q, i), (b, j)))
        total = self._total(some, rows, lambda x, y: np.einsum("ij,ij->i", x, y), block.paired_dot, block.paired_l2, lambda v: v)
        if (grouped := self._group_biases(q, b)) is not None:
            table, place = grouped
            return self._add(total, table[i, place[j]])
        if "_bias" in b:
            if (found := self._biases(q, b)) is not None:
                bi, bj, v = found
                keys, asked = bi.astype(np.int64) << 32 | bj, i.astype(np.int64) << 32 | j
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                return self._add(total, np.where(keys[at] == asked, v[at], np.nan))
            if b["_bias"].dtype != object:
                return self._add(total, b["_bias"][j].astype(np.float64))
        return total

    def all(self, q: dict, b: dict) -> np.ndarray:
        return self._total(q, b, lambda x, y: whole_products(x, y), block.sequential_dot, block.sequential_l2, lambda v: v[:, None])

    def finish(self, fused: np.ndarray, b: dict) -> np.ndarray:
        """Bias of the rows, on scores of all of them."""
        return self._add(fused, b["_bias"].astype(np.float64)) if "_bias" in b else fused

    def _add(self, total: np.ndarray, bias: np.ndarray) -> np.ndarray:
        has = ~np.isnan(bias)
        if has.any():
            now = total[..., has] + bias[has]
            total[..., has] = floored(now) if self.exact else now
        return total

    def _total(self, q: dict, b: dict, products, dot_of, l2_of, per_query) -> np.ndarray:
        total = 0.0
        for offset, length, weight, channel in self.parts:
            at = slice(offset, offset + length)
            if self.exact:
                x, y = q["_q8"][:, at].astype(np.float64), b["q8"][:, at].astype(np.float64)
                cross, rs, qs = products(x, y), b["scale"].astype(np.float64), per_query(q["q_scale"])  # whole numbers below 2**53
                if self.l2:
                    v = ((qs * qs) * per_query((x * x).sum(1)) + (rs * rs) * (y * y).sum(1)) - ((rs * qs) * cross) * 2.0
                else:
                    v = cross * (rs * qs)
            else:
                x = q["q"][:, at].astype(np.float64)
                if self.l2:
                    v = l2_of(x, self._row(b)[:, at])
                else:
                    v = dot_of(x, b["q8" if self.int8 else "vec"][:, at].astype(np.float64))
                    v = b["scale"].astype(np.float64) * v if self.int8 else v
                    v = v * b["inv_norms"][:, channel] if channel is not None else v
            total = v if not self.plan.parts else total + weight * v
        return floored(total) if self.exact else total


def whole_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of int8 lanes, exact: sums below 2**24 in float32."""
    if x.shape[1] * 127 * 127 < 1 << 24:
        return (x.astype(np.float32) @ y.astype(np.float32).T).astype(np.float64)
    return x @ y.T


def _block_rows(bank: Bank, spec: QuerySpec, plan: Plan) -> DataFrame:
    """What a block scan reads of the bank: rows that are not excluded, with their bias; a bias for each query as two lists
    (``_bias_of``, ``_bias``), as long as the queries at most; of a bias by groups, the group alone."""
    rows = bank.df if spec.exclude is None else bank.df.where(~_predicate(spec.exclude))
    used = ["row_id", *(("q8", "scale") if bank.is_int8 else ("vec",))]
    if any(p[3] is not None for p in plan.parts):
        used.append("inv_norms")
    rows = rows.select(*used, *_group(spec))
    if spec.bias is not None and spec.bias_group is None:
        value = F.col("bias").cast("double").alias("_bias")
        if "query_id" in spec.bias.columns:
            bias = spec.bias.select("row_id", F.struct("query_id", value).alias("_of")).groupBy("row_id").agg(F.collect_list("_of").alias("_of"))
            bias = bias.select("row_id", F.col("_of.query_id").alias("_bias_of"), F.col("_of._bias").alias("_bias"))
        else:
            bias = spec.bias.select("row_id", value)
        rows = rows.join(_few(bias, spec.bias, BROADCAST_BIAS), "row_id", "left")
    return rows


def _few(df: DataFrame, counted: DataFrame, most: int) -> DataFrame:
    """``df``, to be broadcast if ``counted`` has ``most`` rows or fewer."""
    return F.broadcast(df) if counted.limit(most + 1).count() <= most else df


def _with_group_bias(asked: DataFrame, spec: QuerySpec) -> tuple[DataFrame, int]:
    """Queries with their bias as two lists (``_bias_group``, ``_bias_value``), and the bytes of the longest."""
    if spec.bias is None or spec.bias_group is None:
        return asked, 0
    pair = F.struct(F.col("group").cast("bigint").alias("group"), F.col("bias").cast("double").alias("value"))
    lists = spec.bias.groupBy("query_id").agg(F.collect_list(pair).alias("_of"))
    longest = spec.bias.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    lists = lists.select("query_id", F.col("_of.group").alias("_bias_group"), F.col("_of.value").alias("_bias_value"))
    return asked.join(lists, "query_id", "left"), 16 * longest


def _block_hits(bank: Bank, queries: DataFrame, spec: QuerySpec, plan: Plan) -> DataFrame:
    asked, more = _with_group_bias(prepared(bank, queries, plan), spec)
    hits = block.scan(_block_rows(bank, spec, plan), asked, RowScorer(bank, plan), spec.k, spec.exclude_self, 8 * bank.dims + more)
    return hits.withColumn("score", F.col("score").cast("float")) if plan.exact_int else hits


# -- entry points --------------------------------------------------------------------------------------------------


def ranked(scored: DataFrame, metric: Metric, k: int) -> DataFrame:
    """(query_id, rank, row_id, score) of the k best rows of each query; the limit reaches the partial sort."""
    order = Window.partitionBy("query_id").orderBy(*best_first(metric))
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "row_id", "score")


def _check(bank: Bank, queries: DataFrame, spec: QuerySpec) -> None:
    """Queries or payloads, and bias, in a pass over each."""
    if spec.exact_int and "q_scale" in queries.columns:
        validate_payloads(bank, queries)
    else:
        validate_queries(bank, queries, spec.segments)
    if spec.bias is not None and spec.bias_group is not None:
        validate_group_bias(spec.bias)
    elif spec.bias is not None:
        validate_bias(bank, spec.bias)


def _settled(bank: Bank, queries: DataFrame) -> DataFrame:
    """Few queries computed once, for what made them may be long, and they are checked, counted and sent."""
    most = max(1, SETTLED_BYTES // (8 * bank.dims))
    columns = [c for c in ("query_id", "q", "q8", "q_scale", "q_sq") if c in queries.columns]
    some = queries.select(*columns).limit(most + 1).toArrow()
    return queries.sparkSession.createDataFrame(some, queries.select(*columns).schema) if some.num_rows <= most else queries


def query_batch(bank: Bank, queries: DataFrame, spec: QuerySpec | None = None, validate: bool = True) -> DataFrame:
    """The k best rows of each query (query_id, q): query_id, rank, row_id, score. k = 0 gives none, before any check."""
    spec = spec or QuerySpec()
    check_spec(bank, spec)
    if spec.k == 0:
        return _none(bank)
    queries = _settled(bank, queries)
    if validate:
        _check(bank, queries, spec)
    plan = resolve(bank, spec)
    strategy = spec.strategy
    if strategy == "auto":
        strategy = "block" if queries.limit(COLUMN_QUERIES + 1).count() > COLUMN_QUERIES else "columns"
    scored = _block_hits(bank, queries, spec, plan) if strategy == "block" else all_scores(bank, queries, spec)
    return ranked(scored, plan.metric, spec.k)


def query(bank: Bank, q: DataFrame, spec: QuerySpec | None = None, validate: bool = True) -> DataFrame:
    """One query (a DataFrame of one row): rank, row_id, score. The limit becomes a top-k in every task."""
    spec = spec or QuerySpec()
    check_spec(bank, spec)
    if spec.k == 0:
        return _none(bank).drop("query_id")
    q = _settled(bank, q)
    if validate:
        _check(bank, q, spec)
    metric = spec.metric(bank)
    top = all_scores(bank, q, spec).orderBy(*best_first(metric)).limit(spec.k)
    return ranked(top, metric, spec.k).drop("query_id")


def query_intersect(bank: Bank, queries: DataFrame, spec: QuerySpec | None = None, validate: bool = True) -> DataFrame:
    """Rows by the worst of their scores under all queries: rank, row_id, score. Bias counts once, on the fused score."""
    spec = spec or QuerySpec()
    check_spec(bank, spec)
    if spec.bias is not None and spec.bias_group is not None:
        raise UnsupportedMode("an intersection has a bias of rows only")
    queries = _settled(bank, queries)
    if queries.limit(1).count() == 0:
        raise InvalidArgument("an intersection needs a query")
    if spec.k == 0:
        return _none(bank).drop("query_id")
    if validate:
        _check(bank, queries, spec)
    metric, plan = spec.metric(bank), resolve(bank, spec)
    worst = F.min("score") if metric.higher_is_better else F.max("score")
    if spec.strategy == "columns":
        scored = all_scores(bank, queries, replace(spec, bias=None))
    else:
        asked, score, size = prepared(bank, queries, plan), RowScorer(bank, plan), 8 * bank.dims
        hits = block.fused_scan(_block_rows(bank, spec, plan), asked, score, score.finish, spec.k, size)
        if hits is not None:
            hits = hits.withColumn("score", F.col("score").cast("float")) if plan.exact_int else hits
            return ranked(hits, metric, spec.k).drop("query_id")
        scored = block.worst_scan(_block_rows(bank, replace(spec, bias=None), plan), asked, score, size)
        scored = scored.withColumn("score", F.col("score").cast("float")) if plan.exact_int else scored
    fused = scored.groupBy("row_id").agg(worst.alias("score")).withColumn("query_id", F.lit(0).cast("bigint"))
    fused = with_bias(fused, spec, spec.exact_int)
    return ranked(fused.orderBy(*best_first(metric)).limit(spec.k), metric, spec.k).drop("query_id")


def decompose(bank: Bank, queries: DataFrame, hits: DataFrame, spec: QuerySpec) -> DataFrame:
    """What each segment adds to the score of each hit: query_id, row_id, segment, contribution (they add up in order).

    Weights are applied to each partial sum, never folded into the query."""
    plan = resolve(bank, spec)
    if not plan.parts:
        plan = replace(plan, fold=None, parts=tuple((s.offset, s.length, float(s.weight), None) for s in spec.segments) or ((0, bank.dims, 1.0, None),))
    asked = prepared(bank, queries, plan)
    pairs = hits.select("query_id", "row_id").join(_few(asked, asked, max(1, block.BROADCAST_BYTES // (8 * bank.dims))), "query_id").join(bank.df, "row_id")
    values = [floor_to_float(v) if plan.exact_int else v for v in part_scores(bank, plan)]
    return pairs.select("query_id", "row_id", F.posexplode(F.array(*values)).alias("segment", "contribution"))


def margins(hits: DataFrame, metric: Metric) -> DataFrame:
    """The gap of each hit to its runner-up: query_id, rank, margin (null for the last)."""
    after = F.lead("score").over(Window.partitionBy("query_id").orderBy("rank"))
    gap = F.col("score") - after if metric.higher_is_better else after - F.col("score")
    return hits.select("query_id", "rank", gap.alias("margin"))


def _none(bank: Bank) -> DataFrame:
    return bank.df.sparkSession.createDataFrame([], "query_id bigint, rank int, row_id bigint, score double")


def segments(*triples: tuple[int, int, float]) -> tuple[Segment, ...]:
    return tuple(Segment(*t) for t in triples)
