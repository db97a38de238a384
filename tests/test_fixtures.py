"""The integer mode on banks A to E, against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from tessera import Metric, QuerySpec, Segment
from tessera.operators.query import query_batch, query_intersect

from . import fixtures

TINY = 2.0**-126


def floor(x: float) -> float:
    return float(np.float32(0.0 if abs(x) < TINY else x))


def payload(q: np.ndarray) -> tuple[np.ndarray, float]:
    most = float(np.abs(q.astype(np.float64)).max())
    if most == 0:
        return np.zeros(len(q), np.int64), 0.0
    return np.rint(q.astype(np.float64) * (127.0 / most)).astype(np.int64), most / 127.0


def score(name: str, q: np.ndarray, row: int, segments=()) -> float:
    q8, scale = fixtures.lanes(name)
    x, qs = payload(q)
    y, rs = q8[row].astype(np.int64), float(scale[row])
    total = 0.0
    for o, n, w in segments or ((0, len(x), None),):
        a, b = x[o : o + n], y[o : o + n]
        cross = float(a @ b)
        if fixtures.SHAPES[name][2] is Metric.L2:
            v = ((qs * qs) * float(a @ a) + (rs * rs) * float(b @ b)) - ((rs * qs) * cross) * 2.0
        else:
            v = cross * (rs * qs)
        total = v if w is None else total + w * v
    return floor(total)


@pytest.mark.parametrize("name", "ABCDE")
@pytest.mark.parametrize("strategy", ["columns", "block"])
@pytest.mark.parametrize("segments", [(), ((0, 16, 0.5), (16, 16, -2.0))])
def test_banks(spark, name, strategy, segments):
    rows, dims, metric = fixtures.SHAPES[name]
    q = fixtures.queries()[:, :dims]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, q array<float>")
    spec = QuerySpec(k=7, exact_int=True, strategy=strategy, segments=tuple(Segment(*s) for s in segments))
    got = {}
    for r in query_batch(fixtures.bank(spark, name), df, spec).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["row_id"], r["score"]))
    sign = 1 if metric is Metric.L2 else -1
    for i in range(8):
        all_of = [score(name, q[i], j, segments) for j in range(rows)]
        best = sorted(range(rows), key=lambda j: (sign * all_of[j], j))[:7]
        assert sorted(got[i]) == [(n + 1, j, all_of[j]) for n, j in enumerate(best)]


@pytest.mark.parametrize("name", "ABCDE")
def test_intersections(spark, name):
    rows, dims, metric = fixtures.SHAPES[name]
    q = fixtures.queries()[:, :dims]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, q array<float>")
    got = sorted((r["rank"], r["row_id"], r["score"]) for r in query_intersect(fixtures.bank(spark, name), df, QuerySpec(k=7, exact_int=True)).collect())
    sign = 1 if metric is Metric.L2 else -1
    worst = [max((sign * score(name, v, j) for v in q)) for j in range(rows)]
    best = sorted(range(rows), key=lambda j: (worst[j], j))[:7]
    assert got == [(n + 1, j, sign * worst[j]) for n, j in enumerate(best)]
