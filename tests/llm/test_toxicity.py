from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.queries import op4_toxicity

from . import brute
from .conftest import sentence


def auc(pairs) -> float:
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / max(1, len(pos) * len(neg))


def test_query_held_out(spark):
    sf = "/root/testdata/sf0.1"  # a hundredth of it has ten toxic documents that are held out
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op4_toxicity(spark, sf).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    assert auc([(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]) >= 0.9


def test_query_against_a_plain_refit(spark, sf, documents):
    """Log-odds, drift, lambda, K, curve and every score, refitted from texts and labels in plain Python."""
    docs = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r["toxic"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in docs:
            t = docs[r["doc_id"]]
            labels[t] = max(r["toxic"], labels.get(t, 0))
    trim = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…’‘“”«»¡¿"

    def parts(token):
        w = token.strip(trim).lower()
        return [w, *(w[:k] + "*" for k in (4, 5, 6, 7, 8) if k < len(w))] if w else []

    tokens, docs_of, sizes = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for t, y in labels.items():
        if not brute.fold(t, 5):
            found = [f for w in brute.WORD.findall(t) for f in parts(w)]
            tokens[y].update(found)
            docs_of[y].update(set(found))
            sizes[y] += 1
    n = [float(sum(k for f, k in c.items() if not f.endswith("*"))) for c in tokens]
    odds, share = {}, {}
    for f in {*docs_of[0], *docs_of[1]}:
        d, y = [docs_of[c][f] for c in (0, 1)], [tokens[c][f] for c in (0, 1)]
        if d[1] < 4:
            continue
        expected, g = [m * sum(d) / sum(sizes) for m in sizes], 0.0
        for c in (0, 1):
            for seen, hoped in ((d[c], expected[c]), (sizes[c] - d[c], sizes[c] - expected[c])):
                g += seen * np.log(seen / hoped) if seen else 0.0
        z = np.sign(d[1] / sizes[1] - d[0] / sizes[0]) * np.sqrt(max(0.0, 2 * g))
        prior = 500 * sum(y) / sum(n)
        ratio = [np.log((y[c] + prior) / max(n[c] + 500 - y[c] - prior, 1.0)) for c in (0, 1)]
        if z >= 4.5 and ratio[1] - ratio[0] > 1.5:
            odds[f], share[f] = ratio[1] - ratio[0], (y[0] + prior) / (n[0] + 500)
    assert odds
    over = max(1.0, 2 * sum(share.values()))
    p = {f: v / over for f, v in share.items()}
    drift = max(0.1, 2 * sum(p[f] * odds[f] for f in odds))
    lam = brentq(lambda x: (1 - sum(p.values())) * np.exp(-x * drift) + sum(p[f] * np.exp(x * odds[f]) for f in odds) - 1)

    def scan(t):
        words = brute.WORD.findall(t)
        value = [max([0.0, *(odds.get(f, 0.0) for f in parts(w))]) for w in words]
        at = np.flatnonzero(value)
        return len(words), toxicity.segments(at, np.array(value)[at], drift) if len(at) else []

    fold = [(scan(t), y) for t, y in labels.items() if brute.fold(t, 5)]
    best = lambda found: max((s for *_, s in found), default=0.0)
    clean = [(m, best(found)) for (m, found), y in fold if not y and m]
    k = max(0.5, sum(x > 0 for _, x in clean)) / sum(m * np.exp(-lam * x) for m, x in clean)

    def features(m, found):
        if not found:
            return [1.0, 0.0, 0.0, 0.0]
        hits = sum(-np.expm1(-k * m * np.exp(-lam * s)) <= 0.05 for *_, s in found)
        return [1.0, min(30.0, max(-10.0, lam * best(found) - np.log(k * m))) / 10 + 1, min(30.0, best(found)) / 10, np.log(1 + hits)]

    w = brute.logistic(np.array([features(*x) for x, _ in fold]), np.array([y for _, y in fold], float), [1e-3, 0.1, 0.1, 0.1])
    for r in op4_toxicity(spark, sf).collect():
        want = 1 / (1 + np.exp(-np.dot(features(*scan(docs[r["doc_id"]])), w)))
        assert abs(r["score"] - want) < 1e-4
        assert r["predicted"] == (want >= 0.5) or abs(want - 0.5) < 1e-4


def brentq(f) -> float:
    """The root of a function that falls below 0 and then rises, right of its minimum."""
    low, high = 1e-3, 50.0
    while high - low > 1e-12:
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return low


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-1, -1, -1, 1, 2, 3]), max_size=40))
def test_segments_are_the_maximal_ones(marks):
    """Against the recursive definition: the best segment, then those left and right of it."""
    drift = 0.75
    at = np.array([i for i, m in enumerate(marks) if m > 0], int)
    odds = np.array([float(marks[i]) for i in at])
    value = [float(m) if m > 0 else -drift for m in marks]

    def best(lo, hi):
        found = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += value[b]
                shorter = found is not None and b + 1 - a < found[1] - found[0]  # no part of a segment scores as much as it
                if total > 0 and (found is None or total > found[2] + 1e-9 or total > found[2] - 1e-9 and shorter):
                    found = (a, b + 1, total)
        return found

    def walk(lo, hi):
        if (f := best(lo, hi)) is None:
            return []
        return walk(lo, f[0]) + [f] + walk(f[1], hi)

    got = toxicity.segments(at, odds, drift)
    assert abs(sum(s for *_, s in got) - sum(s for *_, s in walk(0, len(marks)))) < 1e-6
    assert np.isclose(max((s for *_, s in got), default=0), max((s for *_, s in walk(0, len(marks))), default=0))


def test_passages_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(1)
    bad = ["vile", "scum", "filth", "rotten", "moron"]
    docs, labels = [], []
    for i in range(600):
        text = sentence(rng, 120).split()
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(100)
            text[at : at + 8] = [rng.choice(bad) for _ in range(8)]
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels[:400], "doc_id bigint, toxic int"))
    rows = toxicity.score(docs, model).where(F.col("doc_id") >= 400).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in rows)
    for r in rows:
        if r["doc_id"] % 5 == 0:
            assert any(p["end_word"] - p["first_word"] >= 6 for p in r["passages"])
        else:
            assert not r["passages"]


def test_scan_counts_words():
    got = list(toxicity.scan(pa.array(["a b  c", None, "", "bad, bad."]), toxicity.Model({"bad": 2.0})))
    assert [n for n, _ in got] == [3, 0, 0, 2]
    assert got[3][1] == [(0, 1, 2.0), (1, 2, 2.0)] or got[3][1] == [(0, 2, 4.0)]


def test_edges(messy, empty, labels):
    model = toxicity.fit(messy, labels)
    rows = toxicity.score(messy, model).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    nothing = toxicity.fit(empty, labels.limit(0))
    assert nothing.odds == {} and toxicity.score(empty, nothing).count() == 0
    assert all(r["score"] < 0.5 for r in toxicity.score(messy, nothing).collect())
