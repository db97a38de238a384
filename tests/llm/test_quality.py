from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm.common import crc_bucket
from tessera.llm.queries import op5_quality_classifier

from . import brute
from .test_rules import counts
from .test_toxicity import auc


def test_query(spark, sf, documents):
    rows = op5_quality_classifier(spark, sf).collect()
    assert len(rows) == documents.count()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r for r in rows if truth.get(r["doc_id"]) == 1]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)


def test_query_against_a_plain_refit(spark, sf, documents):
    docs = {r["doc_id"]: r for r in documents.collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] in (0, 1) and r["doc_id"] in docs}
    label = {}
    for i, y in truth.items():
        t = docs[i]["text"] or ""
        label[t] = min(y, label.get(t, 1))

    def grams(t):
        b = t.encode()
        return [(int.from_bytes(b[j : j + 4], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for j in range(len(b) - 3)]

    seen = [Counter(g for t, y in label.items() if y == c and not brute.fold(t, 4) for g in grams(t)) for c in (0, 1)]
    bad, good = (np.array([c[g] for g in range(1 << 16)], float) for c in seen)
    prior = (bad + good + 1) / (bad.sum() + good.sum() + (1 << 16))
    strength = 0.02 * min(bad.sum(), good.sum())
    odds = np.log((good + strength * prior) / (good.sum() + strength)) - np.log((bad + strength * prior) / (bad.sum() + strength))

    def evidence(t):
        g, (words, _, _, dup, repeat, _) = grams(t), counts(t)
        words = max(1, words)
        return [1.0, odds[g].sum() / max(1, len(g)), repeat / words, dup / max(1, t.count("\n")) if t else 0.0, np.log1p(words) / 5]

    curve = [(t, y) for t, y in label.items() if brute.fold(t, 4)]
    w = brute.logistic(np.array([evidence(t) for t, _ in curve]), np.array([y for _, y in curve], float), [1e-3, 0.05, 0.05, 0.05, 0.05])
    own = {i: float(np.clip(np.dot(evidence(r["text"] or ""), w), -12, 12)) for i, r in docs.items()}
    rows = {r["doc_id"]: r for r in op5_quality_classifier(spark, sf).collect()}
    logit = lambda p: np.log(p / (1 - p))
    mean = np.mean([1 / (1 + np.exp(-x)) for x in own.values()])
    shift = {i: logit(min(1 - 1e-6, max(1e-6, r["path_posterior"]))) - logit(mean) for i, r in rows.items()}
    told = [(own[i], shift[i], y) for i, y in truth.items() if brute.fold(docs[i]["text"] or "", 4)]
    best = max(np.linspace(0, 1, 2001), key=lambda v: sum(-np.logaddexp(0, -(1 if y else -1) * (o + v * s)) for o, s, y in told) - 2 * (v - 0.5) ** 2)
    for i, r in rows.items():
        assert abs(r["doc_score"] - 1 / (1 + np.exp(-own[i]))) < 1e-6
        assert abs(r["score"] - 1 / (1 + np.exp(-(own[i] + best * shift[i])))) < 2e-3


def test_labels_that_were_not_learnt(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality.classify(docs, quality.fit(docs, labels, crc_bucket("doc_id", 5) != 0)).where(crc_bucket("doc_id", 5) == 0).collect()
    assert auc([(r["score"], truth[r["doc_id"]]) for r in got if r["doc_id"] in truth]) >= 0.9


def test_sparse_sites_lean_on_what_lies_above(spark):
    """Posteriors of hosts of 1 to 200 documents: the fewer documents, the nearer to the global mean."""
    rng = random.Random(2)
    docs = [(1000 * h + i, "good words here" if rng.random() < 0.9 else "bad", f"h{h}", "p") for h, n in enumerate((1, 2, 5, 20, 200)) for i in range(n)]
    docs += [(10**6 + i, "bad" if rng.random() < 0.9 else "good words here", f"other{i % 40}", "p") for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string")
    model = quality.Model(np.zeros(quality.FEATURES), np.array([-2.0, 0, 0, 0, 8.0]))
    rows = quality.classify(df, model).join(df.select("doc_id", "source"), "doc_id").toPandas()
    mean = rows["doc_score"].mean()
    pull = [abs(rows[(rows.source == f"h{h}")]["host_posterior"] - mean).mean() for h in range(5)]
    assert pull[0] < 0.2 * pull[4] and pull[0] < pull[3] < pull[4]


def test_posteriors_against_the_formulas(spark, documents):
    """Host and path posteriors of every document, from the evidence alone."""
    model = quality.Model(np.zeros(quality.FEATURES), np.array([0.3, 0, 2.0, -1.0, 0.4]))
    rows = quality.classify(documents, model).join(documents.select("doc_id", "source", "lang"), "doc_id").toPandas()
    p, mean = rows["doc_score"], rows["doc_score"].mean()

    def strength(groups, center):
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / len(p)
        between = sum(len(g) * (g.mean() - c) ** 2 for g, c in zip(groups, center, strict=True)) / len(p)
        return max(1.0, min(1e4, within / max(between, 1e-9)))

    hosts = dict(list(rows.groupby("source")["doc_score"]))
    paths = dict(list(rows.groupby(["source", "lang"])["doc_score"]))
    of_host = strength(list(hosts.values()), [mean] * len(hosts))
    of_path = strength(list(paths.values()), [hosts[k[0]].mean() for k in paths])
    for r in rows.itertuples():
        h, q = hosts[r.source], paths[r.source, r.lang]
        host = (h.sum() - r.doc_score + of_host * mean) / (len(h) - 1 + of_host)
        path = (q.sum() - r.doc_score + of_path * host) / (len(q) - 1 + of_path)
        assert np.isclose(r.host_posterior, host) and np.isclose(r.path_posterior, path)


def test_sites_shift_uncertain_documents(spark):
    """The same text on a good and on a bad site: only the site differs."""
    rng = random.Random(1)
    word = lambda s: "".join(rng.choice(s) for _ in range(6))
    text = lambda s: " ".join(word(s) for _ in range(60))
    docs = [(i, text("abcde") if i % 2 else text("vwxyz"), "good" if i % 2 else "bad") for i in range(800)]
    mixed = text("abcdevwxyz")
    docs += [(5000, mixed, "good"), (5001, mixed, "bad"), (5002, mixed, "new")]
    df = spark.createDataFrame([(*d, "en") for d in docs], "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality.classify(df, quality.fit(df, labels)).collect()}
    assert got[5000]["doc_score"] == got[5001]["doc_score"]
    assert got[5000]["score"] > got[5002]["score"] > got[5001]["score"]


def test_edges(messy, empty, labels):
    model = quality.fit(messy, labels)
    rows = quality.classify(messy, model).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(empty, quality.fit(empty, labels.limit(0))).count() == 0
    assert {r["kept"] for r in quality.classify(messy, quality.fit(messy, labels.limit(0))).select((F.col("score") >= 0.5).alias("kept")).collect()} == {True}
