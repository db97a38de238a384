"""Quality classifier by hierarchical empirical Bayes.

A classifier scores each document: hashed byte 4-gram log-odds of good against bad labelled text, with shares of repeated
words and lines, through a logistic curve (both from a bounded sample of labelled rows, ``ROWS_PER_CLASS``, the least
hashes of doc_id). Sites then add what their other documents say: a host's mean is shrunk toward the global mean, a
path's mean toward its host's, with strengths from the variance within and between groups. The last step adds to a
document's own log-odds those of its path, relative to the global ones, by a weight that labelled documents decide: the
classifier has seen some of a site's evidence already, so the two are not independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ARRAY_BYTES, intermediates, kept, mapped, materialize, per_text_sum, slices, text_bytes, word_hashes
from .lsh import few
from .rules import _features, duplicate_lines, repeated_words

ROWS_PER_CLASS = 10_000
#: Hash buckets of the classifier, which learns from a bounded sample.
FEATURES = 1 << 16

@dataclass
class Model:
    odds: np.ndarray
    weights: np.ndarray
    #: The labelled documents that the log-odds have not seen (_id, _y), for the weight of sites.
    curve: DataFrame | None = None

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """A row of features for each text."""
        raw, at = text_bytes(texts)
        bucket, grams = _features(raw, at, FEATURES)
        ratio = per_text_sum(self.odds[bucket], grams) / np.maximum(np.diff(grams), 1)
        hashes, offsets = word_hashes(texts)
        words = np.maximum(np.diff(offsets), 1)
        lines = np.array([duplicate_lines(t) / max(1, t.count("\n")) if t else 0.0 for t in texts.to_pylist()])
        return np.column_stack([np.ones(len(texts)), ratio, repeated_words(hashes, offsets) / words, lines, np.log1p(words) / 5])

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        return np.clip(self.evidence(texts) @ self.weights, -12, 12)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """``learnable`` is a predicate on labels (default: all). Without both classes every document has even odds."""
    known = labels.where((F.lit(True) if learnable is None else learnable) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    some = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(ROWS_PER_CLASS) for y in (0, 1)]
    ids = some[0].unionByName(some[1])
    fold = F.pmod(F.xxhash64("_text", F.lit("fold")), F.lit(4)) == 0  # equal texts lie in one fold
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id")
    curve = materialize(rows.where(fold).groupBy("_id").agg(F.min("_y").alias("_y")), "curve")
    rows = rows.groupBy("_text").agg(F.min("_y").alias("_y")).withColumn("_fold", fold)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FEATURES), np.int64)
        for batch in slices(batches, "_text", ARRAY_BYTES):
            bucket, at = _features(*text_bytes(batch.column("_text")), FEATURES)
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            learn = ~batch.column("_fold").to_numpy(zero_copy_only=False).astype(bool)
            for c in (0, 1):
                total[c] += np.bincount(bucket[np.repeat(learn & (y == c), np.diff(at))], minlength=FEATURES)
        used = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[0][used]), pa.array(total[1][used])], names=["bucket", "bad", "good"])

    found = mapped(rows, count, "bucket int, bad bigint, good bigint").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    bad, good = np.zeros(FEATURES), np.zeros(FEATURES)
    bad[found["bucket"]], good[found["bucket"]] = found["bad"], found["good"]
    if not bad.sum() or not good.sum():
        return Model(np.zeros(FEATURES), np.zeros(5))
    prior = (bad + good + 1) / (bad.sum() + good.sum() + FEATURES)
    strength = 0.02 * min(bad.sum(), good.sum())
    odds = np.log((good + strength * prior) / (good.sum() + strength)) - np.log((bad + strength * prior) / (bad.sum() + strength))
    model = Model(odds, np.zeros(5))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", ARRAY_BYTES):
            x = model.evidence(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("_y"), *(pa.array(x[:, i]) for i in range(5))], names=["y", *"abcde"])

    seen = mapped(rows.where("_fold"), features, "y int, a double, b double, c double, d double, e double").toPandas()
    y, x = seen["y"].to_numpy(float), seen[list("abcde")].to_numpy(float)
    w, ridge = np.zeros(5), np.diag([1e-3, 0.05, 0.05, 0.05, 0.05])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(odds, w, curve)


def _site_weight(joined: DataFrame, curve: DataFrame | None, id_col: str) -> float:
    """How much of a site's log-odds (_shift) adds to a document's own (_own): the most likely weight of the labelled
    documents, from 0 to 1, under a normal prior around 1/2."""
    if curve is None:
        return 0.5
    seen = joined.select(F.col(id_col).alias("_id"), "_own", "_shift").join(F.broadcast(curve), "_id").toPandas()  # a bounded sample
    own, shift, y = (seen[c].to_numpy(float) for c in ("_own", "_shift", "_y"))
    w = 0.5
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(own + w * shift, -30, 30)))
        step = (float((shift * (y - p)).sum()) - 4 * (w - 0.5)) / (float((shift * shift * p * (1 - p)).sum()) + 4)
        w = min(1.0, max(0.0, w + step))
    return w


def _strength(groups: DataFrame, mean: Column) -> Column:
    """Pseudo-count of a prior: variance within groups over variance between them (n, s, q: count, sum, sum of squares)."""
    within = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.sum("n")
    between = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)) / F.sum("n")
    return F.greatest(F.lit(1.0), F.least(F.lit(1e4), within / F.greatest(between, F.lit(1e-9))))


def classify(docs: DataFrame, model: Model, host: Column | str = "source", path: Column | str = "lang", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each document: id_col, doc_score, host_posterior, path_posterior, score, kept.

    ``host`` and ``path`` name a document's site, a path counting within its host; nulls form a site of their own. Null
    texts are scored as empty ones; texts of any length are read whole; repeated rows each have a row; an empty table gives no
    rows; other columns are ignored."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    source = docs.select(F.col(id_col), F.col(text_col).alias("_text"), F.coalesce(as_column(host).cast("string"), F.lit("\0")).alias("_host"), F.coalesce(as_column(path).cast("string"), F.lit("\0")).alias("_path"))
    kind = source.schema[id_col].dataType.simpleString()
    classifier = Model(model.odds, model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", ARRAY_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("_host"), batch.column("_path"), pa.array(classifier.log_odds(batch.column("_text")))], names=[id_col, "_host", "_path", "_own"])

    scored = mapped(source, run, f"`{id_col}` {kind}, _host string, _path string, _own double")
    scored = materialize(scored.withColumn("_p", 1 / (1 + F.exp(-F.col("_own")))), "evidence")
    with intermediates():
        sums = [F.count("*").alias("n"), F.sum("_p").alias("s"), F.sum(F.col("_p") * F.col("_p")).alias("q")]
        paths = materialize(scored.groupBy("_host", "_path").agg(*sums), "paths")
        hosts = materialize(paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), "hosts")
        whole = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
        mean = 0.5 if whole is None else min(1 - 1e-6, max(1e-6, whole))
        of_host = hosts.agg(_strength(hosts, F.lit(mean))).first()[0] or 1.0
        hosts = hosts.select("_host", F.col("n").alias("_hn"), F.col("s").alias("_hs"))
        paths = paths.join(hosts, "_host")
        of_path = paths.agg(_strength(paths, F.col("_hs") / F.col("_hn"))).first()[0] or 1.0
        paths = kept(materialize(paths.select("_host", "_path", F.col("n").alias("_n"), F.col("s").alias("_s"), "_hn", "_hs"), "sites"))

    joined = scored.join(few(paths), ["_host", "_path"])  # of many sites a hot one is split by Spark
    own = F.col("_p")  # a document's own score is no evidence of its site
    host_mean = (F.col("_hs") - own + of_host * mean) / (F.col("_hn") - 1 + of_host)
    path_mean = (F.col("_s") - own + of_path * host_mean) / (F.col("_n") - 1 + of_path)
    safe = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), path_mean))
    joined = joined.withColumn("_shift", F.log(safe / (1 - safe)) - float(np.log(mean / (1 - mean))))
    score = 1 / (1 + F.exp(-(F.col("_own") + _site_weight(joined, model.curve, id_col) * F.col("_shift"))))
    return joined.select(id_col, own.alias("doc_score"), host_mean.alias("host_posterior"), path_mean.alias("path_posterior"), score.alias("score"), (score >= threshold).alias("kept"))
