"""Toxicity by maximum-scoring segments of token log-odds.

A token's features are the word itself and its beginnings (stems). They score by the log-odds of toxic against clean
labelled documents under an informative Dirichlet prior; a token has the score of its best feature, and a small negative
drift if none is significant. A linear-time scan finds all maximal segments of a
text. The best segment's score is normalised by the extreme-value law of such scores: lambda is Karlin and Altschul's under
the clean background, K the most likely one for the best scores of clean texts. A logistic curve turns it into a probability.

All fits use a bounded sample of labelled rows (``ROWS_PER_CLASS``, the least hashes of doc_id): four fifths of its texts give
the log-odds, one fifth K and the curve. Of equal texts with several labels the greatest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, split_words

ROWS_PER_CLASS = 10_000
PRIOR_STRENGTH = 500.0
MIN_Z, MIN_DOCS = 4.5, 4
STEMS = range(4, 9)
MIN_ODDS = 1.5
DRIFT = 0.1
P_VALUE = 0.05
_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…’‘“”«»¡¿"


def clean(token: str) -> str:
    return token.strip(_TRIM).lower()


def features(token: str) -> list[str]:
    """The cleaned word and its stems."""
    word = clean(token)
    return [word, *(f"{word[:k]}*" for k in STEMS if k < len(word))] if word else []


def segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score) of a text whose words score ``score`` at ``at`` (ascending,
    positive) and ``-drift`` elsewhere; Ruzzo and Tompa's linear-time scan over the positive words."""
    stack: list[list] = []  # first, end, sum before, sum after
    total, last = 0.0, 0
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (p - last)
        new = [p, p + 1, total, total + s]
        total, last = total + s, p + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(a, b, r - lo) for a, b, lo, r in stack]


@dataclass
class Model:
    odds: dict[str, float]
    drift: float = DRIFT
    lam: float = 1.0
    k: float = 0.1
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)

    def token(self, token: str) -> float:
        word, get = clean(token), self.odds.get
        best = get(word, 0.0)
        for k in STEMS:
            if k >= len(word):
                break
            best = max(best, get(f"{word[:k]}*", 0.0))
        return best

    def p_value(self, score: float, words: int) -> float:
        return -np.expm1(-self.k * max(1, words) * exp(-min(700.0, self.lam * score)))

    def features(self, found: list[tuple[int, int, float]], words: int) -> tuple[float, float, float]:
        best = max((s for _, _, s in found), default=0.0)
        if best <= 0:
            return 0.0, 0.0, 0.0
        normal = self.lam * best - log(self.k * max(1, words))
        return min(30.0, max(-10.0, normal)) / 10 + 1, min(30.0, best) / 10, log(1 + sum(self.p_value(s, words) <= P_VALUE for _, _, s in found))

    def probability(self, features: tuple[float, ...]) -> float:
        z = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], features, strict=True))
        return 1 / (1 + exp(-max(-50.0, min(50.0, z))))


def scan(texts: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """The number of words and the maximal segments of each text."""
    words, codes, offsets = split_words(texts)
    each = np.array([model.token(w) for w in words.to_pylist()]) if len(words) else np.zeros(0)
    value = each[codes]
    hot = np.flatnonzero(value > 0)
    cut = np.searchsorted(hot, offsets)
    for i in range(len(offsets) - 1):
        mine = hot[cut[i] : cut[i + 1]]
        yield int(offsets[i + 1] - offsets[i]), segments(mine - offsets[i], value[mine], model.drift) if len(mine) else []


def labelled(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """The bounded sample, each text once: _text, _y, _fold (True: for K and the curve)."""
    known = labels.where(learnable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    some = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(ROWS_PER_CLASS) for y in (0, 1)]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some[0].unionByName(some[1])), "_id")
    return rows.groupBy("_text").agg(F.max("_y").alias("_y")).withColumn("_fold", F.pmod(F.xxhash64("_text", F.lit("fold")), F.lit(5)) == 0)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """``learnable`` is a predicate on labels (default: all). Without labels every text scores low."""
    rows = labelled(docs, labels, F.lit(True) if learnable is None else learnable, id_col, text_col, label_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words, codes, offsets = split_words(batch.column("_text"))
            index: dict[str, int] = {}
            listed = [[index.setdefault(f, len(index)) for f in features(w)] for w in words.to_pylist()]
            n = batch.num_rows
            of = np.repeat(np.arange(n), np.diff(offsets))
            size = np.array([len(x) for x in listed], np.int64)
            start = np.concatenate([[0], np.cumsum(size)])
            flat = np.array([i for x in listed for i in x], np.int64)
            doc = np.repeat(of, size[codes])
            within = np.arange(len(doc)) - np.repeat(np.cumsum(size[codes]) - size[codes], size[codes])
            feature = flat[np.repeat(start[codes], size[codes]) + within] if len(doc) else flat[:0]
            toxic = batch.column("_y").to_numpy(zero_copy_only=False) == 1
            learn = ~batch.column("_fold").to_numpy(zero_copy_only=False).astype(bool)
            once = np.unique(doc * np.int64(len(index) + 1) + feature)
            d1, f1 = once // (len(index) + 1), once % (len(index) + 1)
            parts = [np.bincount(f[learn[d] & (toxic[d] == c)], minlength=len(index)) for c in (True, False) for d, f in ((doc, feature), (d1, f1))]
            yield pa.RecordBatch.from_arrays([pa.array(list(index), pa.string()), *map(pa.array, parts)], names=["feature", "t1", "d1", "t0", "d0"])

    source = mapped(rows, count, "feature string, t1 bigint, d1 bigint, t0 bigint, d0 bigint")
    counts = source.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("t1", "d1", "t0", "d0")])
    size = rows.where("not _fold").groupBy("_y").count().collect()
    docs_of = {r["_y"]: float(r["count"]) for r in size}
    words_of = counts.where("feature not like '%*'").agg(F.sum("t1"), F.sum("t0")).first()
    counts = counts.where(F.col("d1") >= MIN_DOCS).toPandas()  # features of the bounded sample
    if not len(counts) or not docs_of.get(0) or not docs_of.get(1):
        return Model({})
    n1, n0, m1, m0 = float(words_of[0]), float(words_of[1]), docs_of[1], docs_of[0]

    def log_odds(y1, y0, n1, n0):
        prior = PRIOR_STRENGTH * (y1 + y0) / (n1 + n0)
        rest = np.maximum(n1 + PRIOR_STRENGTH - y1 - prior, 1.0), np.maximum(n0 + PRIOR_STRENGTH - y0 - prior, 1.0)
        return np.log((y1 + prior) / rest[0]) - np.log((y0 + prior) / rest[1]), prior

    t1, d1, t0, d0 = (counts[c].to_numpy(float) for c in ("t1", "d1", "t0", "d0"))
    z = _significance(d1, d0, m1, m0)  # by documents: words come in bursts
    odds, prior = log_odds(t1, t0, n1, n0)
    use = (z >= MIN_Z) & (odds > MIN_ODDS)
    model = Model(dict(zip(counts["feature"][use], odds[use].tolist(), strict=True)))
    share = (t0[use] + prior[use]) / (n0 + PRIOR_STRENGTH)
    share = share / max(1.0, 2 * share.sum())  # stems of one word count its tokens more than once
    model.drift = max(DRIFT, 2 * float((share * odds[use]).sum()))
    model.lam = _lambda(odds[use], share, model.drift)
    return _calibrate(rows.where("_fold"), model)


def _significance(d1: np.ndarray, d0: np.ndarray, m1: float, m0: float) -> np.ndarray:
    """Signed root of the likelihood ratio statistic of d1 of m1 toxic against d0 of m0 clean documents."""

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    share = (d1 + d0) / (m1 + m0)
    g = part(d1, m1 * share) + part(d0, m0 * share) + part(m1 - d1, m1 * (1 - share)) + part(m0 - d0, m0 * (1 - share))
    return np.sign(d1 / m1 - d0 / m0) * np.sqrt(np.maximum(0, 2 * g))


def _lambda(odds: np.ndarray, share: np.ndarray, drift: float) -> float:
    """The positive root of E[exp(lambda * score)] = 1 under the background."""
    if not len(odds):
        return 1.0
    low, high = 1e-3, 50.0
    for _ in range(80):
        middle = (low + high) / 2
        value = (1 - share.sum()) * np.exp(-middle * drift) + (share * np.exp(np.minimum(700, middle * odds))).sum()
        low, high = (middle, high) if value < 1 else (low, middle)
    return (low + high) / 2


def _fit_k(rows: DataFrame, model: Model) -> float:
    """The most likely K for the best scores x of clean texts of n words: n * exp(-lambda * x) is exponential with rate K, and
    at least n where no token scores."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            got = [(n, max((s for *_, s in found), default=0.0)) for n, found in scan(batch.column("_text"), model) if n]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], names=["n", "x"])

    seen = mapped(rows.where("_y = 0"), best, "n bigint, x double").toPandas()
    x = seen["x"].to_numpy(float)
    total = float((seen["n"].to_numpy(float) * np.exp(-np.minimum(700.0, model.lam * x))).sum())
    return max(0.5, float((x > 0).sum())) / total if total > 0 else model.k


def _calibrate(rows: DataFrame, model: Model) -> Model:
    model.k = _fit_k(rows, model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            got = [(n, *model.features(found, n)) for n, found in scan(batch.column("_text"), model)]
            yield pa.RecordBatch.from_arrays([batch.column("_y"), *(pa.array([float(g[i]) for g in got]) for i in range(4))], names=["y", "n", "a", "b", "c"])

    seen = mapped(rows, best, "y int, n double, a double, b double, c double").toPandas()
    y, x = seen["y"].to_numpy(float), np.column_stack([np.ones(len(seen)), seen[["a", "b", "c"]].to_numpy(float)])
    w, ridge = np.zeros(4), np.diag([1e-3, 0.1, 0.1, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    if len(seen):
        model.weights = tuple(w.tolist())
    return model


PASSAGE = "struct<first_word:int,end_word:int,score:double,p_value:double>"
_PASSAGES = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, score (0 to 1), passages (its significant segments, by word number).

    Null, empty and clean texts have the score of a text without a toxic word; texts of any length are scanned whole; repeated
    rows each have a row; an empty table gives no rows; other columns are ignored."""
    source = docs.select(id_col, text_col)
    schema = f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, score double, passages array<{PASSAGE}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            value, passages = [], []
            for n, found in scan(batch.column(text_col), model):
                value.append(model.probability(model.features(found, n)))
                passages.append([{"first_word": a, "end_word": b, "score": s, "p_value": p} for a, b, s in found if (p := model.p_value(s, n)) <= P_VALUE])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(value), pa.array(passages, _PASSAGES)], names=[id_col, "score", "passages"])

    return mapped(source, run, schema)
