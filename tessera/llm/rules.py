"""Quality rules: exact counts of each text, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Character (UTF-8 byte) 4-grams fall into hash buckets, whose number grows with the cube root of the corpus (``buckets_for``).
Raw counts come from every document, trusted ones from every document that a label marks as good. A document's score is
the mean log ratio of its n-grams under the two smoothed multinomials; it stays if no base rule fails and the score is
``THRESHOLD`` or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARRAY_BYTES, intermediates, mapped, materialize, mix, per_text_sum, slices, text_bytes, word_hashes
from .lsh import few

GRAM = 4
#: Buckets for each cube root of a byte of text; at least ``LEAST_BITS`` bits of them. 2**18 for 0.5 GB, 2**20 for 30 GB, 2**24
#: (128 MB) for 100 TB.
BUCKETS, LEAST_BITS = 256, 16
THRESHOLD = -0.4
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CHAR_START = (np.arange(256) & 0xC0) != 0x80
_CHAR = ~_BLANK & _CHAR_START
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def repeated_words(hashes: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """For each text, the words that lie in windows of ``width`` words found twice or more in it."""
    n = len(hashes)
    if n < width:
        return np.zeros(len(offsets) - 1, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = mix(text[: n - width + 1].astype(np.uint64))
    for j in range(width):
        key = key * np.uint64(0x100000001B3) ^ hashes[j : n - width + 1 + j]
        key = key ^ (key >> np.uint64(29))
    inside = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    key = key[inside]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = np.zeros(len(key), bool)
    if len(key) > 1:
        twin = sorted_key[1:] == sorted_key[:-1]
        same[1:] |= twin
        same[:-1] |= twin
    starts = inside[order[same]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return per_text_sum((np.cumsum(edge[:n]) > 0).astype(np.int64), offsets)


def duplicate_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def buckets_for(text_bytes: int) -> int:
    """A power of two."""
    return 1 << max(LEAST_BITS, int(BUCKETS * text_bytes ** (1 / 3)).bit_length())


def _features(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all ``GRAM``-byte grams one text after another, and the n + 1 offsets of the texts among them."""
    n = len(raw) - GRAM + 1
    counts = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    if n <= 0:
        return np.zeros(0, np.int32), at * 0
    code = raw[:n].astype(np.uint32)
    for j in range(1, GRAM):
        code = (code << np.uint32(8)) | raw[j : n + j]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(33 - buckets.bit_length())).astype(np.int32)
    inside = np.ones(n, bool)
    for j in range(1, GRAM):  # grams that would run into the next text
        cut = offsets[1:-1] - j
        inside[cut[(cut >= 0) & (cut < n)]] = False
    short = np.flatnonzero(np.diff(offsets) < GRAM)
    for i in short:
        inside[offsets[i] : offsets[i + 1]] = False
    return bucket[inside], at


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """The log ratio of each bucket, from all documents and all trusted ones; zeros without trusted text."""
    with intermediates():
        return _fit(docs, labels, id_col, text_col, label_col)


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> np.ndarray:
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = buckets_for(size)
    trusted = few(materialize(labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct(), "trusted"))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    source = source.join(trusted.withColumn("_trusted", F.lit(True)), "_id", "left").select("_text", F.coalesce("_trusted", F.lit(False)).alias("_trusted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in slices(batches, "_text", ARRAY_BYTES):
            bucket, at = _features(*text_bytes(batch.column("_text")), buckets)
            raw += np.bincount(bucket, minlength=buckets)
            mark = batch.column("_trusted").to_numpy(zero_copy_only=False).astype(bool)
            if mark.any():
                good += np.bincount(bucket[np.repeat(mark, np.diff(at))], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    found = mapped(source, count, "bucket int, raw bigint, good bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[found["bucket"]], good[found["bucket"]] = found["raw"], found["good"]
    if not good.sum():
        return np.zeros(buckets)
    # the raw multinomial smooths the trusted one, so that a bucket neither has seen says nothing
    prior = (raw + 1) / (raw.sum() + buckets)
    strength = 0.02 * float(good.sum())
    return np.log((good + strength * prior) / (good.sum() + strength)) - np.log(prior)


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: id_col, ``carry``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr,
    base_failed, kept. A null text counts as empty and fails the base rules; repeated rows each have a row; texts of any length
    are counted whole; an empty table gives no rows; other columns are ignored."""
    source = docs.select(id_col, text_col, *[c for c in carry if c not in (id_col, text_col)])
    lead = [id_col, *carry]
    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in lead)
    schema = f"{fields}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, llr double, base_failed boolean, kept boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, ARRAY_BYTES):
            texts = batch.column(text_col)
            hashes, offsets = word_hashes(texts)
            raw, at = text_bytes(texts)
            words = np.diff(offsets)
            repeat = repeated_words(hashes, offsets)
            bucket, grams = _features(raw, at, len(shared.value))
            ratio = per_text_sum(shared.value[bucket], grams) / np.maximum(np.diff(grams), 1)
            failed = (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words)
            lines = np.array([duplicate_lines(t) for t in texts.to_pylist()], np.int64)
            columns = [*(batch.column(c) for c in lead), *map(pa.array, (words, per_text_sum(_CHAR[raw], at), per_text_sum(_SYMBOL[raw], at), lines, repeat, ratio, failed, ~failed & (ratio >= threshold)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*lead, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"])

    return mapped(source, run, schema)


def keep(docs: DataFrame, model: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns, whatever their names. Null and empty texts go; an empty table
    stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, ARRAY_BYTES):
            texts = batch.column(text_col)
            hashes, offsets = word_hashes(texts)
            words = np.diff(offsets)
            bucket, grams = _features(*text_bytes(texts), len(shared.value))
            ratio = per_text_sum(shared.value[bucket], grams) / np.maximum(np.diff(grams), 1)
            failed = (words < MIN_WORDS) | (100 * repeated_words(hashes, offsets) > MAX_REPEAT_PERCENT * words)
            yield batch.filter(pa.array(~failed & (ratio >= threshold)))

    return mapped(docs, run, docs.schema)
