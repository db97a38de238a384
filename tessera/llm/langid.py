"""Language identification: known words first, then ever shorter character n-grams for unseen words.

The model is fitted on a bounded sample of labelled rows: about ``ROWS_PER_LANG`` rows of each language, taken by a hash
of doc_id, of which the ``WORDS_PER_LANG`` most frequent words of each language are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, mapped, slices, split_words

ROWS_PER_LANG = 4_000
WORDS_PER_LANG = 30_000
ORDERS = (5, 4, 3, 2, 1)
CACHE_WORDS = 200_000
_NOT_LETTER = regex.compile(r"\P{L}+")


def _clean(token: str) -> str:
    return token.lower() if token.isalpha() else _NOT_LETTER.sub("", token).lower()


def _grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def sample(docs: DataFrame, learnable: Column, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.where(learnable & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    share = rows.groupBy("_lang").count().select("_lang", (F.lit(ROWS_PER_LANG * 1e6) / F.col("count")).alias("_share"))
    return rows.join(F.broadcast(share), "_lang").where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.col("_share"))


class Model:
    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        self.words = self._table(counts)
        self.grams = []
        for n in ORDERS:
            by_lang = {}
            for lang, words in counts.items():
                c: Counter[str] = Counter()
                for w, k in words.items():
                    for g in _grams(w, n):
                        c[g] += k
                by_lang[lang] = dict(c.most_common(WORDS_PER_LANG))
            self.grams.append(self._table(by_lang))
        self._cache: dict[str, np.ndarray] = {}

    def _table(self, counts: dict[str, dict[str, int]]) -> dict[str, np.ndarray]:
        known = {g for c in counts.values() for g in c}
        total = [log(sum(counts[x].values()) + 0.5 * max(1, len(known))) for x in self.langs]
        return {g: np.array([log(counts[x].get(g, 0) + 0.5) - t for x, t in zip(self.langs, total, strict=True)], np.float32) for g in known}

    def word(self, token: str) -> np.ndarray | None:
        """The log frequency of a token under each language; None if it has no letter."""
        w = _clean(token)
        if not w:
            return None
        if (known := self.words.get(w)) is not None:
            return known
        for n, table in zip(ORDERS, self.grams, strict=True):
            found = [table[g] for g in _grams(w, n) if g in table]
            if found:
                return sum(found) / len(found)
        return np.zeros(len(self.langs), np.float32)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of distinct tokens, and which of them have a letter."""
        out, has, cache = np.zeros((len(words), len(self.langs)), np.float32), np.zeros(len(words), bool), self._cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for i, w in enumerate(words):
            if w in cache:
                got = cache[w]
            else:
                got = cache[w] = self.word(w)
            if got is not None:
                out[i], has[i] = got, True
        return out, has


def fit(docs: DataFrame, learnable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """``learnable`` picks the rows to learn from (default: all). Without any labelled row the model knows no language."""
    rows = sample(docs, F.lit(True) if learnable is None else learnable, id_col, text_col, lang_col).select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words, codes, offsets = split_words(batch.column("_text"))
            lang = batch.column("_lang").to_pylist()
            clean = [_clean(w) for w in words.to_pylist()]
            total: Counter[tuple[str, str]] = Counter()
            kinds = sorted(set(lang))
            of = np.repeat(np.array([kinds.index(x) for x in lang]), np.diff(offsets))
            for k, kind in enumerate(kinds):
                n = np.bincount(codes[of == k], minlength=len(words))
                for i in np.flatnonzero(n):
                    if clean[i]:
                        total[kind, clean[i]] += int(n[i])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total]), pa.array([w for _, w in total]), pa.array(list(total.values()), pa.int64())], schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    words = mapped(rows, count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for lang, part in words.where("n > 1").toPandas().groupby("lang"):  # as large as the bounded sample at most
        part = part.sort_values(["n", "word"], ascending=[False, True]).head(WORDS_PER_LANG)
        counts[lang] = dict(zip(part["word"], part["n"].astype(int), strict=True))
    return Model(counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, lang_pred, score. ``und`` with score 0 for a null text, a text without a letter
    or an empty model; texts of any length are read whole; repeated rows each have a row; an empty table gives no rows; other
    columns are ignored."""
    source = docs.select(id_col, text_col)
    schema = f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, lang_pred string, score double"
    langs = model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            words, codes, offsets = split_words(batch.column(text_col))
            each, has = model.rows(words.to_pylist())
            n = batch.num_rows
            of = np.repeat(np.arange(n), np.diff(offsets))
            letters = np.bincount(of, weights=has[codes], minlength=n)
            if langs:
                total = np.stack([np.bincount(of, weights=each[codes, k], minlength=n) for k in range(len(langs))], 1)
                part = np.exp(total - total.max(1, keepdims=True))
                best, share = total.argmax(1), part.max(1) / part.sum(1)
            known = (letters > 0) & bool(langs)
            pred = [langs[best[i]] if known[i] else "und" for i in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(pred, pa.string()), pa.array(np.where(known, share, 0.0) if langs else np.zeros(n))], names=[id_col, "lang_pred", "score"])

    return mapped(source, run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return crc_bucket(id_col, 3) == 1
