from __future__ import annotations

import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from math import exp, log

from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.queries import op10_language_id

from .brute import WORD


def test_query_held_out_accuracy(spark, sf, documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = op10_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held)


def plain(docs: list[tuple], learn) -> dict:
    """Every document's language and its share of the likelihood, by counting words and n-grams in plain Python."""
    letters = lambda w: "".join(c for c in w if unicodedata.category(c).startswith("L")).lower()
    counts = defaultdict(Counter)
    for i, t, lang in docs:
        if learn(i) and lang is not None:
            counts[lang].update(w for w in map(letters, WORD.findall(t or "")) if w)
    counts = {x: {w: k for w, k in c.items() if k > 1} for x, c in counts.items()}
    langs = sorted(counts)

    def pieces(w, n):
        w = f"^{w}$" if n > 1 else w
        return [w[i : i + n] for i in range(len(w) - n + 1)]

    tables = [counts]
    for n in (5, 4, 3, 2, 1):
        by = {x: Counter() for x in langs}
        for x in langs:
            for w, k in counts[x].items():
                for g in pieces(w, n):
                    by[x][g] += k
        tables.append(by)
    known = [{g for c in t.values() for g in c} for t in tables]
    total = [{x: log(sum(t[x].values()) + 0.5 * max(1, len(k))) for x in langs} for t, k in zip(tables, known, strict=True)]
    each = lambda n, g: [log(tables[n][x].get(g, 0) + 0.5) - total[n][x] for x in langs]

    @lru_cache(None)
    def word(w):
        if w in known[0]:
            return each(0, w)
        for level, n in enumerate((5, 4, 3, 2, 1), 1):
            found = [each(level, g) for g in pieces(w, n) if g in known[level]]
            if found:
                return [sum(v) / len(found) for v in zip(*found, strict=True)]
        return [0.0] * len(langs)

    out = {}
    for i, t, _ in docs:
        words = [w for w in map(letters, WORD.findall(t or "")) if w]
        if not words:
            out[i] = ("und", 0.0)
            continue
        sums = [sum(v) for v in zip(*map(word, words), strict=True)]
        shares = [exp(s - max(sums)) for s in sums]
        out[i] = (langs[sums.index(max(sums))], 1 / sum(shares))
    return out


def test_query_against_plain_counting(spark, sf, documents):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    want = plain(docs, lambda i: zlib.crc32(str(i).encode()) % 3 != 1)
    for r in op10_language_id(spark, sf).collect():
        lang, share = want[r["doc_id"]]
        assert abs(r["score"] - share) < 2e-3
        assert r["lang_pred"] == lang or share < 0.502


def test_known_words_come_before_grams():
    m = langid.Model({"aa": {"hello": 9, "well": 5}, "bb": {"hola": 9, "bien": 5}})
    assert m.word("Hello,").tolist() == m.words["hello"].tolist()
    assert m.word("hellos").argmax() == 0 and m.word("holas").argmax() == 1
    assert m.word("zzzz").tolist() == [0.0, 0.0] and m.word("123") is None


def test_edges(spark, messy, empty):
    model = langid.fit(messy)
    rows = langid.predict(messy, model).collect()
    assert len(rows) == messy.count()
    for r in rows:
        assert r["lang_pred"] in {"en", "de", "und"} and 0 <= r["score"] <= 1
        if r["doc_id"] in (0, 1, 2):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(messy, langid.fit(empty)).collect()} == {"und"}


def test_every_label_is_sampled(spark):
    docs = spark.createDataFrame([(i, f"word{i}", f"l{i}") for i in range(1200)], "doc_id bigint, text string, lang string")
    assert langid.sample(docs, F.lit(True), "doc_id", "text", "lang").select("_lang").distinct().count() == 1200
