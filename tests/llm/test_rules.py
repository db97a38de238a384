from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import rules
from tessera.llm.queries import op7_quality_rules

from .brute import WORD
from .conftest import sentence


def counts(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    repeat = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    failed = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), failed


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query_verdicts(spark, sf, documents):
    """The ratio and the verdict of every document, recomputed from the texts alone."""
    from math import log

    text = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    good_ids = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    size = sum(map(len, text.values()))
    bits = max(16, int(256 * size ** (1 / 3)).bit_length())
    grams = {i: [(int.from_bytes(t[j : j + 4], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits) for j in range(len(t) - 3)] for i, t in text.items()}
    raw, good = Counter(g for v in grams.values() for g in v), Counter(g for i in good_ids for g in grams[i])
    n_raw, n_good = raw.total() + (1 << bits), good.total()
    strength = 0.02 * n_good

    def ratio(g):
        prior = (raw[g] + 1) / n_raw
        return log((good[g] + strength * prior) / (n_good + strength)) - log(prior)

    each = {g: ratio(g) for g in raw}
    for r in op7_quality_rules(spark, sf).collect():
        mine = grams[r["doc_id"]]
        want = sum(each[g] for g in mine) / max(1, len(mine))
        assert abs(r["llr"] - want) < 1e-6
        assert r["kept"] == (not r["base_failed"] and want >= rules.THRESHOLD)


def test_the_model_grows_with_the_corpus():
    sizes = [rules.buckets_for(n) for n in (0, 10**6, 10**8, 10**9, 3 * 10**10, 10**14)]
    assert sizes == sorted(sizes) and sizes[0] == 1 << 16 and sizes[-1] >= 64 * sizes[2]


def test_query_counts(spark, sf, documents):
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = op7_quality_rules(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert tuple(r[f] for f in FIELDS) == counts(text[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x1c\x85 é#|", max_size=60), min_size=1, max_size=4))
def test_counts_of_any_texts(texts):
    import pyarrow as pa

    from tessera.llm.common import per_text_sum, text_bytes, word_hashes

    column = pa.array(texts, pa.string())
    hashes, offsets = word_hashes(column)
    raw, at = text_bytes(column)
    got = zip(np.diff(offsets), per_text_sum(rules._CHAR[raw], at), per_text_sum(rules._SYMBOL[raw], at), [rules.duplicate_lines(t) for t in texts], rules.repeated_words(hashes, offsets), strict=True)
    assert [tuple(map(int, g)) for g in got] == [counts(t)[:5] for t in texts]


def test_ratio_is_the_mean_log_ratio():
    rng = np.random.default_rng(0)
    model = rng.normal(size=1 << 16)
    texts = ["abcdefgh", "", "abc", "été déjà"]
    import pyarrow as pa

    from tessera.llm.common import text_bytes

    bucket, at = rules._features(*text_bytes(pa.array(texts)), len(model))
    for i, t in enumerate(texts):
        raw = t.encode()
        want = [((int.from_bytes(raw[j : j + 4], "big") * 0x9E3779B1) & 0xFFFFFFFF) >> 16 for j in range(len(raw) - 3)]
        assert bucket[at[i] : at[i + 1]].tolist() == want


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(1)
    good = [(i, sentence(rng, 80), 1) for i in range(300)]
    junk = [(1000 + i, "".join(chr(rng.choice([*range(33, 48), *range(58, 64)])) if c == " " else c for c in "#$%".join(str(rng.random()) for _ in range(40))) + " x" * 25, 0) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + junk], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good[:150]], "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in rules.score(docs, rules.fit(docs, labels)).where("kept").collect()}
    assert {i for i, _, _ in good} <= kept and not kept & {i for i, _, _ in junk}


def test_clean_labelled_documents_stay(spark, sf, documents):
    got = {r["doc_id"]: r for r in op7_quality_rules(spark, sf).collect()}
    good = [r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()]
    passed = [i for i in good if not got[i]["base_failed"]]
    assert sum(got[i]["kept"] for i in passed) >= 0.99 * len(passed)


def test_edges(messy, empty, labels):
    model = rules.fit(messy, labels)
    rows = rules.score(messy, model).collect()
    assert len(rows) == messy.count()
    texts = defaultdict(set)
    for r in messy.collect():
        texts[r["doc_id"]].add(counts(r["text"]))
    assert all(tuple(r[f] for f in FIELDS) in texts[r["doc_id"]] for r in rows)
    kept = rules.keep(messy, model)
    assert kept.columns == messy.columns and kept.count() == sum(r["kept"] for r in rows)
    assert rules.score(empty, rules.fit(empty, labels.limit(0))).count() == 0
    assert not rules.fit(messy, labels.limit(0)).any()
