from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from tessera.llm import decontam
from tessera.llm.queries import op2_decontamination

from .conftest import sentence


def words(text: str | None) -> list[str]:
    return [w for w in (text or "").lower().replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]


def grams(w, k: int) -> list[tuple]:
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute(docs: list[tuple], items: list[tuple], threshold: float = 0.8) -> dict[tuple, float]:
    """The best similarity of any window, weighted or plain, for all texts and items."""
    items = sorted({(i, tuple(words(t))) for i, t in items if i is not None and words(t)})
    holders = defaultdict(set)
    for _, w in items:
        for g in grams(w, min(5, len(w))):
            holders[g].add(w)
    weight = {g: 1 / len(h) for g, h in holders.items()}
    out = {}
    for d, t in docs:
        w = tuple(words(t))
        present = set(grams(w, 5))
        for i, iw in items:
            k = min(5, len(iw))
            want = Counter(grams(iw, k))
            if k < 5:
                if set(grams(w, k)) & set(want):
                    out[d, i] = 1.0
                continue
            if not present & set(want):
                continue
            size = len(iw) - 4
            all_grams = grams(w, 5)
            best = 0.0
            for a in range(max(1, len(all_grams) - size + 1)):
                have = Counter(all_grams[a : a + size])
                both = {*have, *want}
                for of in (lambda g: weight.get(g, 1.0), lambda g: 1):
                    low = sum(of(g) * min(have[g], want[g]) for g in both)
                    high = sum(of(g) * max(have[g], want[g]) for g in both)
                    best = max(best, low / high)
            if best >= threshold - 1e-9:
                out[d, i] = max(best, out.get((d, i), 0.0))
    return out


def found(df) -> dict[tuple, float]:
    return {(r["doc_id"], r["item_id"]): r["similarity"] for r in df.collect()}


def same(got, want) -> None:
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_query(spark, sf, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    same(found(op2_decontamination(spark, sf)), brute(docs, items))


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(1)
    items = [(i, sentence(rng, n)) for i, n in enumerate([5, 9, 20, 33, 60, 120, 1, 3])] + [(50, None), (51, " ")]
    docs = []
    for i in range(60):
        body = sentence(rng, 150).split()
        w = items[i % 8][1].split()
        if i % 3:
            w = list(w)
            for _ in range(i % 3):
                w[rng.randrange(len(w))] = "changed"
        at = rng.randrange(150)
        docs.append((i, " ".join(body[:at] + (w if i % 4 else w[: len(w) // 2]) + body[at:])))
    return docs, items


def test_planted(spark, planted):
    docs, items = planted
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert want
    same(found(decontam.contaminated(d, b)), want)


def test_large_benchmarks_are_not_broadcast(spark, planted, monkeypatch):
    docs, items = planted
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", 0)
    same(found(decontam.contaminated(d, b)), brute(docs, items))


def test_edges(spark, messy, empty):
    bench = spark.createDataFrame([(1, messy.where("doc_id = 5").first()["text"]), (1, None), (2, ""), (None, "one"), (3, "two words")], "item_id bigint, text string")
    assert found(decontam.contaminated(messy, bench)).keys() == {(i, 1) for i in (5, 6, 7, 8, 10**12)} | {(4, 3)}
    clean = decontam.decontaminate(messy, bench)
    assert clean.columns == messy.columns
    left = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in clean.collect())
    assert left == sorted([(False, i) for i in (0, 0, 1, 2, 3, 9, 10, 11, 12, 13)] + [(True, 0)])  # of the rows without an id one held it
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(messy, bench.limit(0)).count() == 0


def test_near_copies_of_items_that_share_words(spark):
    rng = random.Random(3)
    shared = sentence(rng, 50)
    items = [(i, f"{shared} {sentence(rng, 9)}") for i in range(8)] + [(20 + i, sentence(random.Random(4), 59)) for i in range(8)]
    docs = []
    for d, (i, text) in enumerate(items):
        w = text.split()
        w[25] = "changed"
        docs.append((d, f"{sentence(rng, 80)} {' '.join(w)} {sentence(rng, 80)}"))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = found(decontam.contaminated(d, b))
    assert {(n, i) for n, (i, _) in enumerate(items)} | {(n, i) for n in range(8, 16) for i in range(20, 28)} <= got.keys()
    assert all(got[n, i] == pytest.approx(50 / 60) for n, (i, _) in enumerate(items))


def test_ids_with_several_texts(spark, planted):
    """Every row is searched, whatever its id; rows without an id are dropped if they hold an item, and not reported."""
    docs, items = planted
    docs = [(None if i % 10 == 9 else i % 7, t) for i, t in docs]
    items = [(i % 5, t) for i, t in items]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    same(found(decontam.contaminated(d, b)), {k: v for k, v in want.items() if k[0] is not None})
    held = {n for n, (_, t) in enumerate(docs) if brute([(0, t)], items)}
    assert any(docs[n][0] is None for n in held)
    left = sorted(r["text"] for r in decontam.decontaminate(d, b).collect())
    assert left == sorted(t for n, (_, t) in enumerate(docs) if n not in held)


def test_many_items_of_one_length(spark):
    """A window meets the items that it shares shingles with, not all of its length."""
    rng = random.Random(9)
    items = [(i, sentence(rng, 20)) for i in range(10_000)]
    docs = [(i, f"{sentence(rng, 40)} {items[37 * i][1]} {sentence(rng, 40)}") for i in range(100)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    made = {}

    def counted(df, name, write=decontam.materialize):
        out = write(df, name)
        made[name] = out.count()
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontam, "materialize", counted)
        got = found(decontam.contaminated(d, b))
    assert got == {(i, 37 * i): 1.0 for i in range(100)}
    assert made["promising"] <= 1_000 and made["pairs"] <= 1_000
