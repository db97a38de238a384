from __future__ import annotations

import random
from collections import defaultdict

from tessera.llm import substring
from tessera.llm.queries import op6_substring_dedup

from . import brute
from .conftest import sentence


def passages(docs: list[tuple], percent: int = 80) -> set[tuple[int, int]]:
    """(document, paragraph) of repeated runs, by comparing all pairs of paragraphs."""
    paras = []
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            if len(brute.WORD.findall(line)) >= substring.MIN_WORDS:
                paras.append((i, k, line))
    sets = [brute.shingles(p[2], substring.SHINGLE) for p in paras]
    holders = defaultdict(list)
    for j, s in enumerate(sets):
        for x in s:
            holders[x].append(j)
    edges = set()
    for j, s in enumerate(sets):
        for other in {o for x in s for o in holders[x] if o > j}:
            if brute.linked(s, sets[other], percent):
                edges.add((j, other))
    comp = brute.components(range(len(paras)), edges)
    held = defaultdict(set)
    for j, c in comp.items():
        held[c].add(paras[j][0])
    by_doc, out = defaultdict(list), set()
    for j, (i, k, line) in enumerate(paras):
        by_doc[i].append((k, len(brute.WORD.findall(line)), len(held[comp[j]]) > 1))
    for i, listed in by_doc.items():
        run = []
        for k, n, shared in [*sorted(listed), (None, 0, False)]:
            if shared:
                run.append((k, n))
                continue
            if sum(n for _, n in run) >= substring.RUN_WORDS:
                out |= {(i, k) for k, _ in run}
            run = []
    return out


def test_query(spark, sf, documents):
    found = op6_substring_dedup(spark, sf).collect()
    rows = [r for r in found if r["para"] is not None]
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    want = passages([*text.items()])
    got = {(r["doc_id"], r["para"]) for r in rows}
    assert got <= want and len(got) >= 0.995 * len(want)
    for r in rows:
        assert text[r["doc_id"]].split("\n")[r["para"]] == text[r["doc_id"]][r["start"] : r["end"]]
        assert r["kept"] == (r["doc_id"] == r["first_doc"])


    windows([*text.items()], [r for r in found if r["para"] is None])


def windows(docs: list[tuple], rows) -> None:
    """Passages by windows repeat at both ends, and a document that shares 51 words with another has one there."""
    w = {i: [(m.start(), m.end(), brute.lower(m.group())) for m in brute.WORD.finditer(t or "")] for i, t in docs}
    short, long = defaultdict(set), defaultdict(set)
    for i, listed in w.items():
        words = [x[2] for x in listed]
        for n, seen in ((substring.WINDOW, short), (51, long)):
            for k in range(len(words) - n + 1):
                seen[tuple(words[k : k + n])].add(i)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["end"]))
        listed = w[r["doc_id"]]
        inside = [x[2] for x in listed if r["start"] <= x[0] and x[1] <= r["end"]]
        assert len(inside) == r["words"]
        for end in (inside[: substring.WINDOW], inside[-substring.WINDOW :]):
            assert len(short[tuple(end)]) > 1
    for i, listed in w.items():
        words = [x[2] for x in listed]
        for k in range(len(words) - 50):
            if len(long[tuple(words[k : k + 51])]) > 1:
                a, b = listed[k][0], listed[k + 50][1]
                assert any(s < b and a < e for s, e in by_doc[i])


def test_passages_inside_lines(spark):
    rng = random.Random(5)
    docs = [(i, sentence(rng, 150)) for i in range(40)]
    passage = sentence(rng, 51)
    for i in (4, 9, 30):
        words = docs[i][1].split()
        at = rng.randrange(150)
        docs[i] = (i, " ".join([*words[:at], f"Ü é{i}", passage.upper() if i == 9 else passage, *words[at:]]))
    text = dict(docs)
    rows = substring.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["kept"], r["first_doc"]) for r in rows} == {(4, True, 4), (9, False, 4), (30, False, 4)}
    assert all(brute.lower(text[r["doc_id"]][r["start"] : r["end"]]) in passage for r in rows)


def test_planted_passages(spark):
    rng = random.Random(1)
    passage = sentence(rng, 60)
    near = passage.split()
    near[30] = "changed"
    docs = [(i, "\n".join(sentence(rng, 40) for _ in range(5))) for i in range(30)]
    docs[3] = (3, docs[3][1] + "\n" + passage)
    docs[7] = (7, passage + "\n" + docs[7][1])
    docs[9] = (9, docs[9][1] + "\n" + " ".join(near) + "\n" + sentence(rng, 12))
    short = sentence(rng, 20)
    docs[11], docs[12] = (11, docs[11][1] + "\n" + short), (12, docs[12][1] + "\n" + short)
    rows = substring.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["kept"]) for r in rows} == {(3, True), (7, False), (9, False)}


def test_edges(messy, empty):
    rows = substring.repeated_passages(messy).collect()
    assert {r["doc_id"] for r in rows} == {5, 6, 7, 8, 10**12}
    assert len(rows) == 10
    assert substring.repeated_passages(empty).count() == 0


def common_runs(docs: list[tuple]) -> set[tuple]:
    """(document, first word, words, first document) of the maximal runs whose every 50 words another document holds."""
    w, holders = {i: [brute.lower(x) for x in brute.WORD.findall(t)] for i, t in docs}, defaultdict(set)
    for i, listed in w.items():
        for k in range(len(listed) - 49):
            holders[tuple(listed[k : k + 50])].add(i)
    out = set()
    for i, listed in w.items():
        run = None
        for k in range(max(len(listed) - 48, 0)):
            held = holders.get(tuple(listed[k : k + 50])) if k < len(listed) - 49 else None
            first = min(held) if held and len(held) > 1 else None
            if run and first != run[1]:
                out.add((i, run[0], k + 49 - run[0], run[1]))
                run = None
            if first is not None and run is None:
                run = (k, first)
    return out


def by_words(spark, docs: list[tuple]) -> set[tuple]:
    """The passages inside lines in the form of ``common_runs``."""
    text, out = dict(docs), set()
    for r in substring.repeated_windows(spark.createDataFrame(docs, "doc_id bigint, text string")).collect():
        t = text[r["doc_id"]]
        assert len(brute.WORD.findall(t[r["start"] : r["end"]])) == r["words"]
        assert r["kept"] == (r["doc_id"] == r["first_doc"])
        out.add((r["doc_id"], len(brute.WORD.findall(t[: r["start"]])), r["words"], r["first_doc"]))
    return out


def test_passages_are_whole(spark):
    rng = random.Random(11)
    docs = []
    for n in (50, 51, 60, 80, 120, 300):
        for _ in range(4):
            p, i = sentence(rng, n), len(docs)
            docs += [(i, f"{sentence(rng, 70)}  é {p} {sentence(rng, 20)}"), (i + 1, f"{sentence(rng, 33)}\n{p.upper()}"), (i + 2, f"{p} {sentence(rng, 45)}")]
    want = common_runs(docs)
    assert len(want) == len(docs)
    assert by_words(spark, docs) == want


def test_neighbouring_passages_keep_their_first_occurrence(spark):
    rng = random.Random(12)
    p, q = sentence(rng, 60), sentence(rng, 60)
    gap = [sentence(rng, 12) for _ in range(2)]
    docs = [(2, f"{sentence(rng, 60)} {q}"), (5, f"{p} {gap[0]} {q} {sentence(rng, 60)}"), (9, f"{sentence(rng, 60)} {p} {gap[1]}")]
    assert by_words(spark, docs) == common_runs(docs) == {(2, 60, 60, 2), (5, 0, 60, 5), (5, 72, 60, 2), (9, 60, 60, 5)}


def test_overlaps_below_run_words_are_no_passages(spark):
    rng = random.Random(13)
    docs = []
    for n in (16, 18, 25, 30, 40, 45, 49, 50):
        for _ in range(6):
            p, i = sentence(rng, n), len(docs)
            docs += [(i, f"{sentence(rng, 60)} {p} {sentence(rng, 60)}"), (i + 1, f"{sentence(rng, 60)} {p} {sentence(rng, 60)}")]
    got = by_words(spark, docs)
    assert got == common_runs(docs) and {i for i, *_ in got} == set(range(84, 96))


def test_random_overlaps(spark):
    rng = random.Random(14)
    pool = [sentence(rng, 200).split() for _ in range(4)]
    docs = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            source = rng.choice(pool)
            at = rng.randrange(150)
            parts += [*source[at : at + rng.randint(20, 120)], *sentence(rng, rng.randint(1, 30)).split()]
        docs.append((i, " ".join(parts)))
    assert by_words(spark, docs) == common_runs(docs)
