"""Substring dedup: near-duplicate paragraphs by MinHash banding, exact Jaccard, and components.

Paragraphs are lines of ``MIN_WORDS`` words or more. Their sets of distinct 5-word shingles link at a Jaccard similarity
of 0.8. A component that spans several documents repeats; runs of neighbouring repeating paragraphs that have
``RUN_WORDS`` words or more in all are passages. All but the first document's occurrences are removals.

A passage inside a longer line is no paragraph. Such passages are the maximal runs whose every ``RUN_WORDS`` consecutive
words (a stretch) another document holds too. They are found by winnowing: each stretch has a seed, of its ``SPAN`` windows
of ``WINDOW`` words the one of the least hash, so equal stretches have equal seeds at equal places. A seed's neighbourhood
is the words of all stretches that it stands for. If all documents with a seed agree in its neighbourhood, they share all its
stretches; else its stretches are compared one by one, by a hash of all their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ARRAY_BYTES, distinct_per_text, intermediates, kept, mapped, materialize, mix, release, shingles, slices, split_words, text_bytes, word_hashes
from .rules import _BLANK, _CHAR_START
from .lsh import BROADCAST_ROWS, Scheme, components, few, fingerprints, link

#: A pair at 0.8 shares no bucket with a chance of 1 in 1,300, at 0.9 with 1 in 460,000; equal paragraphs always meet.
SCHEME = Scheme(rows=3, bands=10, sketch_words=1)
MIN_WORDS, RUN_WORDS, SHINGLE = 10, 50, 5
WINDOW = 16
SPAN = RUN_WORDS - WINDOW + 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def paragraphs(text: str | None, least: int) -> list[tuple[int, int, str]]:
    """(line number, first code point, line) of the lines with ``least`` words or more."""
    out, at = [], 0
    for k, line in enumerate((text or "").split("\n")):
        if len(line) >= 2 * least - 1 and len(_WORD.findall(line)) >= least:
            out.append((k, at, line))
        at += len(line) + 1
    return out


def _sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return distinct_per_text(*shingles(*word_hashes(pa.array(lines, pa.string()), lower=True), SHINGLE))


def _signed(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", ARRAY_BYTES):
            lists = pc.split_pattern(pc.fill_null(batch.column("_text"), ""), "\n")
            lines, of_text = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            text = np.repeat(np.arange(batch.num_rows), np.diff(of_text))
            of_text = of_text - of_text[0]
            hashes, offsets = word_hashes(lines, lower=True)
            size, words = pc.utf8_length(lines).to_numpy().astype(np.int64), np.diff(offsets)
            ends = np.cumsum(size + 1)
            start = ends - size - 1
            start -= start[np.minimum(of_text[text], max(0, len(start) - 1))]
            keep = np.flatnonzero(words >= least)
            words, text = words[keep], text[keep]
            at = np.concatenate([[0], np.cumsum(words)])
            own = hashes[np.repeat(offsets[keep] - at[:-1], words) + np.arange(at[-1])]
            columns = SCHEME.arrays(*distinct_per_text(*shingles(own, at, SHINGLE)))
            ints = [pa.array(x.astype(np.int32)) for x in (keep - of_text[text], start[keep], start[keep] + size[keep], words)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(text)), *ints, *columns], names=["doc", "para", "start", "end", "words", *SCHEME.names])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")).where("id is not null")
    return mapped(source, run, f"doc bigint, para int, start int, `end` int, words int, {SCHEME.fields}")


def winnow(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The seeds of all stretches: word and hash of each seed, the first and the number of the stretches that it stands for,
    a hash of its neighbourhood, and the hashes of all stretches by their first words. Words count through all texts; a text
    of fewer than ``RUN_WORDS`` words has no seed."""
    n = len(hashes) - WINDOW + 1
    if n < SPAN:
        return (*(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64)), np.zeros(0, np.uint64))
    power, back = np.full(len(hashes), _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    power[0] = back[0] = 1
    back = np.multiply.accumulate(back)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * np.multiply.accumulate(power), out=total[1:])
    value = mix((total[WINDOW:] - total[:-WINDOW]) * back)
    low = np.uint64(max(26, n.bit_length()))  # the place, which also parts equal windows
    least = (value >> low << low) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(text[: len(least)] == text[RUN_WORDS - 1 :])
    owner = (least[inside] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    edge = np.flatnonzero(np.diff(owner, prepend=-1))  # seeds do not move backwards
    at, first, count = owner[edge], inside[edge], np.diff(edge, append=len(owner))
    around = mix((total[first + count - 1 + RUN_WORDS] - total[first]) * back[first])
    around = mix(around ^ mix(((at - first) * RUN_WORDS + count).astype(np.uint64)))
    return at, value[at], first, count, around, mix((total[RUN_WORDS:] - total[:-RUN_WORDS]) * back[: len(least)])


def _edges(texts: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First code point, and the one past the last, of all words within their texts."""
    raw, edge = text_bytes(texts)
    full = np.concatenate([~_BLANK[raw], [False]])
    left, right = full[:-1].copy(), full[:-1].copy()
    left[1:] &= ~full[:-2]
    right &= ~full[1:]
    cut = edge[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    left[cut] |= full[cut]
    right[cut - 1] |= full[cut - 1]
    chars = np.concatenate([[0], np.cumsum(_CHAR_START[raw])])
    zero = np.repeat(chars[edge[:-1]], np.diff(offsets))
    return chars[np.flatnonzero(left)] - zero, chars[np.flatnonzero(right) + 1] - zero


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, v and _text; ``v`` parts the texts of an id that has several."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.hash(text_col).alias("v"), F.col(text_col).alias("_text")).where("doc is not null")


def _seeds(source: DataFrame) -> DataFrame:
    """doc, v, pos (word), h, c (of the neighbourhood), a and b (the first and the last stretch, by their first words) of all
    seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", ARRAY_BYTES):
            hashes, offsets = word_hashes(batch.column("_text"), lower=True)
            at, value, first, count, around, _ = winnow(hashes, offsets)
            text = np.searchsorted(offsets, at, "right") - 1
            zero = offsets[text]
            lead = [batch.column(c).take(pa.array(text)) for c in ("doc", "v")]
            ints = [pa.array(x.astype(np.int32)) for x in (at - zero, first - zero, first + count - 1 - zero)]
            yield pa.RecordBatch.from_arrays([*lead, *ints, pa.array(value.view(np.int64)), pa.array(around.view(np.int64))], names=["doc", "v", "pos", "a", "b", "h", "c"])

    return mapped(source, run, "doc bigint, v int, pos int, a int, b int, h bigint, c bigint")


def _stretches(source: DataFrame) -> DataFrame:
    """Of the seeds at ``_at`` (pos, lo, hi): h, c, lo, hi, off (of the first stretch from the seed) and the hashes of their
    stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", ARRAY_BYTES):
            hashes, offsets = word_hashes(batch.column("_text"), lower=True)
            at, value, first, count, around, each = winnow(hashes, offsets)
            wanted = batch.column("_at")
            flat = wanted.flatten()
            asked = flat.field("pos").to_numpy() + np.repeat(offsets[:-1], np.diff(wanted.offsets.to_numpy()))
            keep = np.searchsorted(at, asked)
            value, first, count, around = value[keep], first[keep], count[keep], around[keep]
            ends = np.concatenate([[0], np.cumsum(count)])
            of = np.repeat(first - ends[:-1], count) + np.arange(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(each[of].view(np.int64)))
            off = pa.array((first - asked).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(around.view(np.int64)), flat.field("lo"), flat.field("hi"), off, lists], names=["h", "c", "lo", "hi", "off", "each"])

    return mapped(source, run, "h bigint, c bigint, lo bigint, hi bigint, off int, each array<bigint>")


def _placed(source: DataFrame) -> DataFrame:
    """The runs of words in ``_runs`` (a, z, h, first_doc) with their code points: doc, v, a, start, end, words, h, first_doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", ARRAY_BYTES):
            _, _, offsets = split_words(batch.column("_text"))
            left, right = _edges(batch.column("_text"), offsets)
            runs = batch.column("_runs")
            flat, text = runs.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
            a, z = (flat.field(c).to_numpy() for c in "az")
            lead = [batch.column(c).take(pa.array(text)) for c in ("doc", "v")]
            points = [pa.array(x.astype(np.int32)) for x in (left[offsets[text] + a], right[offsets[text] + z])]
            yield pa.RecordBatch.from_arrays([*lead, flat.field("a"), *points, pa.array((z - a + 1).astype(np.int32)), flat.field("h"), flat.field("first_doc")], names=["doc", "v", "a", "start", "end", "words", "h", "first_doc"])

    return mapped(source, run, "doc bigint, v int, a int, start int, `end` int, words int, h bigint, first_doc bigint")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages inside lines: id_col, start, end, words, component_id (the least hash of a seed), first_doc, kept.

    A passage ends where the next stretch is not repeated or is first held by another document, so passages of different
    first documents may overlap; each is whole in its first document. Null ids and texts of fewer than ``RUN_WORDS`` words give
    no rows, an empty table none; the texts of a repeated id are searched each, and count as one document."""
    with intermediates():
        return kept(materialize(_windows(docs, id_col, text_col), "windows"))


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = _source(docs, id_col, text_col)
    seeds = materialize(_seeds(source), "seeds")
    held = seeds.groupBy("h").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("_last"), (F.min("c") < F.max("c")).alias("_differ")).where("first_doc < _last").drop("_last")
    # written, so that the join reads two exchanges and Spark can split a seed that very many documents hold
    held = materialize(held, "held")
    marked = materialize(seeds.join(few(held, BROADCAST_ROWS), "h"), "repeats")
    release(seeds, held)
    whole = marked.where("not _differ").select("doc", "v", "a", "b", "h", "first_doc")

    # seeds whose neighbourhoods differ: one seed of each neighbourhood has its stretches compared
    differ = marked.where("_differ")
    kinds = differ.groupBy("h", "c").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("doc", "v", "pos")).alias("_one"))
    wanted = kinds.groupBy("_one.doc", "_one.v").agg(F.collect_list(F.struct("_one.pos", "lo", "hi")).alias("_at"))
    wanted = materialize(wanted.toDF("doc", "v", "_at"), "wanted")
    listed = materialize(_stretches(source.join(few(wanted, BROADCAST_ROWS), ["doc", "v"]).select("_at", "_text")).dropDuplicates(["h", "c"]), "stretches")
    around = listed.select("h", "c", "lo", "hi", "off", F.posexplode("each").alias("i", "e")).withColumn("off", F.col("off") + F.col("i"))
    shared = around.groupBy("h", "off", "e").agg(F.min("lo").alias("first_doc"), F.max("hi").alias("_last")).where("first_doc < _last").drop("_last")
    one = around.join(materialize(shared, "shared"), ["h", "off", "e"]).groupBy("h", "c").agg(F.array_sort(F.collect_list(F.struct("i", F.col("i").alias("j"), "first_doc"))).alias("_parts"))
    found = materialize(one.select("h", "c", _neighbours_joined("_parts").alias("_parts")), "parts")
    part = differ.join(few(found, BROADCAST_ROWS), ["h", "c"]).select("doc", "v", "a", "h", F.explode("_parts").alias("_p"))
    part = part.select("doc", "v", (F.col("a") + F.col("_p.i")).alias("a"), (F.col("a") + F.col("_p.j")).alias("b"), "h", "_p.first_doc")

    by_doc = Window.partitionBy("doc", "v").orderBy("a")
    every = whole.unionByName(part).dropDuplicates(["doc", "v", "a"])
    new = F.coalesce((F.col("a") != F.lag("b").over(by_doc) + 1) | (F.col("first_doc") != F.lag("first_doc").over(by_doc)), F.lit(True))
    runs = every.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(by_doc))
    runs = runs.groupBy("doc", "v", "_run").agg(F.min("a").alias("a"), (F.max("b") + RUN_WORDS - 1).alias("z"), F.min("h").alias("h"), F.first("first_doc").alias("first_doc"))
    of_doc = materialize(runs.groupBy("doc", "v").agg(F.collect_list(F.struct("a", "z", "h", "first_doc")).alias("_runs")), "runs")
    texts = source.join(few(of_doc, BROADCAST_ROWS), ["doc", "v"]).select("doc", "v", "_runs", "_text")
    placed = _placed(texts).dropDuplicates(["doc", "v", "a"])  # repeated rows
    return placed.select(F.col("doc").alias(id_col), "start", "end", "words", F.col("h").alias("component_id"), "first_doc", (F.col("first_doc") == F.col("doc")).alias("kept"))


def _neighbours_joined(parts: str) -> Column:
    """Structs (i, j, first_doc) in order, with neighbours of one first document joined; there are ``SPAN`` at most."""

    def add(found: Column, x: Column) -> Column:
        last = F.get(found, F.size(found) - 1)
        longer = F.concat(F.slice(found, 1, F.size(found) - 1), F.array(F.struct(last["i"].alias("i"), x["j"].alias("j"), x["first_doc"].alias("first_doc"))))
        return F.when((F.size(found) > 0) & (last["j"] + 1 == x["i"]) & (last["first_doc"] == x["first_doc"]), longer).otherwise(F.concat(found, F.array(x)))

    return F.aggregate(parts, F.slice(F.col(parts), 1, 0), add)


def repeated_passages(docs: DataFrame, percent: int = 80, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The passages that repeat across documents: id_col, para, start, end (code points), words, component_id, first_doc,
    kept; ``para`` is null for a passage found by windows, which may lie inside a line or span several.

    ``kept`` is true in the document of the least id. Null ids, null and empty texts, and short lines give no rows;
    repeated rows of one id count as one document; texts of any length are searched whole; an empty table gives no rows;
    other columns are ignored.
    """
    inside = repeated_windows(docs, id_col, text_col)
    with intermediates():
        by_para = kept(materialize(_paragraphs(docs, percent, min_words, run_words, id_col, text_col), "passages"))
    return by_para.unionByName(inside.withColumn("para", F.lit(None).cast("int")))


def _paragraphs(docs: DataFrame, percent: int, min_words: int, run_words: int, id_col: str, text_col: str) -> DataFrame:
    signed = materialize(_signed(docs, id_col, text_col, min_words).withColumn("uid", F.monotonically_increasing_id()), "paragraphs")
    # one paragraph stands for all of its set
    least = signed.groupBy("f1", "f2").agg(F.min(F.struct("doc", "para", "uid")).alias("_first"))
    classes = materialize(least.select("f1", "f2", "_first.doc", "_first.para", F.col("_first.uid").alias("id")), "classes")
    items = signed.select(F.col("uid").alias("id"), *SCHEME.names).join(classes.select("id"), "id", "left_semi")

    def sets(ids: DataFrame) -> DataFrame:
        """The documents that first hold the wanted sets, and which of their paragraphs are wanted."""
        wanted = classes.join(ids, "id", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("para", "id", "f1")).alias("_wanted"))
        source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("_text")).join(wanted, "doc").select("_wanted", "_text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "_text", ARRAY_BYTES):
                lines, ids, f1 = [], [], []
                for t, asked in zip(batch.column("_text").to_pylist(), batch.column("_wanted").to_pylist(), strict=True):
                    at = {k: line for k, _, line in paragraphs(t, min_words)}
                    for w in asked:
                        if w["para"] in at:
                            lines.append(at[w["para"]])
                            ids.append(w["id"])
                            f1.append(w["f1"])
                values, at = _sets(lines)
                same = fingerprints(values, at)[0].view(np.int64) == np.array(f1, np.int64)  # not another text of the same id
                listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), listed], names=["id", "set"]).filter(pa.array(same))

        return mapped(source, run, "id bigint, set array<bigint>")

    labels = components(link(items, sets, SCHEME, percent))
    of_set = materialize(classes.select("f1", "f2", "id").join(labels, "id", "left").select("f1", "f2", F.coalesce("comp", "id").alias("comp")), "components")
    placed = materialize(signed.select("doc", "para", "start", "end", "words", "f1", "f2").join(of_set, ["f1", "f2"]).select("doc", "para", "start", "end", "words", "comp"), "occurrences")
    spans = materialize(placed.groupBy("comp").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("_last")).where("first_doc < _last").select("comp", "first_doc"), "spans")
    marked = placed.join(few(spans, BROADCAST_ROWS), "comp", "left")

    by_doc = Window.partitionBy("doc").orderBy("para")
    marked = marked.dropDuplicates(["doc", "para"]).withColumn("_island", F.sum(F.col("first_doc").isNull().cast("int")).over(by_doc))
    runs = marked.where("first_doc is not null").withColumn("_run", F.sum("words").over(Window.partitionBy("doc", "_island"))).where(F.col("_run") >= run_words)
    return runs.select(F.col("doc").alias(id_col), "para", "start", "end", "words", F.col("comp").alias("component_id"), "first_doc", (F.col("doc") == F.col("first_doc")).alias("kept"))
