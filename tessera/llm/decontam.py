"""Benchmark decontamination with DataFrame functions alone.

A benchmark item of L words is sought in windows of L words. A window as similar as asked shares a shingle with its item, so
an equi-join on shingles finds where an item's windows can lie, and running sums of the shared shingles leave those windows
that hold enough of them. They and all items get a 64-bit SimHash of their weighted shingles. The 64 bits fall into
``RADIUS + 1`` blocks: fingerprints that differ in ``RADIUS`` bits or fewer agree in one block at least. A window is looked
up in the blocks of the items that it was found by, never in those of all items. What agrees in a block and lies within the
radius is verified by the exact Jaccard similarity of the shingle multisets, both weighted and plain, and the greater of the
two counts. A shingle weighs 1 over the number of items of different words that hold it; an unseen shingle weighs 1. Where
weights differ from 1, windows and items have a second fingerprint without weights. Equal texts and items of equal words are
sought once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_name, intermediates, kept, materialize
from .lsh import few

SHINGLE = 5
#: At a similarity of 0.8 fingerprints differ in 9.7 bits on average; beyond 20 with a chance of 1 in 5,000.
RADIUS = 20
#: A benchmark of at most so many shingles (24 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_SHINGLES = 100_000
#: Slack of comparisons of sums of weights.
EPS = 1e-9

_BLANKS = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    inner = F.btrim(F.lower(text), F.lit(_BLANKS))
    return F.when(F.length(inner) > 0, F.split(inner, "[\\x20\\x09-\\x0D]+"))


def _grams(words: str, k: int) -> Column:
    """Hashes of all k-word shingles, none for fewer words."""
    w = F.col(words)
    each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, each)


def _simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fp of rows (keys, s, w)."""
    signs = [F.sum(F.when(F.shiftrightunsigned("s", b).bitwiseAND(F.lit(1)) == 1, F.col("w")).otherwise(-F.col("w"))).alias(f"b{b}") for b in range(64)]
    bits = [F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return rows.groupBy(*keys).agg(*signs).select(*keys, fp.alias("fp"))


def _agree(a: str, b: str) -> Column:
    """Whether two fingerprints agree in one of the RADIUS + 1 blocks at least."""
    n = RADIUS + 1
    cuts = [64 * i // n for i in range(n + 1)]
    differ = F.col(a).bitwiseXOR(F.col(b))
    none = F.lit(False)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        mask = ((1 << (hi - lo)) - 1) << lo
        none |= differ.bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64))) == 0
    return none


#: What names a text: two 64-bit hashes of it.
KEY = ["k1", "k2"]


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that it holds: id_col, item_id, start_word, n_words, similarity (of the best
    window to nine digits, the first among equals). A-Z and other letters are lower-cased; words are cut at blanks.

    Items of fewer than five words match as a whole. Items and documents without words, and rows without an id, match
    nothing; repeated rows of a document or item count once, and an id with several texts has the best of each; empty tables
    give no rows; other columns are ignored. A text of any length is searched whole; an item of L words costs up to L windows
    of L words in a text that holds it."""
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    with intermediates():
        found = _found(source, benchmark, threshold, item_id, item_text)
        if found is not None:
            best, owners, ids = found
            each = best.join(few(owners), KEY).join(few(ids), "item").groupBy("doc", "_id").agg(_best())
            each = kept(materialize(each.select("doc", "_id", "best.*"), "contaminated"))
    if found is None:
        return source.limit(0).select(F.col("doc").alias(id_col), F.lit(None).cast(benchmark.schema[item_id].dataType).alias(item_id), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))
    return each.select(F.col("doc").alias(id_col), F.col("_id").alias(item_id), F.col("start").alias("start_word"), F.col("L").alias("n_words"), "similarity")


def _best() -> Column:
    return F.max_by(F.struct("start", "L", "similarity"), F.struct("similarity", -F.col("start"))).alias("best")


def _found(source: DataFrame, benchmark: DataFrame, threshold: float, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The best window of each text and item (KEY, item, start, L, similarity), the texts with a shared shingle by document
    (doc, KEY), and the ids of items (item, _id); None if no item has a word. ``source``: doc, text."""
    listed_items = benchmark.select(F.col(item_id).alias("_id"), _words(F.col(item_text)).alias("words")).where("_id is not null and words is not null")
    named = materialize(listed_items.withColumn("_words", F.sha2(F.array_join("words", " "), 256)).dropDuplicates(["_id", "_words"]), "named")
    same = materialize(named.groupBy("_words").agg(F.first("words").alias("words")).withColumn("item", F.monotonically_increasing_id()), "same")
    ids = materialize(named.join(same.select("_words", "item"), "_words").select("item", "_id"), "ids")
    items = materialize(same.select("item", "words", F.size("words").alias("L")), "items")
    kinds = sorted(r[0] for r in items.select(F.least("L", F.lit(SHINGLE))).distinct().collect())
    listed = None
    for k in kinds:
        part = items.where((F.col("L") >= k) if k == SHINGLE else (F.col("L") == k)).select("item", "L", F.posexplode(_grams("words", k)).alias("off", "s"))
        listed = part if listed is None else listed.unionByName(part)
    if listed is None:
        return None
    listed = materialize(listed, "shingles")
    small = listed.count() <= BROADCAST_SHINGLES

    def held(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    weights = materialize(listed.groupBy("s").agg((F.lit(1.0) / F.count_distinct("item")).alias("w")), "weights")
    whole = materialize(listed.join(held(weights), "s").groupBy("item").agg(F.sum("w").alias("item_w"), F.count("*").alias("item_n")), "item_weights")
    hits = None
    for k in kinds:
        spread = source.select("doc", *_keys(F.col("text")), _words(F.col("text")).alias("words")).where("words is not null")
        part = spread.select("doc", *KEY, F.posexplode(_grams("words", k)).alias("pos", "s")).join(held(weights.select("s")), "s", "left_semi")
        hits = part if hits is None else hits.unionByName(part)
    hits = materialize(hits, "hits")
    owners = materialize(hits.select("doc", *KEY).distinct(), "owners")
    anchored = hits.select(*KEY, "pos", "s").distinct().join(held(listed), "s").join(held(weights), "s")
    anchored = materialize(anchored.select(*KEY, "item", "L", "pos", (F.col("pos") - F.col("off")).alias("at"), "w").distinct(), "anchored")
    short = anchored.where(F.col("L") < SHINGLE).groupBy(*KEY, "item", "L").agg(F.min("pos").alias("start")).select(*KEY, "item", "start", "L", F.lit(1.0).alias("similarity"))

    # windows of items that hold enough of their shingles: running sums over shared positions, windows' starts and ends
    long = anchored.where(F.col("L") >= SHINGLE)
    slack = F.ceil(F.col("L") / 8).cast("int")
    count = F.col("L") - (SHINGLE - 1)
    nothing = [F.lit(0).alias("c"), F.lit(0.0).alias("w")]
    starts = long.select(*KEY, "item", "L", "at").distinct().select(*KEY, "item", "L", F.explode(F.sequence(F.col("at") - slack, F.col("at") + slack)).alias("start"))
    starts = starts.select(*KEY, "item", "L", F.greatest("start", F.lit(0)).alias("start")).distinct()
    events = long.select(*KEY, "item", "L", F.lit(None).cast("int").alias("start"), F.col("pos").alias("place"), F.lit(1).alias("c"), "w").distinct()
    for place in (F.col("start"), F.col("start") + count):
        events = events.unionByName(starts.select(*KEY, "item", "L", "start", place.alias("place"), *nothing))
    run = Window.partitionBy(*KEY, "item").orderBy("place", "c").rowsBetween(Window.unboundedPreceding, 0)
    summed = events.select(*KEY, "item", "L", "start", F.sum("c").over(run).alias("c"), F.sum("w").over(run).alias("w")).where("start is not null")
    summed = summed.groupBy(*KEY, "item", "L", "start").agg((F.max("c") - F.min("c")).alias("c"), (F.max("w") - F.min("w")).alias("w"))
    enough = (F.col("c") >= threshold * F.col("item_n") - EPS) | (F.col("w") >= threshold * F.col("item_w") - 1e-6)
    promising = materialize(summed.join(held(whole), "item").where(enough).select(*KEY, "item", "L", "start"), "promising")

    # their texts, as arrays of shingles
    texts = few(materialize(promising.select(*KEY).distinct(), "texts"))
    rows = source.select(*_keys(F.col("text")), "text").join(texts, KEY, "left_semi").select(*KEY, _words(F.col("text")).alias("words"))
    arrays = materialize(rows.select(*KEY, F.coalesce(_grams("words", SHINGLE), F.array().cast("array<bigint>")).alias("sh")).dropDuplicates(KEY), "arrays")
    room = F.greatest(F.lit(0), F.size("sh") - count)
    window = [*KEY, "L", "start"]
    inside = promising.join(arrays.select(*KEY, F.size("sh").alias("_size")), KEY).where(F.col("start") <= F.greatest(F.lit(0), F.col("_size") - count)).drop("_size")
    promising = materialize(inside, "candidates")
    windows = promising.select(*window).distinct().join(arrays, KEY).where(F.col("start") <= room).select(*window, F.slice("sh", F.col("start") + 1, count).alias("sh"))
    windows = materialize(windows, "windows")

    def weighed(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.join(held(weights), "s", "left").select(*keys, "s", F.coalesce("w", F.lit(1.0)).alias("w"))

    def marked(df: DataFrame, keys: list[str]) -> DataFrame:
        """Fingerprints of rows (keys, s, w): keys, plain, fp; without weights only where one is not 1."""
        light = df.where("w < 1").select(*keys).distinct()
        weighted, plain = _simhash(df, keys), _simhash(df.join(light, keys, "left_semi").withColumn("w", F.lit(1.0)), keys)
        even = weighted.join(light, keys, "left_anti")
        return weighted.withColumn("plain", F.lit(0)).unionByName(plain.unionByName(even).withColumn("plain", F.lit(1)))

    shingles = weighed(windows.select(*window, F.explode("sh").alias("s")), window)
    listed_long = weighed(listed.where(F.col("L") >= SHINGLE), ["item", "L"])
    if weights.where("w < 1").isEmpty():  # both fingerprints are the same
        marks, of_items = (_simhash(shingles, window).withColumn("plain", F.lit(0)), _simhash(listed_long, ["item", "L"]).withColumn("plain", F.lit(0)))
    else:
        shingles = materialize(shingles, "window_shingles")
        marks, of_items = marked(shingles, window), marked(listed_long, ["item", "L"])
    of_items = materialize(of_items.select("item", "plain", F.col("fp").alias("item_fp")), "item_marks")
    pairs = promising.join(marks, window).join(held(of_items), ["item", "plain"])
    pairs = pairs.where(_agree("fp", "item_fp") & (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)).select(*window, "item").distinct()
    pairs = materialize(pairs, "pairs")

    # exact similarity: sum of w * min(counts) over sum of w * max(counts), with weights and with w = 1
    mine = pairs.join(windows, window).select(*window, "item", F.explode("sh").alias("s")).groupBy(*window, "item", "s").agg(F.count("*").alias("c"))
    mine = mine.join(held(weights), "s", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    theirs = materialize(listed.groupBy("item", "s").agg(F.count("*").alias("ic")), "item_counts")
    least = F.least("c", F.coalesce("ic", F.lit(0)))
    both = mine.join(held(theirs), ["item", "s"], "left").groupBy(*window, "item").agg(F.sum(F.col("w") * F.col("c")).alias("doc_w"), F.sum(F.col("w") * least).alias("common"), F.sum("c").alias("doc_n"), F.sum(least).alias("common_n"))
    weighted, plain = F.col("common") / (F.col("doc_w") + F.col("item_w") - F.col("common")), F.col("common_n") / (F.col("doc_n") + F.col("item_n") - F.col("common_n"))
    both = both.join(held(whole), "item").withColumn("similarity", F.round(F.greatest(weighted, plain), 9))
    exact = both.where(F.col("similarity") >= threshold - EPS)
    best = exact.groupBy(*KEY, "item").agg(_best()).select(*KEY, "item", "best.start", "best.L", "best.similarity")
    return materialize(best.unionByName(short), "best"), owners, ids


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents whose text holds no benchmark item, with all their columns, whatever their ids; null and empty texts
    stay, repeated rows go or stay together."""
    with intermediates():
        found = _found(docs.select(F.lit(0).alias("doc"), F.col(text_col).alias("text")), benchmark, threshold, item_id, item_text)
        gone = None if found is None else kept(materialize(found[0].select(*KEY).distinct(), "contaminated"))
    if gone is None:
        return docs
    names = [fresh_name(docs, f"_{k}") for k in KEY]
    marked = docs.withColumns(dict(zip(names, _keys(F.col(text_col)), strict=True)))
    return marked.join(few(gone.toDF(*names)), names, "left_anti").select(*docs.columns)
