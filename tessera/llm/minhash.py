"""MinHash near-deduplication of whole texts, with min-max signatures and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARRAY_BYTES, distinct_per_text, intermediates, kept, mapped, materialize, shingles, slices, word_hashes
from .lsh import BROADCAST_ROWS, Scheme, components, few, fingerprints, link

#: A pair at 0.8 shares no bucket with a chance of 3e-6; sets that meet at 0.2 share one with 1 %.
SCHEME = Scheme(rows=5, bands=32)


def _sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct_per_text(*shingles(*word_hashes(texts, lower=True), words))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, scheme: Scheme = SCHEME) -> DataFrame:
    """id and the scheme's fields of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", ARRAY_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("id"), *scheme.arrays(*_sets(batch.column("_text"), words))], names=["id", *scheme.names])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
    return mapped(source, run, f"id bigint, {scheme.fields}")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, n_shingles, component_id, kept.

    Sets of distinct ``words``-word shingles (A-Z lower-cased; fewer words: the whole sequence) link at a Jaccard
    similarity of ``percent`` / 100. ``component_id`` is the least id reachable, and that document is kept. Texts without
    words, and nulls, link with nothing; rows with a null id keep it as their component. Equal sets are merged by a
    128-bit fingerprint before candidates are sought. Rows of one id are one document: what one of its texts links to, all
    reach; each row has a row of its own. A text of any length is one set, in one worker's memory. An empty table gives no
    rows; other columns are ignored.
    """
    signed = materialize(signatures(docs, id_col, text_col, words).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    full = (F.col("n") > 0) & F.col("id").isNotNull()
    with intermediates():
        # a class of equal sets has the name of the row that stands for it
        least = signed.where(full).groupBy("f1", "f2").agg(F.min(F.struct("id", "uid")).alias("_first"))
        classes = materialize(least.select("f1", "f2", F.col("_first.id").alias("doc"), F.col("_first.uid").alias("id")), "classes")
        items = signed.drop("id").withColumnRenamed("uid", "id").join(classes.select("id"), "id", "left_semi")
        named = classes.select("id", "doc", "f1", "f2")

        def sets(ids: DataFrame) -> DataFrame:
            wanted = named.join(ids, "id", "left_semi")

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in slices(batches, "_text", ARRAY_BYTES):
                    values, at = _sets(batch.column("_text"), words)
                    same = pa.array(np.ones(batch.num_rows, bool))
                    for name, found in zip(("f1", "f2"), fingerprints(values, at), strict=True):  # another text of the same id
                        same = pc.and_(same, pc.equal(batch.column(name), pa.array(found.view(np.int64))))
                    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "set"]).filter(same)

            source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("_text"))
            return mapped(source.join(wanted, "doc").select("id", "f1", "f2", "_text"), run, "id bigint, set array<bigint>")

        links = link(items, sets, SCHEME, percent)
        several = materialize(signed.where(full).groupBy("id").agg(F.min(F.struct("f1", "f2")).alias("_a"), F.max(F.struct("f1", "f2")).alias("_b")).where("_a <> _b").select("id"), "several")
        if not several.isEmpty():
            texts = signed.where(full).join(several, "id", "left_semi").select("id", "f1", "f2").join(classes.select("f1", "f2", F.col("id").alias("b")), ["f1", "f2"])
            hubs = texts.groupBy("id").agg(F.min("b").alias("a"))
            links = links.unionByName(texts.join(hubs, "id").where("a <> b").select("a", "b").distinct())
        labels = components(links)
        comps = materialize(classes.select("id", "doc").join(labels, "id").groupBy("comp").agg(F.min("doc").alias("_least")), "least")
        of_class = classes.join(labels, "id", "left").join(few(comps, BROADCAST_ROWS), "comp", "left").select("f1", "f2", F.coalesce("_least", "doc").alias("comp"))
        of_class = kept(materialize(of_class, "components"))
    out = signed.where(full).select("id", "n", "f1", "f2").join(of_class, ["f1", "f2"]).select("id", "n", "comp")
    out = out.unionByName(signed.where(~full).select("id", "n", F.col("id").alias("comp")))
    comp = F.col("comp")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))
