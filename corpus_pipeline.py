"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, minhash, rules, secrets
from tessera.llm.common import intermediates, kept, materialize, release
from tessera.llm.lsh import few
from tessera.llm.queries import table, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; the n-gram counts are of this stage's input. Null and empty texts fail the rules; repeated
    rows are judged each; an empty table stays empty."""
    return rules.keep(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each near-duplicate group (five-word shingles, similarity 0.8), once. Rows without an id stay, as do
    null and empty texts; of a repeated id one row stays; an empty table stays empty.

    Only ids are shuffled, and the rows of repeated ones."""
    with intermediates():
        found = minhash.near_duplicates(docs, words=5, percent=80).where("doc_id is not null")
        marks = found.groupBy("doc_id").agg(F.bool_and("kept").alias("_kept"), F.count("*").alias("_n")).where("not _kept or _n > 1")
        marks = kept(materialize(marks, "marks"))
    left = docs.join(few(materialize(marks.where("not _kept").select("doc_id"), "dropped")), "doc_id", "left_anti")
    if marks.where("_kept and _n > 1").isEmpty():
        return left.select(*docs.columns)
    repeated = few(materialize(marks.where("_kept and _n > 1").select("doc_id"), "repeated"))
    once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no benchmark item, whatever their ids. Null and empty texts stay, repeated rows go or stay
    together; an empty table stays empty."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind. Null and empty texts, repeated rows and empty tables stay."""
    return secrets.redact_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the decoded text. A null text counts as empty; repeated rows each
    have a row; an empty table gives none."""
    return bpe.encode(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scans", secret_scans), ("bpe_encoding", bpe_encoding)]

#: Components of near-duplicates and the merges of BPE are beyond SQL on whole tables; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with intermediates():
            after = kept(materialize(stage(spark, docs, sf_dir), name))
        release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
