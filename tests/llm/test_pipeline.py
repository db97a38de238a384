from __future__ import annotations

import hashlib
import struct

import pytest

import corpus_pipeline
from tessera.llm.secrets import redact, scan_text

from . import brute
from .test_bpe import expected
from .test_decontam import brute as leaks
from .test_secrets import base


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows after each stage, written and read again."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_order_and_columns(stages, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scans", "bpe_encoding"]
    assert all(s.columns == documents.columns for s in stages[:-1])


def test_rules_drop_junk_and_keep_the_rest(stages):
    from .test_rules import counts

    kept = dict(pairs(stages[1]))
    sound = [i for i, t in pairs(stages[0]) if not counts(t)[-1]]
    assert kept.keys() <= set(sound) and len(kept) >= 0.9 * len(sound)


def test_one_of_each_group_stays(stages):
    want = {i for i, c in brute.near_duplicates(pairs(stages[1]), 5).items() if i == c}
    assert {i for i, _ in pairs(stages[2])} == want


def test_benchmark_items_go(spark, sf, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = pairs(stages[2])
    gone = {d for d, _ in leaks(docs, items)}
    assert {i for i, _ in pairs(stages[3])} == {i for i, _ in docs} - gone


def test_secrets_are_redacted(stages):
    before, after = dict(pairs(stages[3])), dict(pairs(stages[4]))
    kinds = ["assign", "access", "hex", "pem", "jwt", "vendor"]
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert after[i] == redact(t, [{"kind": kinds[k], "start": a, "end": b} for a, k, b in scan_text(t)])
        assert not base(after[i])


def test_tokens(stages):
    after = dict(pairs(stages[4]))
    rows = stages[5].collect()
    assert len(rows) == len(after)
    for r in rows:
        ids, decoded = expected(after[r["doc_id"]])
        assert list(r["token_ids"]) == ids
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_stages_take_messy_tables(spark, sf, messy, empty):
    for docs in (messy, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == messy.columns
            out.count()


def test_run_gives_the_same(spark, sf, stages):
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {r["doc_id"]: r["ids_sha256"] for r in stages[5].collect()}


def test_run_on_messy_and_empty_tables(spark, sf, messy, empty, tmp_path):
    """Nulls, repeated rows, odd columns and no rows at all, from the first stage to the last."""
    for name, docs in (("messy", messy), ("empty", empty)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        known = {r["doc_id"] for r in docs.collect()}
        assert {r["doc_id"] for r in rows} <= known and len(rows) <= docs.count()
        assert all(len(r["token_ids"]) == r["n_tokens"] for r in rows)
    encoded = corpus_pipeline.STAGES[-1][1](spark, messy, sf)
    assert encoded.count() == messy.count() and encoded.where("n_tokens = 0").count() >= 3
