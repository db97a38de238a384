"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. A ledger holds the spans found for each pair of blob
and rule version. A scan takes only the pairs that the ledger lacks, adds them to it, and joins the spans back to every
path (here: document) that holds the blob. Spans are code point offsets into the text, end exclusive.

Texts stay where they lie. Without a ledger all blobs are unseen: each task scans its own texts, each content once, and the
paths have their spans at once. With one, only hashes are shuffled to find the unseen blobs; their texts are picked by a
broadcast of the hashes if those are few, and by a join else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, mapped, materialize, slices
from .lsh import few

#: Raise it with any change of the rules: blobs scanned under another version are unseen.
RULE_VERSION = "4"

_I = re.ASCII | re.IGNORECASE
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_LABEL = r"(?:[A-Z]{2,10} )?PRIVATE KEY(?: BLOCK)?-----"
#: Up to the END line, over text without five hyphens; without one up to the first hyphen after the headers of an encrypted key.
_PEM = re.compile(rf"-----BEGIN {_LABEL}(?:(?:[^-]|-{{1,4}}[^-])*-----END {_LABEL}|\s*(?:(?:Proc-Type|DEK-Info):[^\n]*\n)*[^-]*)", re.ASCII)
#: Blobs whose spans a task remembers.
SEEN_BLOBS = 50_000
#: Kinds in the order that breaks ties of a start. The first three are the base.
KINDS = ("assign", "access", "hex", "pem", "jwt", "vendor")
_MORE = (
    ("pem", _PEM),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.ASCII)),
    ("vendor", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", re.ASCII)),
)


def scan_text(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, index of the kind, end), sorted."""
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for kind, rule in _MORE:
        found += [(m.start(), KINDS.index(kind), m.end()) for m in rule.finditer(text)]
    return sorted(found)


SPAN = "struct<kind:string,start:int,`end`:int>"
LEDGER = f"blob binary, rule_version string, spans array<{SPAN}>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _blob(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _scanned(batch: pa.RecordBatch, seen: dict[bytes, list]) -> list[list]:
    """Spans of each text of a batch (blob, text); ``seen`` has those of the task's last blobs."""
    out = []
    for blob, text in zip(batch.column("blob").to_pylist(), batch.column("text").to_pylist(), strict=True):
        if (spans := seen.get(blob)) is None:
            if len(seen) >= SEEN_BLOBS:
                seen.clear()
            spans = seen[blob] = [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan_text(text)]
        out.append(spans)
    return out


def scan(content: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """``content`` (blob, text and others) with rule_version and spans in place of text; a blob without a finding has none."""
    carry = [c for c in content.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        for batch in slices(batches, "text"):
            spans = _scanned(batch, seen)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array([version] * len(spans), pa.string()), pa.array(spans, _SPANS)], names=[*carry, "rule_version", "spans"])

    lead = ", ".join(f"`{c}` {content.schema[c].dataType.simpleString()}" for c in carry)
    return mapped(content, run, f"{lead}, rule_version string, spans array<{SPAN}>")


def _ledger(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", version: str = RULE_VERSION) -> DataFrame:
    """The rows to append to the ledger: blobs of ``docs`` that it lacks under this rule version."""
    content = docs.select(_blob(text_col).alias("blob"), F.col(text_col).alias("text"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == version).select("blob")
        unseen = materialize(content.select("blob").distinct().join(known, "blob", "left_anti"), "unseen")
        content = content.join(few(unseen), "blob", "left_semi")
    return _ledger(scan(content, version))


def findings(docs: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", version: str = RULE_VERSION) -> DataFrame:
    """Spans of every path: id_col, spans. Paths of equal content share the ledger's row; null texts count as empty.

    Only blobs with a finding are joined: the join moves 32 bytes for a path and never a text."""
    paths = docs.select(id_col, _blob(text_col).alias("blob"))
    hits = ledger.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    return paths.join(hits, "blob", "left").select(id_col, F.coalesce("spans", F.from_json(F.lit("[]"), f"array<{SPAN}>")).alias("spans"))


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan what is unseen and report on all: (findings, rows to append to the ledger).

    Null texts count as empty and have no spans; empty tables give empty results; repeated rows each have a row; texts of any
    length are scanned whole; other columns are ignored."""
    if ledger is None:
        rows = docs.select(F.col(id_col).alias("_path"), _blob(text_col).alias("blob"), F.col(text_col).alias("text"))
        scanned = materialize(scan(rows, version), "scanned")
        return scanned.select(F.col("_path").alias(id_col), "spans"), _ledger(scanned)
    fresh = materialize(update_ledger(docs, ledger, text_col, version), "ledger")
    known = ledger.select("blob", "rule_version", "spans").unionByName(fresh)
    return findings(docs, known, id_col, text_col, version), fresh


def redact(text: str, spans: list) -> str:
    """The text with each span, or run of overlapping ones, as ``[KIND]``; the rest stays as it is."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", version: str = RULE_VERSION) -> DataFrame:
    """``docs`` with the ledger's spans redacted, columns as they were; an ``n_chars`` column follows the new text. Without a
    ledger the texts are scanned where they lie, and none moves. Nulls stay null; repeated rows and empty tables are as any."""
    blob, found = fresh_name(docs, "_blob"), fresh_name(docs, "_spans")
    marked = docs.withColumn(blob, _blob(text_col))
    fresh = ledger is None
    if not fresh:
        hits = ledger.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select(F.col("blob").alias(blob), F.col("spans").alias(found)).dropDuplicates([blob])
        marked = marked.join(hits, blob, "left").select(*docs.columns, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        for batch in slices(batches, text_col):
            column = batch.column(text_col)
            if fresh:
                spans = _scanned(pa.RecordBatch.from_arrays([batch.column(blob), column], names=["blob", "text"]), seen)
                out = batch.drop_columns([blob])
            else:
                spans, out = batch.column(found).to_pylist(), batch.drop_columns([found])
            if any(spans):
                texts = [redact(t, s) if s and t is not None else t for t, s in zip(column.to_pylist(), spans, strict=True)]
                at = out.schema.get_field_index(text_col)
                out = out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type))
                if (at := out.schema.get_field_index("n_chars")) >= 0 and pa.types.is_integer(out.schema.field(at).type):
                    changed = [len(t) if s and t is not None else n for n, t, s in zip(out.column("n_chars").to_pylist(), texts, spans, strict=True)]
                    out = out.set_column(at, out.schema.field(at), pa.array(changed, out.schema.field(at).type))
            yield out

    return mapped(marked, run, docs.schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of ``findings``."""

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
