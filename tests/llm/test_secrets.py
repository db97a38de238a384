from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import secrets
from tessera.llm.common import materialize
from tessera.llm.queries import op9_secret_scans

LETTER = lambda word: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile(f"({'|'.join(map(LETTER, ('password', 'passwd', 'secret', 'token')))}|{LETTER('api')}_?{LETTER('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def base(text: str | None) -> list[tuple[int, int, str, int]]:
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m.group()) >= 32]
    return sorted(found)


def _base_of(text):
    return [(a, k, secrets.KINDS[k], b) for a, k, b in secrets.scan_text(text) if k < 3]


def check(r, text) -> None:
    want = base(text)
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in want) for k in range(3))
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in want)
    assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    spans = [s for s in r["spans"].split(",") if s]
    assert set(joined.split(",")) - {""} <= set(spans)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWD", "ſecret", "secret", "toKen", "api_key", "apikey", "API_KEY", '"', "'", " ", "=", ":", "abcd1234", "a" * 33, "0f" * 16, "AKIA", "ABCD" * 4, "é", "K", "\n", "-", "+/=", "tokentoken=xyzxyzxyz"]), max_size=14).map("".join))
def test_base_of_any_text(text):
    assert _base_of(text) == base(text)


def test_query(spark, sf, documents):
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = op9_secret_scans(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        check(r, text[r["doc_id"]])
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows) > 10


def test_added_kinds():
    text = "x -----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- ghp_" + "aZ" * 18 + " eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    assert [secrets.KINDS[k] for _, k, _ in secrets.scan_text(text)] == ["pem", "vendor", "jwt"]


def test_ledger_scans_only_what_is_unseen(spark):
    old = spark.createDataFrame([(1, "secret=abcdefgh1"), (2, "clean"), (3, "clean")], "doc_id bigint, text string")
    found, ledger = secrets.scan_documents(old)
    assert ledger.count() == 2 and found.count() == 3
    new = old.unionByName(spark.createDataFrame([(4, "token: zzzzzzzz9"), (5, "secret=abcdefgh1")], "doc_id bigint, text string"))
    found, fresh = secrets.scan_documents(new, ledger)
    assert fresh.count() == 1
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found.collect()}
    assert spans == {1: [("assign", 0, 16)], 2: [], 3: [], 4: [("assign", 0, 16)], 5: [("assign", 0, 16)]}
    again, fresh = secrets.scan_documents(new, ledger, version="another")
    assert fresh.count() == 3


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "my password=hunter2hunter2 ok", 29), (2, None, None), (3, "plain", 5)], "doc_id bigint, text string, n_chars int")
    out = {r["doc_id"]: r for r in secrets.redact_documents(docs, materialize(secrets.update_ledger(docs), "ledger")).collect()}
    assert out[1]["text"] == "my [ASSIGN] ok" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[3]["text"] == "plain"
    assert secrets.redact("a SECRET b", [{"kind": "hex", "start": 2, "end": 8}, {"kind": "assign", "start": 4, "end": 9}]) == "a [HEX]b"


def test_edges(messy, empty):
    found, ledger = secrets.scan_documents(messy)
    rows = secrets.digest(found).collect()
    assert len(rows) == messy.count()
    assert ledger.count() == messy.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert secrets.redact_documents(messy, ledger).columns == messy.columns
    assert secrets.redact_documents(messy, ledger).count() == messy.count()
    assert secrets.digest(secrets.scan_documents(empty)[0]).count() == 0
    rng = random.Random(0)
    long = " ".join(rng.choice(["secret", "=", "a" * 40]) for _ in range(100_000))
    assert _base_of(long) == base(long)


def test_whole_keys():
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    for label, body in (("RSA PRIVATE KEY", head + "MIIEow/+=\nabc\n"), ("PGP PRIVATE KEY BLOCK", "Version: a-b\n\nlQdGBF\n=x1\n"), ("PRIVATE KEY", "MIIE\n")):
        key = f"-----BEGIN {label}-----\n{body}-----END {label}-----"
        for text in (f"a - b {key} c - d", f"{key}\n{key}"):
            spans = [(a, b) for a, k, b in secrets.scan_text(text) if k == secrets.KINDS.index("pem")]
            assert [text[a:b] for a, b in spans] == [key] * text.count(key)
    text = f"-----BEGIN RSA PRIVATE KEY-----\n{head}MIIEow\n- end"
    assert [text[a:b] for a, k, b in secrets.scan_text(text) if k == 3] == [text[: -len("- end")]]
