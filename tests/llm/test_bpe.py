from __future__ import annotations

import hashlib
import random
import struct

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe
from tessera.llm.queries import op1_bpe, vocabulary


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


T, W = library(), bpe.load(vocabulary())


def expected(text: str) -> tuple[list[int], str]:
    ids = T.encode(text, add_special_tokens=False).ids
    return ids, T.decode(ids, skip_special_tokens=False)


def check(text: str) -> None:
    data, decoded = W.encode_texts([text])[0]
    ids, want = expected(text)
    assert list(struct.unpack(f"<{len(data) // 4}I", data)) == ids
    assert decoded == want == W.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "it's", "I'LL", "don't", "  ", "\n", "İstanbul", "ﬁ", "é", "à́", "123", "x" * 70, "$%", " ", "\x85", "中文字", "ÀÉ", "😀😀", "'", "ǅ", "Σς"]), max_size=8).map("".join))
def test_odd_pieces(text):
    check(text)


def test_long_words_use_one_tree():
    rng = random.Random(1)
    for n in (63, 64, 65, 130, 5_000):
        check("".join(rng.choice("etaoinshr") for _ in range(n)))
    check("the" * 20_000)


def test_merges_follow_the_lowest_rank_leftmost():
    """The segment trees against a scan for the least rank at each step."""
    rng = random.Random(2)
    for _ in range(60):
        word = "".join(rng.choice("abcdeinrst") for _ in range(rng.randint(2, 90)))
        raw = word.encode()
        sym = [int(W.inner[b]) for b in raw[:-1]] + [int(W.last[raw[-1]])]
        while True:
            ranked = [(W.pair_rank.get(p, 1 << 60), i) for i, p in enumerate(zip(sym, sym[1:], strict=False))]
            if not ranked or min(ranked)[0] == 1 << 60:
                break
            rank, i = min(ranked)
            sym[i : i + 2] = [int(W.merged[rank])]
        assert W.encode_pieces([word])[0].tolist() == sym


def test_query_on_documents(spark, sf, documents):
    got = {r["doc_id"]: r for r in op1_bpe(spark, sf).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids, decoded = expected(r["text"] or "")
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_edges_and_round_trip(messy, empty):
    enc = bpe.encode(messy, vocabulary())
    rows = enc.collect()
    assert len(rows) == messy.count()
    for r in messy.select("doc_id", "text").distinct().collect():
        ids, _ = expected(r["text"] or "")
        assert any(x["doc_id"] == r["doc_id"] and list(x["token_ids"]) == ids for x in rows)
    decoded = bpe.decode(enc.where("doc_id is not null"), vocabulary()).collect()
    digest = {r["doc_id"]: r["decoded_sha256"] for r in rows}
    assert all(hashlib.sha256(d["decoded"].encode()).hexdigest() == digest[d["doc_id"]] for d in decoded)
    assert bpe.encode(empty, vocabulary()).count() == 0
