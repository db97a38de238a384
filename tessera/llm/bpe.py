"""BPE encoding and decoding with a public word-level vocabulary.

Every word keeps a segment tree over the ranks of its adjacent pairs. The root names the leftmost pair of the
lowest rank; a merge changes three leaves and their ancestors, until the root holds no mergeable pair. Words of up
to ``WIDE`` symbols run side by side in numpy, one merge of each word a step; longer ones have a tree of their own.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ARRAY_BYTES, mapped, slices

WIDE = 64
#: Words whose ids each Python worker keeps; beyond that it starts anew.
CACHE_WORDS = 200_000
#: Words that are encoded at a time.
LEARN_WORDS = 8_192
#: Symbols that are merged side by side.
CELLS = 1 << 18
#: Rows of ids that are decoded at a time.
DECODE_ROWS = 256

_ODD = regex.compile("[\x1c-\x1f\x85\xa0ɐ-\U0010ffff]")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
_NONE = np.int32(2**31 - 1)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in set(plain):
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class WordBPE:
    """Encoder and decoder for a tokenizers JSON file of the word-end kind (``end_of_word_suffix``)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None:
            raise ValueError("a BPE vocabulary with word ends and no decoder is needed")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self._special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        chars = _byte_chars()
        self._chars = chars
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int32)
        self.pair_rank = {(k >> 32, k & 0xFFFFFFFF): r for r, k in enumerate(keys.tolist())}
        self._cache: dict[str, tuple[bytes, str]] = {}

    # -- merges -----------------------------------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], -1)

    def _merge_many(self, sym: np.ndarray) -> None:
        """Merge in place; ``sym`` is (words, width), -1 beyond a word's end and where a symbol was taken."""
        m, w = sym.shape
        levels = w.bit_length() - 1
        tree = np.full((m, 2 * w), _NONE, np.int32)
        a, b = sym[:, :-1], sym[:, 1:]
        rank = self._rank(a.ravel(), np.maximum(b, 0).ravel()).reshape(a.shape)
        pos = np.arange(w, dtype=np.int32)
        tree[:, w : 2 * w - 1] = np.where((rank >= 0) & (b >= 0), rank * w + pos[:-1], _NONE)
        for node in range(w - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        size = (sym >= 0).sum(1).astype(np.int32)
        nxt = np.where(pos + 1 < size[:, None], pos + 1, w).astype(np.int32)
        prv = np.broadcast_to(pos - 1, (m, w)).copy()
        tree_f, sym_f, nxt_f, prv_f = tree.reshape(-1), sym.reshape(-1), nxt.reshape(-1), prv.reshape(-1)
        act = np.arange(m)

        def put(rows: np.ndarray, at: np.ndarray, value) -> None:
            base, node = rows * (2 * w), at + w
            tree_f[base + node] = value
            for _ in range(levels):
                node >>= 1
                up = base + node
                tree_f[up] = np.minimum(tree_f[up + node], tree_f[up + node + 1])

        while True:
            root = tree_f[act * (2 * w) + 1]
            live = root != _NONE
            if not live.all():
                act, root = act[live], root[live]
            if not len(act):
                return
            at, row = (root % w).astype(np.int64), act * w
            new = self.merged[root // w]
            gone = nxt_f[row + at].astype(np.int64)
            after = nxt_f[row + gone].astype(np.int64)
            sym_f[row + at], sym_f[row + gone] = new, -1
            nxt_f[row + at] = after
            put(act, gone.copy(), _NONE)
            inside = after < w
            prv_f[(row + after)[inside]] = at[inside]
            rank = self._rank(new, sym_f[np.where(inside, row + after, 0)])
            put(act, at.copy(), np.where(inside & (rank >= 0), rank * w + at, _NONE))
            before = prv_f[row + at].astype(np.int64)
            has = before >= 0
            if has.any():
                p, r = before[has], act[has]
                rank = self._rank(sym_f[r * w + p], new[has])
                put(r, p.copy(), np.where(rank >= 0, rank * w + p, _NONE))

    def _merge_one(self, sym: np.ndarray) -> list[int]:
        """The same for one long word: a tree in an array of rank * w + place, O(log n) a merge."""
        n, none = len(sym), 1 << 62
        w = 1 << max(1, (n - 1).bit_length())
        rank = self._rank(sym[:-1], sym[1:]).astype(np.int64)
        levels = [np.full(w, none, np.int64)]
        levels[0][: n - 1] = np.where(rank >= 0, rank * w + np.arange(n - 1), none)
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][0::2], levels[-1][1::2]))
        tree = array("q", [none])  # node 1 is the root
        for level in reversed(levels):
            tree.frombytes(level.tobytes())
        del levels, rank
        sym, nxt, prv = array("i", sym.tolist()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        nxt[n - 1] = -1
        get, merged = self.pair_rank.get, self.merged

        def leaf(i: int, j: int) -> int:
            r = get((sym[i], sym[j]))
            return none if r is None else r * w + i

        def put(i: int, value: int) -> None:
            node = w + i
            tree[node] = value
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    return
                tree[node] = best

        while tree[1] != none:
            rank, i = divmod(tree[1], w)
            j = nxt[i]
            sym[i], sym[j] = int(merged[rank]), -1
            nxt[i] = k = nxt[j]
            put(j, none)
            if k >= 0:
                prv[k] = i
            put(i, leaf(i, k) if k >= 0 else none)
            if prv[i] >= 0:
                put(prv[i], leaf(prv[i], i))
        return [s for s in sym if s >= 0]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and n + 1 offsets; each piece is one word of the pre-tokenizer."""
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        data = np.frombuffer(b"".join(raw), np.uint8)
        flat = self.inner[data]
        if len(raw):
            flat[at[1:] - 1] = self.last[data[at[1:] - 1]]
        width = 2
        while width <= WIDE:
            rows = np.flatnonzero((size <= width) & (size > (width // 2 if width > 2 else 1)))
            for part in np.array_split(rows, max(1, -(-len(rows) * width // CELLS))) if len(rows) else ():
                col = np.arange(width)
                inside = col < size[part][:, None]
                where = at[part][:, None] + col
                sym = np.full((len(part), width), -1, np.int32)
                sym[inside] = flat[where[inside]]
                self._merge_many(sym)
                flat[where[inside]] = sym[inside]
            width *= 2
        for i in np.flatnonzero(size > WIDE):
            done = self._merge_one(flat[at[i] : at[i + 1]])
            flat[at[i] : at[i + 1]] = done + [-1] * (size[i] - len(done))
        keep = flat >= 0
        kept = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        return flat[keep].astype("<u4"), kept[at]

    # -- texts ------------------------------------------------------------------------------------------------

    def _chunks(self, text: str) -> list[str]:
        """The blank-separated parts of the normalised text."""
        if _ODD.search(text) is None:  # below U+0250 without odd blanks: already NFC, and lower() agrees
            return text.lower().split()
        return [c for c in self.normalizer.normalize_str(text).split(" ") if c]

    def _pieces(self, chunk: str) -> list[str]:
        if _ODD.search(chunk) is None:
            return _PIECE.findall(chunk)
        back = {c: b for b, c in enumerate(self._chars)}
        return [bytes(back[c] for c in p).decode() for p, _ in self.pre_tokenizer.pre_tokenize_str(chunk)]

    def _learn(self, chunks: list[str]) -> None:
        pieces, counts = [], []
        for c in chunks:
            found = self._pieces(c)
            pieces += found
            counts.append(len(found))
        ids, at = self.encode_pieces(pieces)
        data, listed, token, k, cache = ids.tobytes(), ids.tolist(), self.token, 0, self._cache
        for c, n in zip(chunks, counts, strict=True):
            a, b = int(at[k]), int(at[k + n])
            cache[c] = (data[4 * a : 4 * b], " ".join([token[i] for i in listed[a:b]]))
            k += n

    def encode_texts(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        parts: list[list] = []
        for text in texts:
            text = text or ""
            if self._special_re.search(text) is None:
                parts.append(self._chunks(text))
                continue
            row, last = [], 0
            for m in self._special_re.finditer(text):
                row += self._chunks(text[last : m.start()])
                row.append((m.group(),))
                last = m.end()
            parts.append(row + self._chunks(text[last:]))
        cache = self._cache
        fresh = {c for row in parts for c in row if c not in cache and not isinstance(c, tuple)}
        if len(cache) + len(fresh) > CACHE_WORDS:
            cache.clear()
            fresh = {c for row in parts for c in row if not isinstance(c, tuple)}
        fresh = list(fresh)
        for at in range(0, len(fresh), LEARN_WORDS):
            self._learn(fresh[at : at + LEARN_WORDS])
        for s, i in self.special.items():
            cache[(s,)] = (np.array([i], "<u4").tobytes(), s)
        out = []
        for row in parts:
            got = [cache[c] for c in row]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])))
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens with a blank between each two, as the library joins them where no decoder is given."""
        return " ".join([self.token[i] for i in ids if i in self.token])


_LOADED: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Encode whole texts, and decode what was encoded.

    ``vocabulary`` is a path that every executor can open. Returns id_col, n_tokens, [token_ids if ``ids``], ids_sha256,
    decoded_sha256. A null or empty text gives no ids and the digests of nothing; repeated rows and null ids give a row
    each; texts of any length are encoded whole; an empty table gives none; other columns are ignored.
    """
    source = docs.select(id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, {'token_ids array<int>, ' if ids else ''}ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in slices(batches, text_col, ARRAY_BYTES):
            done = bpe.encode_texts(batch.column(text_col).to_pylist())
            columns = [batch.column(id_col), pa.array([len(x) // 4 for x, _ in done], pa.int64())]
            if ids:
                flat = np.frombuffer(b"".join(x for x, _ in done), "<u4").astype(np.int32)
                at = np.cumsum([0, *(len(x) // 4 for x, _ in done)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(flat)))
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x, _ in done]), pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in done])]
            names = [id_col, "n_tokens", *["token_ids"] * ids, "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(source, run, schema)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Decode ``ids_col`` back to text: id_col, decoded. Null ids give an empty text; repeated rows each have a row; an empty table
    gives none; other columns are ignored."""
    source = encoded.select(id_col, ids_col)
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(at, DECODE_ROWS)
                texts = [bpe.decode(x.as_py() or []) for x in part.column(ids_col)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return mapped(source, run, f"`{id_col}` {kind}, decoded string")
