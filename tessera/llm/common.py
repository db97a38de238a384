"""Helpers shared by the text operators: batch slicing and word hashing; and the library's shared storage.

Words are maximal runs of characters outside ``\\x20\\x09-\\x0D``. Word and shingle hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
import mmap
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import intermediates, kept, materialize, release, shared_dir

#: Bytes of text that a Python worker handles at once; a longer text is handled alone.
SLICE_BYTES = 4 << 20
#: The same where every byte or word has several numbers at a time.
ARRAY_BYTES = 1 << 20
#: Bytes of rows that go to a worker at a time; both the executor and the worker hold them.
BATCH_BYTES = 4 << 20
#: Longer strings are hashed one by one.
SHORT_BYTES = 64
#: A worker that holds more than so much hands back what is free after every slice.
LEAN_BYTES = 160 << 20

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of ``BATCH_BYTES``, unless the session says otherwise, whose worker hands its free memory
    back at the end of each task: workers outlive tasks, stages and queries, and the allocators keep what they once had."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, f"{BATCH_BYTES}b")

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return df.mapInArrow(lean, schema)


def _held() -> int:
    """Bytes of this process that are its own."""
    try:
        with open("/proc/self/statm") as f:
            _, resident, shared, *_ = map(int, f.read().split())
    except OSError:  # another system
        return 0
    return (resident - shared) * mmap.PAGESIZE


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_bucket(doc_id: str | Column, n: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def crc_bucket_py(doc_id, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds more than ``most`` bytes of text, except for a single longer text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
            if _held() > LEAN_BYTES:
                _trim()


def mix(x: np.ndarray) -> np.ndarray:
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the index of each word among them, and where each text's words begin (n + 1 offsets)."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    before = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=before[1:])
    coded = pc.dictionary_encode(flat.filter(pa.array(full)))
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), before[offsets]


def hash_strings(words: pa.Array) -> np.ndarray:
    """64-bit hashes of short strings, eight bytes of all at a time; longer ones are hashed one by one."""
    raw, at = text_bytes(words)
    size = np.diff(at)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(len(raw) + 1, np.uint64)  # the eight bytes from each place on
    for k in range(8):
        eight |= padded[k : k + len(eight)] << np.uint64(8 * k)
    out = mix(size.astype(np.uint64) * _GOLD)
    active = np.flatnonzero((size > 0) & (size <= SHORT_BYTES))
    for k in range(0, SHORT_BYTES, 8):
        active = active[size[active] > k]
        if not len(active):
            break
        left = np.minimum(size[active] - k, 8).astype(np.uint64)
        out[active] = mix(out[active] ^ (eight[at[active] + k] & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8)))))
    for i in np.flatnonzero(size > SHORT_BYTES):
        out[i] = xxhash.xxh3_64_intdigest(words[int(i)].as_py())
    return out


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    words, codes, offsets = split_words(texts, lower)
    return hash_strings(words)[codes], offsets


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word shingles of each text; a text of fewer words, but one at least, gives its whole sequence."""
    k = np.diff(offsets)
    counts = np.where(k >= n, k - n + 1, (k > 0).astype(np.int64))
    out_at = np.zeros(len(k) + 1, np.int64)
    np.cumsum(counts, out=out_at[1:])
    text = np.repeat(np.arange(len(k)), counts)
    start = offsets[:-1][text] + np.arange(out_at[-1]) - out_at[:-1][text]
    size = np.minimum(k, n)[text]
    acc = size.astype(np.uint64) * _GOLD
    for j in range(n):
        there = j < size
        if there.all():
            acc = mix(acc ^ hashes[start + j])
        else:
            at = np.flatnonzero(there)
            acc[at] = mix(acc[at] ^ hashes[start[at] + j])
    return acc, out_at


def distinct_per_text(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text."""
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size)
    short = len(values) < 64 * len(size) and len(size) < 1 << 20
    if short:  # many short texts: one sort of all
        key = text.astype(np.uint64) << np.uint64(44) | values >> np.uint64(20)
        order = np.argsort(key)
        key, found = key[order], values[order]
        short = not ((key[1:] == key[:-1]) & (found[1:] != found[:-1])).any()  # the key tells all values apart
    if short:
        values = found
    else:
        values = values.copy()
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            values[a:b].sort()
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(np.bincount(text[first], minlength=len(size)), out=out[1:])
    return values[first], out


def per_text_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums between offsets, 0 where nothing lies between; equal texts have equal sums wherever they lie."""
    out = np.zeros(len(offsets) - 1, values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=out.dtype)
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and n + 1 offsets."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
