"""Block scan: batches of queries against batches of rows in numpy, a bounded top-k in each task.

A matrix product in float32 gives a lower bound of every pair's score (turned so that less is better): the product less more
than its rounding errors can be. Only pairs whose bound reaches the k best so far are scored exactly, one dimension after
another, as the column expressions do; so both strategies give the same doubles. The bank stays where it is; queries go to
it. Queries of ``BROADCAST_BYTES`` or less travel as a broadcast; more of them are packed into blocks, and blocks of queries
meet blocks of bank rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
#: Bytes of packed queries that one task of a blocked scan meets.
QUERY_BYTES = 256 << 20
QUERY_BLOCK, ROW_BLOCK = 1024, 2048
#: Blocks of queries that a blocked scan sends at a time.
SENT_BLOCKS = 4
#: Queries that a scan broadcasts; a task finds k rows anew for each, so more are dealt to tasks.
BROADCAST_QUERIES = 8192
#: Lanes (doubles) that are scored exactly at a time.
EXACT_LANES = 1 << 20
#: Biases of pairs that a part of a batch of rows has at most, but for a single row's.
BIAS_PAIRS = 1 << 20
#: Doubles of a task's best scores of queries in groups, before they are handed on.
GROUP_CELLS = 4 << 20


class Scorer(Protocol):
    sign: float  # -1 where a higher score is better

    def left(self, q: dict) -> np.ndarray | None:
        """Lanes of queries such that ``left @ right.T`` is a lower bound of sign * score, in float32 or float64; none where
        numbers are too large or too small for either."""

    def right(self, b: dict) -> np.ndarray | None: ...

    def adjust(self, lower: np.ndarray, q: dict, b: dict) -> None:
        """Adds to the bounds what depends on both a query and a row."""

    def pairs(self, q: dict, i: np.ndarray, b: dict, j: np.ndarray) -> np.ndarray:
        """The exact scores of pairs of queries i and rows j."""

    def all(self, q: dict, b: dict) -> np.ndarray:
        """The exact scores of all pairs, without bias."""


def matrix(column, dtype=None) -> np.ndarray:
    """A list column as rows x lanes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values.reshape(n, -1) if n else values.reshape(0, 0), dtype)


def columns(batch) -> dict[str, np.ndarray]:
    """Columns as arrays: lists of equal lengths as matrices, those named ``_bias...`` as arrays of arrays (or None)."""
    out = {}
    for name in batch.schema.names:
        c = batch.column(name)
        lists = pa.types.is_list(c.type) or pa.types.is_large_list(c.type)
        out[name] = matrix(c) if lists and not name.startswith("_bias") else c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False)
    return out


def rows_of(data: dict[str, np.ndarray], at) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in data.items()}


def sequential_dot(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    acc = np.zeros((len(q), len(b)))
    bt = np.ascontiguousarray(b.T)
    for j in range(q.shape[1]):
        acc += q[:, j, None] * bt[j]
    return acc


def sequential_l2(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    acc = np.zeros((len(q), len(b)))
    bt = np.ascontiguousarray(b.T)
    for j in range(q.shape[1]):
        t = q[:, j, None] - bt[j]
        acc += t * t
    return acc


def paired_dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in the order of dimensions."""
    acc = np.zeros(len(x))
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
        acc += a * b
    return acc


def paired_l2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(x))
    for t in np.ascontiguousarray((x - y).T):
        acc += t * t
    return acc


def safe(lanes: np.ndarray) -> np.ndarray | None:
    """Lanes in the narrowest type whose products neither overflow nor underflow; none if no type will do."""
    size = np.sqrt((lanes * lanes).sum(1))
    if not np.isfinite(size).all():
        return None
    some = size[size > 0]
    low, high = (some.min(), some.max()) if len(some) else (1.0, 1.0)
    if low >= 1e-10 and high <= 1e10:
        return lanes.astype(np.float32)
    return lanes if low >= 1e-100 and high <= 1e100 else None


class TopK:
    """The k best (score, row) of each query under the total order; merging is independent of order."""

    def __init__(self, queries: int, k: int, sign: float):
        self.k, self.sign = k, sign
        self.score = np.full((queries, k), np.inf)
        self.row = np.full((queries, k), np.iinfo(np.int64).max)

    def meet(self, lower: np.ndarray, rows: np.ndarray, lanes: int, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Take in rows whose scores times ``sign`` are ``lower`` or more; NaN marks pairs that do not count."""
        fresh = np.flatnonzero(np.isinf(self.score[:, -1]))
        if len(fresh) and lower.shape[1] > 2 * self.k:  # exact scores of some k rows bound the rest
            some = lower[fresh]
            kth = np.partition(some, self.k - 1, axis=1)[:, self.k - 1]  # NaN, the last in order, if fewer count
            at = np.flatnonzero(some <= np.where(np.isnan(kth), np.array(np.inf, lower.dtype), kth)[:, None])
            i, j = fresh[at // lower.shape[1]], at % lower.shape[1]
            self._push(i, j, rows, lanes, exact)
            lower[i, j] = np.nan
        bound = self.score[:, -1].astype(lower.dtype)
        bound = np.where(bound < self.score[:, -1], np.nextafter(bound, np.array(np.inf, lower.dtype)), bound)
        with np.errstate(invalid="ignore"):
            reach = np.flatnonzero(~(lower.min(1, initial=np.inf) > bound))  # few queries, once many rows are seen; all with a NaN
        if len(reach):
            some = lower if len(reach) == len(lower) else lower[reach]
            at = np.flatnonzero(some <= bound[reach, None])  # of one dimension: of two it takes longer than the product
            if len(at):
                self._push(reach[at // lower.shape[1]], at % lower.shape[1], rows, lanes, exact)

    def _push(self, i: np.ndarray, j: np.ndarray, rows: np.ndarray, lanes: int, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        step = max(64, EXACT_LANES // max(1, lanes))
        for at in range(0, len(i), step):
            ii, jj = i[at : at + step], j[at : at + step]
            s = exact(ii, jj) * self.sign
            keep = s <= self.score[ii, -1]  # not where s is NaN
            ii, s, r = ii[keep], s[keep], rows[jj[keep]]
            touched, q = np.unique(ii, return_inverse=True)
            n = len(touched)
            q = np.concatenate([np.repeat(np.arange(n), self.k), q])
            s, r = np.concatenate([self.score[touched].reshape(-1), s]), np.concatenate([self.row[touched].reshape(-1), r])
            order = np.lexsort((r, s, q))
            best = order[np.searchsorted(q[order], np.arange(n))[:, None] + np.arange(self.k)]
            self.score[touched], self.row[touched] = s[best], r[best]

    def hits(self, query_ids: np.ndarray) -> pa.RecordBatch:
        full = self.row < np.iinfo(np.int64).max
        ids = np.broadcast_to(np.asarray(query_ids)[:, None], full.shape)[full]
        return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(self.row[full]), pa.array(self.score[full] * self.sign)], names=["query_id", "row_id", "score"])


HITS = "query_id bigint, row_id bigint, score double"


class _Block:
    """A block of queries, its lanes and its best rows so far."""

    def __init__(self, queries: dict, scorer: Scorer, k: int):
        self.queries, self.scorer = queries, scorer
        self.left = scorer.left(queries)
        self.ids = queries["query_id"]
        self.order = np.argsort(self.ids, kind="stable")
        self.top = TopK(len(self.ids), k, scorer.sign)

    def lower(self, rows: dict, right: np.ndarray | None) -> np.ndarray:
        if self.left is None or right is None:
            return np.full((len(self.ids), len(rows["row_id"])), -np.inf)
        out = self.left @ right.T
        self.scorer.adjust(out, self.queries, rows)
        return out

    def meet(self, rows: dict, right: np.ndarray | None, exclude_self: bool) -> None:
        lower = self.lower(rows, right)
        if exclude_self and len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, rows["row_id"], sorter=self.order), len(self.ids) - 1)
            own = np.flatnonzero(self.ids[self.order[at]] == rows["row_id"])
            lower[self.order[at[own]], own] = np.nan
        self.top.meet(lower, rows["row_id"], _lanes(self.queries), lambda i, j: self.scorer.pairs(self.queries, i, rows, j))


def _lanes(data: dict) -> int:
    return max((v.shape[1] for v in data.values() if v.ndim == 2), default=1)


def _cut(rows: dict) -> Iterator[dict]:
    n = len(rows["row_id"])
    step = max(64, min(ROW_BLOCK, (4 << 20) // max(1, _lanes(rows))))
    lists = rows.get("_bias_of", ())
    pairs = np.cumsum([0, *(0 if x is None else len(x) for x in lists)]) if len(lists) else np.zeros(n + 1, np.int64)
    at = 0
    while at < n:
        most = int(np.searchsorted(pairs, pairs[at] + BIAS_PAIRS, side="right")) - 1
        end = min(n, at + step, max(at + 1, most))
        yield rows_of(rows, slice(at, end))
        at = end


def _merge(blocks: list[_Block], rows: dict, scorer: Scorer, exclude_self: bool) -> None:
    for part in _cut(rows):
        right = scorer.right(part)
        for block in blocks:
            block.meet(part, right, exclude_self)


def scan(bank: DataFrame, queries: DataFrame, scorer: Scorer, k: int, exclude_self: bool, bytes_a_query: int) -> DataFrame:
    """The k best rows of each query in each task's part of the bank, as (query_id, row_id, score).

    ``bank`` has row_id and what the scorer reads, ``queries`` query_id (each once) and what the scorer reads.
    """
    some = _held(queries, bytes_a_query, BROADCAST_QUERIES)
    if some is not None:
        return _broadcast_scan(bank, some, scorer, k, exclude_self)
    return _blocked_scan(bank, queries, scorer, k, exclude_self, bytes_a_query)


def _held(queries: DataFrame, bytes_a_query: int, most: int | None = None) -> dict | None:
    """The queries, unless they are too many to be broadcast."""
    most = min(max(1, BROADCAST_BYTES // max(1, bytes_a_query)), most or 1 << 31)
    some = queries.limit(most + 1).toArrow()
    return columns(some) if some.num_rows <= most else None


def _broadcast_scan(bank: DataFrame, queries: dict, scorer: Scorer, k: int, exclude_self: bool) -> DataFrame:
    if not len(queries["query_id"]):
        return bank.sparkSession.createDataFrame([], HITS)
    shared = bank.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value["query_id"])
        blocks = [_Block(rows_of(shared.value, slice(a, a + QUERY_BLOCK)), scorer, k) for a in range(0, n, QUERY_BLOCK)]
        for batch in batches:
            if batch.num_rows:
                _merge(blocks, columns(batch), scorer, exclude_self)
        for block in blocks:
            yield block.top.hits(block.ids)

    return bank.mapInArrow(run, HITS)


def fused_scan(bank: DataFrame, queries: DataFrame, scorer: Scorer, finish: Callable[[np.ndarray, dict], np.ndarray], k: int, bytes_a_query: int) -> DataFrame | None:
    """The k best rows of each task by the worst of their scores under all queries, as (query_id 0, row_id, score).

    ``finish`` takes the fused scores. A row meets all queries in one task, so nothing but hits is shuffled. None if the
    queries are too many to be broadcast."""
    some = _held(queries, bytes_a_query)
    if some is None:
        return None
    shared = bank.sparkSession.sparkContext.broadcast(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, n = TopK(1, k, scorer.sign), len(shared.value["query_id"])
        blocks = [_Block(rows_of(shared.value, slice(a, a + QUERY_BLOCK)), scorer, 1) for a in range(0, n, QUERY_BLOCK)]
        for batch in batches:
            for part in _cut(columns(batch)) if batch.num_rows else ():
                right, least = scorer.right(part), None
                for block in blocks:
                    now = block.lower(part, right).max(0)
                    least = now if least is None else np.maximum(least, now)

                def exact(_, j, part=part):
                    some = rows_of(part, j)
                    return finish(_worst(scorer, (b.queries for b in blocks), some), some)[0]

                top.meet(least[None, :], part["row_id"], _lanes(shared.value) * n, exact)
        yield top.hits(np.zeros(1, np.int64))

    return bank.mapInArrow(run, HITS)


def _worst(scorer: Scorer, blocks: Iterator[dict], rows: dict) -> np.ndarray:
    """The worst score of each row under the queries of all blocks, as one line."""
    worst, both = (np.min, np.minimum) if scorer.sign < 0 else (np.max, np.maximum)
    fused = None
    for q in blocks:
        now = worst(scorer.all(q, rows), axis=0, keepdims=True)
        fused = now if fused is None else both(fused, now)
    return fused


def _packed(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Batches of ``df`` as single rows (name): the Arrow stream of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                sink = pa.BufferOutputStream()
                part = batch.slice(at, rows)
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[name])

    return df.mapInArrow(run, f"`{name}` binary")


def _unpacked(blob: bytes) -> dict[str, np.ndarray]:
    return columns(pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0])


def _grid(bank: DataFrame, queries: DataFrame, bytes_a_query: int, by_queries: bool = False) -> DataFrame:
    """Blocks of rows and blocks of queries (rows, block, no: the query block's number). A task has some blocks of rows and
    all blocks of a part of the queries; both sides are shuffled once, as blocks. ``by_queries`` deals the queries to tasks
    and leaves the bank in parts as large as those of queries may be: a query then keeps its hits in few tasks."""
    n, sent = queries.count(), QUERY_BLOCK
    parts = max(1, -(-n * bytes_a_query // QUERY_BYTES))
    tasks = int(bank.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if by_queries:
        tasks = max(tasks, 2 * bank.sparkSession.sparkContext.defaultParallelism)
        sent *= min(SENT_BLOCKS, max(1, n // (tasks * QUERY_BLOCK)))
        of_bank = max(1, -(-bank.count() * bytes_a_query // (2 * QUERY_BYTES)))
        parts = max(parts, min(-(-tasks // of_bank), -(-n // sent)))
    q = _packed(queries, sent, "block").withColumn("no", F.monotonically_increasing_id()).repartition(parts)
    b = _packed(bank, 4 * ROW_BLOCK, "rows").repartition(max(1, -(-tasks // parts)))
    return b.crossJoin(q.hint("shuffle_replicate_nl"))


def _met(batches: Iterator[pa.RecordBatch], make: Callable[[dict], object]) -> Iterator[tuple[dict, object, int]]:
    """(rows, what ``make`` made of the query block once, number of the query block) of all pairs of blocks in a task."""
    blocks: dict[int, object] = {}
    last, rows = None, None
    for batch in batches:
        for packed, block, no in zip(batch.column("rows"), batch.column("block"), batch.column("no").to_pylist(), strict=True):
            if no not in blocks:
                blocks[no] = make(_unpacked(block.as_py()))
            packed = packed.as_py()
            if packed != last:
                last, rows = packed, _unpacked(packed)
            yield rows, blocks[no], no


def _blocked_scan(bank: DataFrame, queries: DataFrame, scorer: Scorer, k: int, exclude_self: bool, bytes_a_query: int) -> DataFrame:
    """Every block of queries meets every block of rows. An exact scan scores all pairs; here a pair of blocks, not of rows,
    is a row of the plan, and a task keeps k hits of each of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[_Block]] = {}
        last, parts = None, []
        for rows, sent, no in _met(batches, make):
            if rows is not last:
                last, parts = rows, [(part, scorer.right(part)) for part in _cut(rows)]
            blocks[no] = sent
            for block in sent:
                for part, right in parts:
                    block.meet(part, right, exclude_self)
        for sent in blocks.values():
            for block in sent:
                yield block.top.hits(block.ids)

    def make(q: dict) -> list[_Block]:
        return [_Block(rows_of(q, slice(a, a + QUERY_BLOCK)), scorer, k) for a in range(0, len(q["query_id"]), QUERY_BLOCK)]

    return _grid(bank, queries, bytes_a_query, by_queries=True).mapInArrow(run, HITS)


def worst_scan(bank: DataFrame, queries: DataFrame, scorer: Scorer, bytes_a_query: int) -> DataFrame:
    """(row_id, score): the worst score of each row under a part of the queries, a row for each part."""
    worst = np.minimum if scorer.sign < 0 else np.maximum

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(now["row_id"]), pa.array(fused)], names=["row_id", "score"])

        now, fused = None, None
        for rows, q, _ in _met(batches, lambda q: q):
            if rows is not now:
                if now is not None:
                    yield done()
                now, fused = rows, None
            here = np.concatenate([_worst(scorer, iter([q]), part)[0] for part in _cut(rows)])
            fused = here if fused is None else worst(fused, here)
        if now is not None:
            yield done()

    return _grid(bank, queries, bytes_a_query).mapInArrow(run, "row_id bigint, score double")


def group_best(bank: DataFrame, queries: DataFrame, scorer: Scorer, group: str, bytes_a_query: int) -> DataFrame:
    """The best score of each query in each group of rows: query_id, group_id, score. ``bank`` has ``group`` and what the
    scorer reads; a task yields a row for each query and group in it, merged by a grouped maximum or minimum."""
    higher = scorer.sign < 0
    reduce, both = (np.maximum.reduceat, np.maximum) if higher else (np.minimum.reduceat, np.minimum)
    schema = "query_id bigint, group_id bigint, score double"

    class Best:
        def __init__(self, q: dict):
            self.q, self.groups, self.found = q, np.zeros(0, np.int64), np.zeros((len(q["query_id"]), 0))

        def meet(self, rows: dict) -> Iterator[pa.RecordBatch]:
            for part in _cut(rows):
                part = rows_of(part, np.argsort(part[group], kind="stable"))
                groups, starts = np.unique(part[group], return_index=True)
                found = reduce(scorer.all(self.q, part), starts, axis=1)
                every = np.union1d(self.groups, groups)
                now = np.full((len(found), len(every)), -np.inf if higher else np.inf)
                now[:, np.searchsorted(every, self.groups)] = self.found
                at = np.searchsorted(every, groups)
                now[:, at] = both(now[:, at], found)
                self.groups, self.found = every, now
                if now.size > GROUP_CELLS:
                    yield from self.done()

        def done(self) -> Iterator[pa.RecordBatch]:
            n = len(self.groups)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.q["query_id"], n)), pa.array(np.tile(self.groups, len(self.found)).astype(np.int64)), pa.array(self.found.reshape(-1))], names=["query_id", "group_id", "score"])
            self.groups, self.found = np.zeros(0, np.int64), np.zeros((len(self.found), 0))

    some = _held(queries, bytes_a_query)
    if some is not None:
        if not len(some["query_id"]):
            return bank.sparkSession.createDataFrame([], schema)
        shared = bank.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = len(shared.value["query_id"])
            blocks = [Best(rows_of(shared.value, slice(at, at + QUERY_BLOCK))) for at in range(0, n, QUERY_BLOCK)]
            for batch in batches:
                if batch.num_rows:
                    rows = columns(batch)
                    for block in blocks:
                        yield from block.meet(rows)
            for block in blocks:
                yield from block.done()

        partial = bank.mapInArrow(run, schema)
    else:

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks: dict[int, Best] = {}
            for rows, block, no in _met(batches, Best):
                blocks[no] = block
                yield from block.meet(rows)
            for block in blocks.values():
                yield from block.done()

        partial = _grid(bank, queries, bytes_a_query).mapInArrow(meet, schema)
    merged = F.max("score") if higher else F.min("score")
    return partial.groupBy("query_id", "group_id").agg(merged.alias("score"))
