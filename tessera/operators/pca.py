"""Principal components by power iteration. Up to ``MAX_DIMS`` lanes: one pass for the mean and the Gram matrix, and iterations
on the driver (dims x dims). Beyond: a pass over the rows for each iteration, which moves a vector of dims for each task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dequantized
from ..model import Bank, InvalidArgument
from ..plans.block import matrix

#: The Gram matrix of so many dims is held on the driver (8 bytes squared).
MAX_DIMS = 4096


def _lanes(bank: Bank) -> DataFrame:
    return bank.df.select("row_id", (dequantized(F.col("q8"), F.col("scale")) if bank.is_int8 else F.col("vec")).alias("vec"))


def principal_components(bank: Bank, components: int, iterations: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(mean, components x dims). Component c starts at the unit vector of lane c mod dims and is kept orthogonal to
    those before it; a direction without variance gives zeros."""
    d = bank.dims
    if not 0 < components <= d:
        raise InvalidArgument(f"{components} components of {d} dims")

    if d > MAX_DIMS:
        n, mean = _sums(bank, lambda x: (len(x), x.sum(0)))
        if not n:
            return np.zeros(d), np.zeros((components, d))
        mean = mean / n
        return mean, _iterated(lambda v: _sums(bank, lambda x: (len(x), ((x - mean) @ v) @ (x - mean)))[1] / n, d, components, iterations)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vec"), np.float64)
                n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
        lanes = np.arange(d + 1, dtype=np.int32)
        values = np.vstack([np.append(total, float(n))[None, :d], square])
        yield pa.RecordBatch.from_arrays([pa.array(lanes), pa.array([n] * (d + 1), pa.int64()), pa.array(list(values), pa.list_(pa.float64()))], names=["lane", "n", "sums"])

    parts = _lanes(bank).select("vec").mapInArrow(gram, "lane int, n bigint, sums array<double>")
    flat = parts.select("lane", "n", F.posexplode("sums").alias("pos", "x")).groupBy("lane", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toPandas()
    sums = np.zeros((d + 1, d))
    sums[flat["lane"], flat["pos"]] = flat["x"]
    n = int(flat["n"].iloc[0]) if len(flat) else 0
    if not n:
        return np.zeros(d), np.zeros((components, d))
    mean = sums[0] / n
    covariance = sums[1:] / n - np.outer(mean, mean)
    return mean, _iterated(lambda v: covariance @ v, d, components, iterations)


def _iterated(times: Callable[[np.ndarray], np.ndarray], d: int, components: int, iterations: int) -> np.ndarray:
    """Components of the covariance that ``times`` multiplies by."""
    found = np.zeros((components, d))
    for c in range(components):
        v = np.zeros(d)
        v[c % d] = 1.0
        for _ in range(iterations):
            w = times(v)
            w -= found[:c].T @ (found[:c] @ w)
            size = np.linalg.norm(w)
            if size <= 1e-12:
                v = np.zeros(d)
                break
            v = w / size
        found[c] = v
    return found


def _sums(bank: Bank, of: Callable[[np.ndarray], tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """The sums of ``of`` (a count and a vector of dims) over batches of rows."""
    d = bank.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d)
        for batch in batches:
            if batch.num_rows:
                more, vector = of(matrix(batch.column("vec"), np.float64))
                n, total = n + more, total + vector
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["n", "total"])

    parts = _lanes(bank).select("vec").mapInArrow(run, "n bigint, total array<double>")
    flat = parts.select("n", F.posexplode("total").alias("pos", "x")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toPandas()
    total = np.zeros(d)
    total[flat["pos"]] = flat["x"]
    return (int(flat["n"].iloc[0]) if len(flat) else 0), total


def projected(bank: Bank, mean: np.ndarray, components: np.ndarray) -> DataFrame:
    """Coordinates of every row: row_id, component, coord (double)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(components)
        for batch in batches:
            if batch.num_rows:
                x = (matrix(batch.column("vec"), np.float64) - mean) @ components.T
                ids = np.repeat(batch.column("row_id").to_numpy(), c)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(c, dtype=np.int32), len(x))), pa.array(x.reshape(-1))], names=["row_id", "component", "coord"])

    return _lanes(bank).mapInArrow(run, "row_id bigint, component int, coord double")
