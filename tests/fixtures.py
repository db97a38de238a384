"""Five int8 banks and eight queries that strain the integer mode: ordinary ones, channels, tiny scales, cancelling distances."""

from __future__ import annotations

import numpy as np

from tessera import Bank, Channel, Metric, Quantization
from tessera.functions.bake import with_channels

SHAPES = {"A": (64, 48, Metric.DOT), "B": (64, 64, Metric.COSINE), "C": (48, 32, Metric.L2), "D": (32, 32, Metric.DOT), "E": (32, 32, Metric.L2)}


def scales(name: str, rng: np.random.Generator) -> np.ndarray:
    n = SHAPES[name][0]
    u = rng.random(n)
    if name in "ABC":
        low, width = {"A": (0.001, 0.019), "B": (0.005, 0.01), "C": (0.002, 0.015)}[name]
        out = low + width * u
    elif name == "D":  # scores lie on both sides of the least normal float; the last scales are subnormal themselves
        out = 2.0 ** -(88 + np.arange(n))
        out[28:] = [2.0**-127, 2.0**-130, 3 * 2.0**-140, 2.0**-149]
    else:
        out = 2.0 ** -(60 + np.arange(n))
    return out.astype(np.float32)


def lanes(name: str) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(ord(name))
    rows, dims, _ = SHAPES[name]
    return rng.integers(-127, 128, (rows, dims)).astype(np.int8), scales(name, rng)


def bank(spark, name: str) -> Bank:
    """The rows are not normalised, bank B's neither."""
    q8, scale = lanes(name)
    rows, dims, metric = SHAPES[name]
    df = spark.createDataFrame([(i, q8[i].tolist(), float(scale[i])) for i in range(rows)], "row_id bigint, q8 array<tinyint>, scale float")
    made = Bank(df, dims, metric, Quantization.INT8)
    return with_channels(made, tuple(Channel(f"c{k}", 16 * k, 16) for k in range(4))) if name == "B" else made


def queries() -> np.ndarray:
    """Five ordinary ones, one of small lanes, one with subnormal lanes, one of large lanes."""
    rng = np.random.default_rng(99)
    q = rng.uniform(-1, 1, (8, 64))
    q[5] *= 127 * 2.0**-40
    q[6] *= 127 * 2.0**-52
    q[6, ::3] = 2.0**-140
    q[7] *= 2.0**30
    return q.astype(np.float32)
