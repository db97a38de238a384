"""Banks (tables of vectors and what is known of them), query settings, and errors."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame

FLT_MIN = 1.1754943508222875e-38
MAX_DIMS, MAX_ROWS, MAX_CHANNELS, MAX_SEGMENTS = 131_072, 1 << 28, 8, 8


class BankError(ValueError):
    """Base of all errors that the engine raises itself."""


class InvalidArgument(BankError):
    pass


class DimensionMismatch(BankError):
    pass


class ZeroNormQuery(BankError):
    pass


class NonFiniteQuery(BankError):
    pass


class NonFiniteInput(BankError):
    def __init__(self, message: str, row: int | None = None):
        super().__init__(message)
        self.row = row


class ZeroNormRow(NonFiniteInput):
    pass


class UnsupportedMode(BankError):
    pass


class CapacityExceeded(BankError):
    pass


class BadFormat(BankError):
    pass


class Metric(Enum):
    DOT = "dot"
    COSINE = "cosine"
    L2 = "l2"

    @property
    def higher_is_better(self) -> bool:
        return self is not Metric.L2


class Quantization(Enum):
    FLOAT32 = "float32"
    INT8 = "int8"

    @property
    def grid(self) -> int:
        """Offsets of channels and segments are multiples of this."""
        return 4 if self is Quantization.FLOAT32 else 16


@dataclass(frozen=True)
class Channel:
    name: str
    offset: int
    length: int


@dataclass(frozen=True)
class Segment:
    offset: int
    length: int
    weight: float = 1.0


@dataclass(frozen=True)
class Bank:
    """``df`` has row_id (bigint) and vec (array<float>), or q8 (array<tinyint>) and scale (float); a cosine int8 bank
    with channels also has inv_norms (array<float>). Other columns are carried by nothing and cost nothing."""

    df: DataFrame
    dims: int
    metric: Metric
    quantization: Quantization = Quantization.FLOAT32
    channels: tuple[Channel, ...] = ()

    @property
    def is_int8(self) -> bool:
        return self.quantization is Quantization.INT8

    @property
    def padded_dims(self) -> int:
        g = self.quantization.grid
        return -(-self.dims // g) * g

    @property
    def row_bytes(self) -> int:
        return self.padded_dims * (1 if self.is_int8 else 4) + (4 if self.is_int8 else 0)

    def chunk_rows(self, chunk_bytes: int = 1 << 16) -> int:
        return max(1, chunk_bytes // self.row_bytes)

    def partitions(self, rows: int, partition_bytes: int = 64 << 20) -> int:
        """Partitions of a stored bank of so many rows."""
        return max(1, -(-rows * self.row_bytes // partition_bytes))

    def where(self, condition: Column | str) -> Bank:
        return replace(self, df=self.df.where(condition))

    def channel(self, index: int) -> Channel:
        if not 0 <= index < len(self.channels):
            raise InvalidArgument(f"no channel {index}")
        return self.channels[index]


@dataclass(frozen=True)
class QuerySpec:
    """``exclude``: a predicate on bank columns. ``bias``: (row_id, bias) or (query_id, row_id, bias), added to the score
    of the rows it names; with ``bias_group``, a whole number made of bank columns, (query_id, group, bias), added to the score
    of all rows of the group, without a table of pairs. ``exact_int``: the integer mode, for int8 banks. ``score_as_dot``: score and order by dot."""

    k: int = 10
    segments: tuple[Segment, ...] = ()
    bias: DataFrame | None = None
    bias_group: Column | str | None = None
    exclude: Column | str | None = None
    exclude_self: bool = False
    exact_int: bool = False
    score_as_dot: bool = False
    strategy: str = "auto"
    extra: dict = field(default_factory=dict)

    def metric(self, bank: Bank) -> Metric:
        return Metric.DOT if self.score_as_dot else bank.metric
