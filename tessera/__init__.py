"""Exact similarity search and analytics over tables of embedding vectors, on Spark."""

from .model import Bank, Channel, Metric, Quantization, QuerySpec, Segment
from .session import session

__all__ = ["Bank", "Channel", "Metric", "Quantization", "QuerySpec", "Segment", "session"]
