"""Sidecar banks: ``<name>.wvbank.json`` (header) beside ``<name>.wvbank.bin`` (little-endian float32, row by row)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bake import bake
from ..functions.validate import check_channels, validate_source_rows
from ..model import MAX_DIMS, MAX_ROWS, BadFormat, Bank, BankError, Channel, Metric, Quantization
from ..streaming.scratch import _Files

#: Rows of a sidecar payload; the format is for interchange, larger banks are Parquet.
PAYLOAD_BYTES = 1 << 31


def _header(text: str) -> dict:
    try:
        h = json.loads(text)
        version, dims, count = h["schemaVersion"], int(h["dims"]), int(h["count"])
        metric = Metric(str(h["metric"]).lower())
    except (KeyError, TypeError, ValueError) as e:
        raise BadFormat(f"header: {e}") from e
    if version not in (1, 2):
        raise BadFormat(f"schema version {version}")
    if h.get("dtype") != "float32" or not 0 < dims <= MAX_DIMS or not 0 <= count <= MAX_ROWS:
        raise BadFormat("dtype, dims or count")
    ids = h.get("ids")
    if ids is not None and (len(ids) != count or len(set(ids)) != count):
        raise BadFormat("ids must be unique, one a row")
    channels = tuple(Channel(c["name"], int(c["offset"]), int(c["dims"])) for c in h.get("channels") or ())
    if (version == 2) != bool(channels):
        raise BadFormat("channels belong to version 2, and version 2 has them")
    try:
        check_channels(channels, dims, Quantization.FLOAT32)
    except BankError as e:
        raise BadFormat(str(e)) from e
    return {"dims": dims, "count": count, "metric": metric, "ids": ids, "channels": channels, "description": h.get("description")}


def peek(spark: SparkSession, path: str) -> dict:
    """The header alone, checked."""
    folder, _, name = path.rpartition("/")
    return _header(_Files(spark, folder).read(f"{name}.wvbank.json"))


def write(rows: DataFrame, path: str, metric: Metric, channels: tuple[Channel, ...] = (), description: str | None = None) -> None:
    """Write (row_id, vec[, id]), in the order of row_id, as a sidecar pair. One file by format, so at most
    ``PAYLOAD_BYTES``; the payload streams through the driver a partition at a time."""
    spark = rows.sparkSession
    first = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    n, dims = first["n"], first["d"] or 0
    if n * dims * 4 > PAYLOAD_BYTES:
        raise BadFormat("too large for a sidecar; write Parquet")
    validate_source_rows(rows, dims, metric)
    check_channels(channels, dims, Quantization.FLOAT32)
    folder, _, name = path.rpartition("/")
    files = _Files(spark, folder)
    ids: list[str] | None = [] if "id" in rows.columns else None
    out = files.fs.create(files._p(f"{name}.wvbank.bin"), True)
    for r in rows.orderBy("row_id").toLocalIterator():
        out.write(bytearray(np.asarray(r["vec"], "<f4").tobytes()))
        if ids is not None:
            ids.append(r["id"])
    out.close()
    header = {"schemaVersion": 2 if channels else 1, "dims": dims, "count": n, "metric": metric.value, "dtype": "float32"}
    header |= {"description": description} if description else {}
    header |= {"ids": ids} if ids is not None else {}
    header |= {"channels": [{"name": c.name, "offset": c.offset, "dims": c.length} for c in channels]} if channels else {}
    target = files._p(f"{name}.wvbank.json")
    if files.fs.exists(target):
        files.fs.delete(target, False)
    files.write(f"{name}.wvbank.json", json.dumps(header))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(row_id, vec[, id]) and the header of a sidecar pair. Tasks read byte ranges of the payload, whole rows each."""
    h = peek(spark, path)
    dims, count, where = h["dims"], h["count"], f"{path}.wvbank.bin"
    if spark.read.format("binaryFile").load(where).select("length").first()["length"] != dims * count * 4:
        raise BadFormat("the payload has another size")
    # rows of one length, numbered in the order of the file: what only Hadoop's input format of fixed lengths reads in parts
    records = spark.sparkContext.binaryRecords(where, 4 * dims).zipWithIndex() if count else spark.sparkContext.emptyRDD()
    packed = spark.createDataFrame(records, "vec binary, row_id bigint", verifySchema=False)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("vec").to_pylist()), "<f4")
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["row_id", "vec"])

    rows = packed.mapInArrow(decode, "row_id bigint, vec array<float>")
    if h["ids"] is not None:
        names = spark.createDataFrame(list(enumerate(h["ids"])), "row_id bigint, id string")
        rows = rows.join(names, "row_id")
    return rows, h


def read_bank(spark: SparkSession, path: str, quantization: Quantization = Quantization.FLOAT32) -> Bank:
    rows, h = read(spark, path)
    return bake(rows, h["dims"], h["metric"], quantization, h["channels"], validate=True)
