"""A mutable bank as a versioned table: append, remove, snapshot, grow, relabel, freeze, recall.

Each change writes new Parquet folders and then a new manifest, the last thing written; readers hold a version and never
see a half-done change. All paths go through Hadoop's file system, so the bank can live in any store that Spark reads.
One writer at a time; replays of a stream's batch are recognised by its number.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bake import bake, quantized, quantized_queries, rows_as_queries, with_channels
from ..functions.ids import dense_ids
from ..functions.validate import bad_bank_rows, check_channels, validate_source_rows
from ..functions.vectors import dot
from ..model import MAX_DIMS, MAX_ROWS, BadFormat, Bank, CapacityExceeded, Channel, InvalidArgument, Metric, Quantization, QuerySpec, UnsupportedMode
from ..operators.query import query_batch
from ..storage import intermediates, materialize

FORMAT = 3
#: Below so many live rows a recall says little.
INFORMATIVE_ROWS = 100
RECALL_SEED = 20_240_917


@dataclass(frozen=True)
class Manifest:
    version: int
    dims: int
    metric: str
    quantization: str
    capacity: int
    count: int = 0
    generation: int = 0
    retains_floats: bool = False
    channels: tuple = ()
    data: tuple[str, ...] = ()
    removed: tuple[str, ...] = ()
    last_batch: int = -1
    format: int = FORMAT


class _Files:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def write(self, name: str, text: str) -> None:
        """Create ``name``; an existing file means another writer was faster."""
        out = self.fs.create(self._p(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        stream = self.fs.open(self._p(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def versions(self) -> list[int]:
        if not self.fs.exists(self._p("manifest")):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self.fs.listStatus(self._p("manifest")) if s.getPath().getName().endswith(".json"))

    def bytes(self, names: tuple[str, ...]) -> int:
        return sum(self.fs.getContentSummary(self._p(n)).getLength() for n in names)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._p(name))

    def delete(self) -> None:
        self.fs.delete(self._p(""), True)


@dataclass(frozen=True)
class ScratchInfo:
    """What the manifest says of a bank, and the bytes of its tables; no row is read."""

    format: int
    version: int
    dims: int
    padded_dims: int
    metric: str
    quantization: str
    capacity: int
    count: int
    generation: int
    retains_floats: bool
    channels: tuple[Channel, ...]
    row_bytes: int
    stored_bytes: int


@dataclass(frozen=True)
class RecallReport:
    recall: float
    k: int
    sample_count: int
    live_rows: int
    seed: int
    generation: int
    informative: bool


@dataclass
class ScratchBank:
    spark: SparkSession
    path: str
    manifest: Manifest
    _files: _Files = field(repr=False, default=None)

    # -- life ------------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, dims: int, metric: Metric, quantization: Quantization = Quantization.INT8, capacity: int = 1 << 28, channels: tuple[Channel, ...] = (), retain_floats: bool = False) -> ScratchBank:
        check_channels(channels, dims, quantization)
        if not 0 < capacity <= MAX_ROWS or not 0 < dims <= MAX_DIMS:
            raise InvalidArgument(f"{capacity} rows of {dims} lanes are out of bounds")
        files = _Files(spark, path)
        if files.versions():
            raise InvalidArgument(f"{path} holds a bank")
        first = Manifest(0, dims, metric.value, quantization.value, capacity, channels=tuple(tuple(asdict(c).values()) for c in channels), retains_floats=retain_floats)
        bank = cls(spark, path.rstrip("/"), first, files)
        files.write("manifest/0.json", json.dumps(asdict(first)))
        return bank

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None, verify: bool = True) -> ScratchBank:
        """The bank at ``path``. The manifest is always checked; ``verify`` reads the rows too: ids from 0 to count - 1, each
        once, sound lanes, removals within the count, and retained floats that bake to what is stored."""
        files = _Files(spark, path)
        bank = cls(spark, path.rstrip("/"), cls._header(files, path, version), files)
        if verify:
            bank.verify()
        return bank

    @classmethod
    def peek(cls, spark: SparkSession, path: str, version: int | None = None) -> ScratchInfo:
        """What is stored at ``path``, under the same checks of the manifest as ``load``."""
        files = _Files(spark, path)
        m = cls._header(files, path, version)
        bank = Bank(None, m.dims, Metric(m.metric), Quantization(m.quantization))
        return ScratchInfo(m.format, m.version, m.dims, bank.padded_dims, m.metric, m.quantization, m.capacity, m.count, m.generation, m.retains_floats, tuple(Channel(*c) for c in m.channels), bank.row_bytes + 4 * m.dims * m.retains_floats, files.bytes((*m.data, *m.removed)))

    @classmethod
    def _header(cls, files: _Files, path: str, version: int | None) -> Manifest:
        known = files.versions()
        if not known or version is not None and version not in known:
            raise BadFormat(f"no bank, or no version {version}, at {path}")
        m = cls._parsed(files.read(f"manifest/{known[-1] if version is None else version}.json"))
        for name in (*m.data, *m.removed):
            if not files.exists(name):
                raise BadFormat(f"{name} is missing")
        return m

    @staticmethod
    def _parsed(text: str) -> Manifest:
        try:
            raw = json.loads(text)
            if raw["format"] not in (1, 2, 3):
                raise BadFormat(f"format {raw['format']} is unknown")
            m = Manifest(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in raw.items()})
            Metric(m.metric)
            check_channels(tuple(Channel(*c) for c in m.channels), m.dims, Quantization(m.quantization))
        except BadFormat:
            raise
        except (KeyError, TypeError, ValueError) as e:
            raise BadFormat(str(e)) from e
        if m.channels and m.format < 3:
            raise BadFormat(f"format {m.format} has no channels")
        if not 0 < m.dims <= MAX_DIMS or not 0 < m.capacity <= MAX_ROWS:
            raise BadFormat(f"{m.capacity} rows of {m.dims} lanes are out of bounds")
        if not 0 <= m.count <= m.capacity or m.version < 0 or m.generation < 0:
            raise BadFormat("more rows than capacity, or a negative number")
        if bool(m.data) != (m.count > 0) or len({*m.data, *m.removed}) < len(m.data) + len(m.removed):
            raise BadFormat("the tables do not fit the count")
        return m

    def verify(self) -> None:
        """Checks all rows; raises BadFormat."""
        n = self.count
        rows = self._rows()
        each = rows.groupBy("row_id").agg(F.count("*").alias("n"))
        found = each.agg(F.sum("n").alias("n"), F.count("row_id").alias("ids"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).first()
        if (found["n"] or 0) != n or found["ids"] != n or n and (found["lo"], found["hi"]) != (0, n - 1):
            raise BadFormat(f"the rows are not 0 to {n - 1}, each once")
        gone = self.tombstones().agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.count(F.when(F.col("row_id").isNull(), 1)).alias("odd")).first()
        if gone["odd"] or gone["lo"] is not None and (gone["lo"] < 0 or gone["hi"] >= n):
            raise BadFormat("a removed row is not in the bank")
        if bad_bank_rows(Bank(rows, self.manifest.dims, self.metric, self.quantization)).first()["n_bad"]:
            raise BadFormat("a row is damaged")
        if self.manifest.retains_floats and not self.retained_mismatches().isEmpty():
            raise BadFormat("retained floats do not bake to their row")

    def destroy(self) -> None:
        self._files.delete()

    def _commit(self, **change) -> None:
        new = Manifest(**(asdict(self.manifest) | {"version": self.manifest.version + 1} | change))
        new = self._parsed(json.dumps(asdict(new)))
        self._files.write(f"manifest/{new.version}.json", json.dumps(asdict(new)))
        self.manifest = new

    # -- what it is -------------------------------------------------------------------------------------------

    @property
    def metric(self) -> Metric:
        return Metric(self.manifest.metric)

    @property
    def quantization(self) -> Quantization:
        return Quantization(self.manifest.quantization)

    @property
    def channels(self) -> tuple[Channel, ...]:
        return tuple(Channel(*c) for c in self.manifest.channels)

    @property
    def count(self) -> int:
        return self.manifest.count

    @property
    def generation(self) -> int:
        return self.manifest.generation

    def live_count(self) -> int:
        return self.count - self.tombstones().count()

    def tombstones(self) -> DataFrame:
        """Removed rows: row_id, each once."""
        if not self.manifest.removed:
            return self.spark.createDataFrame([], "row_id bigint")
        return self.spark.read.schema("row_id bigint").parquet(*[f"{self.path}/{d}" for d in self.manifest.removed]).distinct()

    def tombstone_words(self) -> DataFrame:
        """Removed rows as bits: word (row_id / 32), bits (bit row_id % 32)."""
        bit = F.expr("shiftleft(1L, cast(row_id % 32 AS int))")
        return self.tombstones().groupBy((F.col("row_id") / 32).cast("bigint").alias("word")).agg(F.bit_or(bit).alias("bits"))

    @property
    def row_bytes(self) -> int:
        return Bank(None, self.manifest.dims, self.metric, self.quantization).row_bytes

    def retained(self, ids: DataFrame | None = None) -> DataFrame:
        """The retained floats of all rows, or of ``ids`` (row_id), removed ones included: row_id, vec."""
        if not self.manifest.retains_floats:
            raise UnsupportedMode("the bank retains no floats")
        rows = self._rows().select("row_id", F.col("retained").alias("vec"))
        return rows if ids is None else rows.join(ids.select("row_id"), "row_id", "left_semi")

    def _rows(self) -> DataFrame:
        lanes = "q8 array<tinyint>, scale float" if self.quantization is Quantization.INT8 else "vec array<float>"
        schema = f"row_id bigint, {lanes}" + (", retained array<float>" if self.manifest.retains_floats else "")
        if not self.manifest.data:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{d}" for d in self.manifest.data])

    # -- changes ----------------------------------------------------------------------------------------------

    def append(self, rows: DataFrame, order: str = "ord", validate: bool = True, batch: int | None = None, _removed: tuple[str, ...] = ()) -> int:
        """Bake ``rows`` (``order``, vec) and give them the next ids in the order of ``order``; returns the first id."""
        first = self.count
        rows = rows.select(order, F.col("vec").cast("array<float>").alias("vec"))
        n = rows.count()
        if first + n > self.manifest.capacity:
            raise CapacityExceeded(f"{first} + {n} rows exceed {self.manifest.capacity}")
        if validate:
            validate_source_rows(rows.withColumnRenamed(order, "row_id"), self.manifest.dims, self.metric)
        with intermediates():
            self._append(rows, n, order, first, batch, _removed)
        return first

    def _append(self, rows: DataFrame, n: int, order: str, first: int, batch: int | None, _removed: tuple[str, ...]) -> None:
        numbered = dense_ids(rows, order, "row_id", first).select("row_id", "vec")
        unit = bake(numbered, self.manifest.dims, self.metric).df
        baked = quantized(unit.withColumn("retained", F.col("vec"))) if self.quantization is Quantization.INT8 else unit.withColumn("retained", F.col("vec"))
        baked = baked if self.manifest.retains_floats else baked.drop("retained")
        where = f"data/{uuid.uuid4().hex}"
        if n:
            baked.write.parquet(f"{self.path}/{where}")
        self._commit(count=first + n, data=(*self.manifest.data, *[where] * bool(n)), removed=(*self.manifest.removed, *_removed), generation=self.generation + bool(n or _removed), last_batch=self.manifest.last_batch if batch is None else batch)

    def remove(self, ids: DataFrame) -> None:
        """Remove rows (row_id); those already removed change nothing, unknown ones are an error."""
        found = ids.agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.count(F.when(F.col("row_id").isNull(), 1)).alias("odd")).first()
        if found["odd"] or found["lo"] is not None and (found["lo"] < 0 or found["hi"] >= self.count):
            raise InvalidArgument("a row to remove is not in the bank")
        fresh = ids.select("row_id").distinct().join(self.tombstones(), "row_id", "left_anti")
        where = f"removed/{uuid.uuid4().hex}"
        fresh.write.parquet(f"{self.path}/{where}")
        if not self.spark.read.schema("row_id bigint").parquet(f"{self.path}/{where}").isEmpty():
            self._commit(removed=(*self.manifest.removed, where), generation=self.generation + 1)

    def grow(self, capacity: int) -> None:
        if not max(1, self.count) <= capacity <= MAX_ROWS:
            raise InvalidArgument(f"a capacity of {capacity} is below the count or out of bounds")
        self._commit(capacity=capacity)

    def relabel(self, channels: tuple[Channel, ...]) -> None:
        """Another channel table; rows stay as they are stored."""
        check_channels(channels, self.manifest.dims, self.quantization)
        self._commit(channels=tuple(tuple(asdict(c).values()) for c in channels), generation=self.generation + 1)

    # -- reads ------------------------------------------------------------------------------------------------

    def snapshot(self) -> Bank:
        """The live rows of this version."""
        live = self._rows().join(self.tombstones(), "row_id", "left_anti")
        bank = Bank(live.drop("retained"), self.manifest.dims, self.metric, self.quantization)
        return with_channels(bank, self.channels) if self.channels else bank

    def freeze(self) -> tuple[Bank, DataFrame]:
        """(bank of the live rows numbered anew from 0, map old_id -> new_id with -1 for removed rows)."""
        live = dense_ids(self.snapshot().df.select("row_id"), "row_id", "new_id")
        ids = self._rows().select(F.col("row_id").alias("old_id")).join(live.withColumnRenamed("row_id", "old_id"), "old_id", "left")
        ids = ids.select("old_id", F.coalesce("new_id", F.lit(-1).cast("bigint")).alias("new_id"))
        bank = self.snapshot()
        rows = bank.df.join(live, "row_id").drop("row_id").withColumnRenamed("new_id", "row_id")
        return Bank(rows, bank.dims, bank.metric, bank.quantization, bank.channels), ids

    def freeze_with_recall(self, k: int = 10, sample: int = 1000, seed: int = RECALL_SEED) -> tuple[Bank, DataFrame, list[RecallReport]]:
        """``freeze``, and a recall report of each channel, measured on the rows that the frozen bank has."""
        if not self.channels or self.metric is not Metric.COSINE or not self.manifest.retains_floats:
            raise UnsupportedMode("recall of channels needs a cosine bank with channels that retains floats")
        reports = [self.recall(k, sample, seed, c) for c in range(len(self.channels))]
        return *self.freeze(), reports

    def retained_mismatches(self) -> DataFrame:
        """Rows whose retained floats do not bake to what is stored: row_id. Empty in a sound bank."""
        if not self.manifest.retains_floats:
            raise UnsupportedMode("the bank retains no floats")
        rows = self._rows()
        odd = F.col("retained").isNull() | (F.size("retained") != self.manifest.dims)
        if self.quantization is Quantization.FLOAT32:
            return rows.where(odd | (F.col("vec") != F.col("retained"))).select("row_id")
        again = quantized(rows.withColumnsRenamed({"q8": "_q8", "scale": "_scale"}).withColumn("vec", F.col("retained")))
        return again.where(odd | (F.col("q8") != F.col("_q8")) | (F.col("scale") != F.col("_scale"))).select("row_id")

    def recall(self, k: int = 10, sample: int = 1000, seed: int = RECALL_SEED, channel: int | None = None) -> RecallReport:
        """Recall@k of the bank's own scan (the integer mode in an int8 bank) against a double scan of the retained floats, for
        sampled live rows as queries, each without itself. k is at most the number of the other live rows; without any, the
        recall is 0.

        All rows are queries if there are ``sample`` or fewer; else those of the least seeded hashes. On a channel, rows
        without energy there are neither queries nor rows."""
        if not self.manifest.retains_floats:
            raise UnsupportedMode("recall needs retained floats")
        rows = self._rows().join(self.tombstones(), "row_id", "left_anti")
        o, n = (0, self.manifest.dims) if channel is None else (self.channels[channel].offset, self.channels[channel].length)
        floats = Bank(rows.select("row_id", F.slice("retained", o + 1, n).alias("vec")), n, self.metric)
        lanes = ["q8", "scale"] if self.quantization is Quantization.INT8 else ["vec"]
        own = Bank(rows.select("row_id", F.slice(lanes[0], o + 1, n).alias(lanes[0]), *lanes[1:]), n, self.metric, self.quantization)
        if channel is not None:
            with_energy = floats.df.where(dot(F.col("vec"), F.col("vec")) > 0)
            floats = replace(floats, df=with_energy)
            own = replace(own, df=own.df.join(with_energy.select("row_id"), "row_id", "left_semi"))
        live = floats.df.count()
        k, asked = max(0, min(k, live - 1)), min(live, sample)
        report = RecallReport(0.0, k, asked, live, seed, self.generation, live >= INFORMATIVE_ROWS)
        if not k or not asked:
            return report
        ids = floats.df.select(F.col("row_id").alias("query_id"))
        if live > sample:
            ids = ids.orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(sample)
        queries = rows_as_queries(floats).join(ids, "query_id", "left_semi")
        with intermediates():  # queries and rows are read several times by each search
            queries = materialize(queries, "queries")
            payloads = materialize(quantized_queries(queries), "payloads") if own.is_int8 else queries
            floats, own = (replace(b, df=materialize(b.df, "bank")) for b in (floats, own))
            exact = query_batch(floats, queries, QuerySpec(k=k, exclude_self=True), validate=False)
            fast = query_batch(own, payloads, QuerySpec(k=k, exclude_self=True, exact_int=own.is_int8), validate=False)
            hit = exact.join(fast.select("query_id", "row_id"), ["query_id", "row_id"], "left_semi").count()
        return replace(report, recall=hit / (asked * k))

    def stale(self, report: RecallReport) -> bool:
        return report.generation != self.generation

    # -- stream -----------------------------------------------------------------------------------------------

    def apply(self, batch: DataFrame, number: int | None = None) -> None:
        """Apply a batch of the log (seq, op 'append' or 'remove', row_id, vec): appends by seq, then removals. A batch
        number that was applied already is passed over."""
        if number is not None and number <= self.manifest.last_batch:
            return
        appends = batch.where("op = 'append'").select("seq", "vec")
        n = appends.count()
        gone = batch.where("op = 'remove'").select("row_id").distinct()
        where = f"removed/{uuid.uuid4().hex}"
        most = gone.agg(F.max("row_id")).first()[0]
        if most is not None and most >= self.count + n:
            raise InvalidArgument("a row to remove is not in the bank")
        if self.count + n > self.manifest.capacity:  # before anything is written
            raise CapacityExceeded(f"{self.count} + {n} rows exceed {self.manifest.capacity}")
        validate_source_rows(appends.withColumnRenamed("seq", "row_id"), self.manifest.dims, self.metric)
        if most is not None:
            gone.join(self.tombstones(), "row_id", "left_anti").write.parquet(f"{self.path}/{where}")
        self.append(appends, "seq", validate=False, batch=number, _removed=(where,) if most is not None else ())

    def follow(self, log: DataFrame, checkpoint: str):
        """Keep applying a streaming log; returns the started query."""
        return log.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


