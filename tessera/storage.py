"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: ``made``: for each ``intermediates`` that this thread is in, the tables written since it began.
_scopes = threading.local()


def _open() -> list[list[DataFrame]]:
    if not hasattr(_scopes, "made"):
        _scopes.made = []
    return _scopes.made


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _folder(df: DataFrame):
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tessera_path).getParent()
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), path


#: Hadoop's local file system starts a ``chmod`` for every file and folder it makes; until that runs, the child shares all pages of
#: the JVM, and what adds up processes counts them twice. The plain one writes no checksum files, so starts a third fewer.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Parquet's own checksums, which it always writes, in the place of those files.
_CHECKED = {"parquet.page.verify-checksum.enabled": "true"}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``release`` deletes the table; what is left goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}/{name}"
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    local = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.LocalFileSystem").isInstance(files)
    df.write.options(**(_PLAIN if local else {})).parquet(path)
    out = spark.read.options(**_CHECKED).schema(df.schema).parquet(path)
    out._tessera_path = path
    files, folder = _folder(out)
    files.deleteOnExit(folder)
    if _open():
        _open()[-1].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more; a table is released once."""
    for df in tables:
        if getattr(df, "_tessera_path", None):
            files, folder = _folder(df)
            files.delete(folder, True)
            files.cancelDeleteOnExit(folder)
            df._tessera_path = None


@contextmanager
def intermediates() -> Iterator[None]:
    """Releases, at its end, what ``materialize`` wrote inside, but for tables that were ``kept``."""
    made: list[DataFrame] = []
    _open().append(made)
    try:
        yield
    finally:
        _open().pop()
        release(*made)


def kept(df: DataFrame) -> DataFrame:
    """A table that outlives the innermost ``intermediates``; the next one around it may release it."""
    scopes = _open()
    if scopes:
        scopes[-1][:] = [t for t in scopes[-1] if t is not df]
        if len(scopes) > 1:
            scopes[-2].append(df)
    return df
