"""Shared folder, written intermediate tables and small column helpers of the llm operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LEFT: list[tuple[object, object]] = []
#: the folder of each application that has no setting
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is missing a local folder is made, one for each application, if driver and executors are one
    machine (tests, a laptop); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lexilake-")
        found = _OWN[context.applicationId]
    return found.rstrip("/")


class Workspace:
    """Tables written under the shared folder. They cut lineage: a lost executor costs a reread, not a rerun."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lexilake-{name}-{uuid.uuid4().hex}"
        self.n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.deleteOnExit(path)
        self._fs = fs
        if not _LEFT:
            atexit.register(_clean)
        _LEFT.append((fs, path))

    def save(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet, read it back."""
        self.n += 1
        to = f"{self.root}/{self.n}"
        with setting(self.spark, CLEANUP, "true"):  # once written, what was shuffled for it is of no use
            df.write.parquet(to)
        back = self.spark.read.schema(df.schema).parquet(to)
        back._lexilake_path = to
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a table that save() returned and that no later result reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._lexilake_path)
        self._fs.delete(path, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the length of a block; then it is as it was."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _clean() -> None:
    for fs, path in _LEFT:
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001  the JVM has ended already; deleteOnExit has done it
            return


def bounded_batches(spark: SparkSession, records: int = 1024) -> None:
    """Arrow batches of whole texts: few enough rows for a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def released(f: Callable) -> Callable:
    """The function over batches f, which at a task's end gives memory that is no longer used back to the system:
    Spark keeps its Python workers for later tasks and stages."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_mod(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % n


def tokenizer_file(name: str) -> str:
    """Default place of a public tokenizer's vocabulary file; every operator takes the path as a parameter."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
