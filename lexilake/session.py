"""Session and table helpers shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lexilake") -> SparkSession:
    """A local session with the settings that the tests and the bench use (UTC, AQE on, no UI)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEXILAKE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a scale-factor folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: the folder of each application that names none
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one for a local master without it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(context.applicationId)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lexilake-")
    return found.rstrip("/")


def bounded_batches(spark: SparkSession, records: int = 1024) -> None:
    """Arrow batches of at most so many rows and 8 MB, for a Python worker's memory; the session keeps the setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, computed once; it goes when the application ends."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lexilake-table-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())
