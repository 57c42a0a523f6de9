"""Session helper: one place for the settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "marque", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; local unless a master is set elsewhere.

    On a cluster the master, memory and ``spark.sql.shuffle.partitions`` come from
    spark-submit; this only fills what is unset.
    """
    n = cpus or os.cpu_count() or 4
    b = SparkSession.builder.appName(app)
    if not os.environ.get("MASTER") and "spark.master" not in conf:
        b = b.master(f"local[{n}]")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(n),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    spark = b.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a folder of our own only where none is set and the master is local."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/marque-tables"


#: Shuffle files go when a query ends, instead of when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """For the writes and actions of the block: none leaves its shuffle files behind for the next. Their frames aren't run again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df written to a table in the folder that all executors share (spark.checkpoint.dir) and read again.

    Ends the lineage and the plan there: later stages are planned and recovered by themselves.
    """
    spark = df.sparkSession
    path = f"{table_root(spark)}/stage-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it's there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared store for as long as the block lasts."""
    path = f"{table_root(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete(spark, path)
