"""Intermediate tables in the folder that all executors share, and the packed shuffle's keys."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marque.session import table_root


def cut(df: DataFrame) -> DataFrame:
    """df written to a table in the shared folder and read again: the lineage ends there, whatever executor is lost."""
    spark = df.sparkSession
    path = f"{table_root(spark)}/marque-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/marque-" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key(docs: DataFrame, text_col: str) -> Column:
    """A 64-bit key of a text that no other text of docs has.

    Texts whose hashes meet, which a second hash tells, are keyed anew; in 10^10 texts a few do. The
    list of those is what comes to the driver.
    """
    text = F.col(text_col)
    pair = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("other"), text).alias("b"))
    met = pair.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo <> hi")
    again = [r.a for r in met.collect()]
    return F.when(F.xxhash64(text).isin(again), F.xxhash64(F.lit("again"), text)).otherwise(F.xxhash64(text)) if again else F.xxhash64(text)


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """About how many bytes of text docs has, to choose the number of blocks by (results don't depend on it).

    Of plain files twice their size, without reading them; of anything else the sum.
    """
    node = docs._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1:
        node = node.children().apply(0)
    if node.getClass().getSimpleName() == "LogicalRelation":
        return 2 * int(str(node.stats().sizeInBytes()))
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n hash partitions an int that Spark deals to it, so that packed buckets spread evenly."""
    found = spark.range(n * 16).selectExpr("cast(id as int) as k", f"pmod(hash(cast(id as int)), {n}) as p").groupBy("p").min("k").collect()
    keys = {r[0]: r[1] for r in found}
    spare = iter(range(n * 16, n * 17))
    return [keys.get(p, next(spare)) for p in range(n)]


#: Rows of an Arrow batch where the session leaves Spark's default: documents can be long.
BATCH_ROWS = 1000
#: Bytes of one, likewise: packed rows are some 100 kB each, and a batch lies in the JVM and in the worker at once.
BATCH_BYTES = 4_000_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless PYTHONPATH (which they inherit) already leads to it; smaller Arrow batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = Path(__file__).resolve().parents[2]
    name = __name__.partition(".")[0]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or any(f.endswith(f"{name}-package.zip") for f in context._python_includes):
        return
    path = Path(tempfile.mkdtemp()) / f"{name}-package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / name).rglob("*.py")):
            z.write(f, f.relative_to(root))
    before = list(sys.path)
    context.addPyFile(str(path))
    sys.path[:] = before  # the driver goes on importing from its own place
