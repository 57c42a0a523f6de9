"""Writing catalogs: CSV in schema order, the query table with its rejects, and checks of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marque.functions.columns import name
from marque.operators.store import DERIVED, write_catalog
from marque.operators.validate import issues_of, numbered, range_issues, split_valid
from marque.schema import BY_NAME, COLUMNS
from marque.sources.readers import CSV_OPTIONS


def csv_text(c: Column, kind: str) -> Column:
    """A cell of a catalog CSV: whole numbers without decimals, others with two at most; null is blank."""
    if kind == "string":
        return F.coalesce(c, F.lit(""))
    r = F.round(c.cast("double"), 2)
    return F.coalesce(F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(r.cast("string")), F.lit(""))


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS, single: bool = False, mode: str = "overwrite") -> None:
    """The columns in order, missing ones blank, others left out. single: one file, for small catalogs."""
    has = set(df.columns)
    out = df.select(*[(csv_text(name(c), BY_NAME[c].kind if c in BY_NAME else "string") if c in has else F.lit("")).alias(c) for c in columns])
    (out.coalesce(1) if single else out).write.mode(mode).options(header="true", escape='"', emptyValue="").csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """More rows in the columns, and their order, of what is there."""
    write_csv(df, path, tuple(df.sparkSession.read.options(**CSV_OPTIONS).csv(path).columns), mode="append")


def write_tables(df: DataFrame, path: str, seq: str | None = "seq") -> tuple[str, str]:
    """The query table of the rows that meet the constraints, and a table of the others with reasons; their paths."""
    good, bad = split_valid(df, seq if seq in df.columns else None)
    write_catalog(good.select(*[name(c) for c in COLUMNS]), f"{path}/cars")
    bad.write.mode("overwrite").parquet(f"{path}/rejected")
    return f"{path}/cars", f"{path}/rejected"


def open_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def record_count(spark: SparkSession, path: str) -> int:
    """Rows of a table, 0 where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).count()
    except AnalysisException:
        return 0


def check_table(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with a written query table; empty if nothing is."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return [f"no table at {path}"]
    want, have = {*COLUMNS, *DERIVED}, set(df.columns)
    out = [f"missing column {c}" for c in sorted(want - have)] + [f"extra column {c}" for c in sorted(have - want)]
    return out + (["no rows"] if df.isEmpty() else [])


def check_csv(spark: SparkSession, path: str, limit: int = 100) -> list[str]:
    """What is wrong with a written CSV: its columns, then its first value errors."""
    df = spark.read.options(**CSV_OPTIONS).csv(path)
    out = [f"missing column {c}" for c in COLUMNS if c not in df.columns] + [f"extra column {c}" for c in df.columns if c not in COLUMNS]
    if out:
        return out
    rows = issues_of(numbered(df), range_issues(set(df.columns))).where("severity = 'ERROR'").orderBy("row_index", "field").limit(limit + 1).collect()
    return [f"row {r.row_index}: {r.field}: {r.message}" for r in rows[:limit]] + (["more errors"] if len(rows) > limit else [])
