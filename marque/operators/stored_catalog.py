"""A catalog kept as a table and refreshed in place: upserts and deduplication that rewrite only what they touch.

Rows are stored in partitions by a hash of what merging compares, manufacturer and model, so
rows that merge lie together. An upsert reads the partitions of its new rows' keys, merges there, and
overwrites those partitions and no others: the files of the rest keep their names. Merged rows may equal
rows of other partitions by car_id, which has no part in the hash: those are found by a scan of
the three columns that make a car_id, and their partitions are rewritten too.

The staged result is written before anything is replaced. A job that fails midway can be run
again: values that are filled stay, and rows that are there twice become one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marque.functions.columns import name
from marque.operators.makers import Makers
from marque.operators.survivorship import FILLED, deduplicate, keyed, merge, merge_filling_year, merge_first, with_car_id
from marque.session import cut, delete

BUCKETS = 256
#: The jobs: review CSVs merge by key, encyclopedia CSVs also fill years; scraped pages merge by equal names and aren't deduplicated.
VARIANTS = {"key": merge, "fill_year": merge_filling_year, "first": merge_first}
_KEPT = ("car_id", "country", "year", "manufacturer", "model", "propulsion", "sources", *FILLED)


@dataclass(frozen=True)
class Refresh:
    """What a job did: rows before and after, and the partitions it rewrote, with their rows before and after."""

    before: int
    after: int
    buckets: tuple[int, ...]
    removed: DataFrame
    added: DataFrame


class StoredCatalog:
    """A stored catalog; ``create`` makes one, the constructor opens one. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, makers: Makers):
        self.spark, self.path, self.makers = spark, path, makers
        self._known: dict | None = None

    @classmethod
    def create(cls, df: DataFrame, path: str, makers: Makers, buckets: int = BUCKETS, dedupe: bool = True) -> StoredCatalog:
        """Stores a catalog's columns and seq, the order of rows; deduplicated unless told otherwise.

        buckets: partitions; rows over buckets should be what a task rewrites at ease.
        """
        rows = df.select(*[name(c) for c in _KEPT if c in df.columns], "seq")
        if "car_id" not in rows.columns:
            rows = with_car_id(rows, makers)
        rows = cut(deduplicate(rows, makers) if dedupe else rows)
        out = cls(df.sparkSession, path, makers)
        last = rows.agg(F.max("seq")).first()[0]
        out._set_layout({"buckets": buckets, "next": 0 if last is None else last + 1, "schema": rows.schema.json()})
        out._write(out._placed(rows), "static")
        return out

    def _layout(self) -> dict:
        if self._known is None:
            self._known = json.loads(self.spark.read.text(f"{self.path}/layout").first()[0])
        return self._known

    def _set_layout(self, layout: dict) -> None:
        self._known = layout
        self.spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/layout")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows in the stored columns, with the partition of each."""
        layout = self._layout()
        fields = T.StructType.fromJson(json.loads(layout["schema"])).fields
        own = keyed(rows, self.makers).withColumn("bucket", F.pmod(F.xxhash64("_mk", "_md"), F.lit(layout["buckets"])).cast("int"))
        return own.select(*[(name(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], "bucket")

    def _write(self, placed: DataFrame, mode: str) -> None:
        """Overwrites the table, or (dynamic) the partitions that placed has rows of. Large partitions are split over tasks."""
        order = [c for c in ("manufacturer", "model", "year", "car_id") if c in placed.columns]
        dealt = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", mode).option("parquet.bloom.filter.enabled#car_id", "true").partitionBy("bucket").parquet(f"{self.path}/rows")

    def _rows(self) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self._layout()["schema"])).add("bucket", T.IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some partitions, without reading the files of others."""
        rows = self._rows()
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def files(self) -> dict[str, int]:
        """The table's files, by the last parts of their paths, with their partition."""
        found = self._rows().select(F.col("_metadata.file_path").alias("p"), "bucket").distinct().collect()  # partitions times the files of each
        return {r["p"].partition("/rows/")[2]: r["bucket"] for r in found}

    def _replace(self, touched: list[int], rows: DataFrame, before: int, advance: int = 0) -> Refresh:
        """Puts rows in place of all rows of the touched partitions."""
        removed = cut(self.read(touched))
        staged = cut(self._placed(rows))
        held = {r["bucket"]: r["count"] for r in staged.groupBy("bucket").count().collect()}  # partitions at most
        if set(held) - set(touched):
            raise ValueError(f"rows would leave their partitions for {sorted(set(held) - set(touched))}")
        self._write(staged, "dynamic")
        for b in set(touched) - set(held):  # a partition without rows isn't overwritten
            delete(self.spark, f"{self.path}/rows/bucket={b}")
        if advance:
            layout = self._layout()
            self._set_layout(layout | {"next": layout["next"] + advance})
        return Refresh(before, before - removed.count() + sum(held.values()), tuple(sorted(touched)), removed, staged.drop("bucket"))

    def upsert(self, new: DataFrame, variant: str = "key") -> Refresh:
        """Merges new rows (catalog columns and seq) into the table, in order of seq after all that is there.

        variant: "key" and "fill_year" merge by key and deduplicate, and equal deduplicate(merge(table, new)) on a table
        without duplicates; "first" merges by equal names (see merge_first). Without new rows nothing is rewritten.
        """
        layout = self._layout()
        before = self._rows().count()
        fresh = cut(self._placed(new.withColumn("seq", name("seq") + F.lit(layout["next"]))))
        ends = {r["bucket"]: r["last"] for r in fresh.groupBy("bucket").agg(F.max("seq").alias("last")).collect()}  # partitions at most
        if not ends:
            return Refresh(before, before, (), self.read([]), self.read([]))
        touched = list(ends)
        merged = cut(VARIANTS[variant](self.read(touched), fresh.drop("bucket"), self.makers))
        if variant != "first":
            ids = with_car_id(merged, self.makers).select("car_id").distinct()
            rest = self._rows().where(~F.col("bucket").isin(touched)).select("year", "manufacturer", "model", "bucket")
            more = [r[0] for r in with_car_id(rest, self.makers).join(ids, "car_id", "left_semi").select("bucket").distinct().collect()]
            if more:
                touched += more
                merged = merged.unionByName(self.read(more), allowMissingColumns=True)
            merged = deduplicate(merged, self.makers)
        return self._replace(touched, merged, before, max(ends.values()) + 1 - layout["next"])

    def dedupe(self, dry_run: bool = False) -> Refresh:
        """One row for each car_id, over the whole table; only partitions with a repeated one are rewritten (none in a dry run)."""
        before = self._rows().count()
        narrow = with_car_id(self._rows().select("year", "manufacturer", "model", "bucket"), self.makers)
        repeated = cut(narrow.groupBy("car_id").agg(F.count("*").alias("n"), F.collect_set("bucket").alias("buckets")).where("n > 1"))
        touched = [r[0] for r in repeated.select(F.explode("buckets")).distinct().collect()]  # partitions at most
        if dry_run or not touched:
            extra = repeated.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
            return Refresh(before, before - extra, tuple(sorted(touched)), self.read([]), self.read([]))
        return self._replace(touched, deduplicate(self.read(touched), self.makers), before)
