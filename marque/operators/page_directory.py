"""Deep pages: a listing kept in ranges of its order, with a directory of their counts.

A listing (a query's rows in its order) is dealt by ranges of the order and written, a
folder a range; the directory has the rows before each range and in it. A row has its place in
its range, so a page is a slice of the one or two ranges that hold it, however far it is from the first; a cursor (the order's values of a
row) finds the page after that row by the directory's last keys.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marque.functions.columns import name
from marque.operators.catalog_query import SORTABLE, CatalogQuery, filtered
from marque.session import delete, tidy

#: Rows of a range, about.
RANGE_ROWS = 200_000

_PLACE = (T.StructField("_place", T.LongType()),)
#: What a row's number within its partition takes of monotonically_increasing_id.
_IN_PARTITION = 2**33 - 1

Order = tuple[tuple[str, bool], ...]  # column, descending


def order_of(q: CatalogQuery, tie: tuple[str, ...] = ("car_id",)) -> Order:
    """The columns that a query sorts by and whether they descend; nulls are last either way."""
    column = SORTABLE.get(q.sortBy or "")
    first = (("manufacturer", False), ("model", False)) if column is None else ((column, q.sortOrder == "desc"),)
    return (*first, *((c, False) for c in tie))


def _sorts(order: Order) -> list[Column]:
    return [name(c).desc_nulls_last() if down else name(c).asc_nulls_last() for c, down in order]


def _beyond(order: Order, columns: list[Column], than: list[Column]) -> Column:
    """Whether a row with these values comes after one with those; equal ones don't. Nulls are last."""
    out = F.lit(False)
    for (_, down), a, b in reversed(list(zip(order, columns, than, strict=True))):
        after = b.isNotNull() & (a.isNull() | ((a < b) if down else (a > b)))
        out = F.coalesce(after, F.lit(False)) | (a.eqNullSafe(b) & out)
    return out


@dataclass(frozen=True)
class PageDirectory:
    """A listing in a folder; ``build`` makes one, the constructor opens one."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, catalog: DataFrame, q: CatalogQuery, path: str, tie: tuple[str, ...] = ("car_id",), ranges: int | None = None, columns: tuple[str, ...] | None = None) -> PageDirectory:
        """Writes the rows that q's filters keep, in its order. tie: columns that no two rows share, which end the order.

        ranges: so many at least, more where they would have more than RANGE_ROWS rows. columns: what pages show besides
        the order's columns (all, if not given); the filters may use others. The rows are written as they come first, so that
        the shuffles of what makes the catalog are gone when they are dealt.
        """
        rows = filtered(catalog, q)
        order = order_of(q, tie)
        if columns is not None:
            rows = rows.select(*[name(c) for c in dict.fromkeys([*columns, *(c for c, _ in order)])])
        spark = catalog.sparkSession
        with tidy(spark):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/unsorted")
            rows = spark.read.schema(rows.schema).parquet(f"{path}/unsorted")
            n = max(ranges or 1, math.ceil(rows.count() / RANGE_ROWS))
            cls._deal(rows, order, n, path)
        delete(spark, f"{path}/unsorted")
        spark.createDataFrame([(json.dumps({"order": order, "schema": rows.schema.json()}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/layout")
        out = cls(spark, path)
        written = spark.read.schema(T.StructType([*rows.schema.fields, *_PLACE, T.StructField("_range", T.IntegerType())])).parquet(f"{path}/rows")
        last = F.max_by(F.struct(*[name(c) for c, _ in order]), "_place").alias("last")
        before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
        counts = written.groupBy("_range").agg(F.count("*").alias("n"), last)
        counts.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
        return out

    @staticmethod
    def _deal(rows: DataFrame, order: Order, n: int, path: str) -> None:
        dealt = rows.repartitionByRange(n, *_sorts(order)).withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", *_sorts(order))
        dealt = dealt.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)))  # from 0 in each range
        dealt.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")

    def _layout(self) -> tuple[Order, T.StructType]:
        got = json.loads(self.spark.read.text(f"{self.path}/layout").first()[0])
        return tuple((c, down) for c, down in got["order"]), T.StructType.fromJson(json.loads(got["schema"]))

    def ranges(self) -> DataFrame:
        """(_range, n, last, before): the directory."""
        return self.spark.read.parquet(f"{self.path}/ranges")

    def total(self) -> int:
        return self.ranges().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def pagination(self, page: int, size: int) -> dict[str, int]:
        """What the count of a query says, from the directory alone."""
        n = self.total()
        return {"page": page, "pageSize": size, "total": n, "totalPages": math.ceil(n / size)}

    def _of(self, ranges: list[int]) -> DataFrame:
        schema = T.StructType([*self._layout()[1].fields, *_PLACE])
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/rows/_range={r}" for r in ranges]) if ranges else self.spark.createDataFrame([], schema)

    def page(self, page: int, size: int) -> DataFrame:
        """The rows of a page, in order: a slice by place of the ranges that hold it."""
        offset = (page - 1) * size
        held = self.ranges().where((F.col("before") < offset + size) & (F.col("before") + F.col("n") > offset)).orderBy("_range").collect()  # of a page
        out = self._of([])
        for r in held:
            low = offset - r["before"]
            out = out.unionByName(self._of([r["_range"]]).where((F.col("_place") >= low) & (F.col("_place") < low + size)))
        return out.orderBy(*_sorts(self._layout()[0])).drop("_place")

    def after(self, cursor: Mapping[str, object], size: int) -> DataFrame:
        """The next rows after that of the cursor, which has the order's values of a row (be it gone since); {} begins.

        Reads ranges from the first whose last key isn't before the cursor, as many as hold ``size`` rows after it.
        """
        order, schema = self._layout()
        if not cursor:
            return self.page(1, size)
        than = [F.lit(cursor[c]).cast(schema[c].dataType) for c, _ in order]
        left = self.ranges().where(_beyond(order, [F.col("last")[c] for c, _ in order], than)).orderBy("_range")
        first = left.select("_range", "before", "n").first()
        if first is None:
            return self._of([]).drop("_place")
        # The first range may hold few rows after the cursor: those of the ranges behind it make up the size.
        held = left.where(F.col("before") < first["before"] + first["n"] + size).select("_range").collect()
        rows = self._of([r["_range"] for r in held])
        return rows.where(_beyond(order, [name(c) for c, _ in order], than)).orderBy(*_sorts(order)).limit(size).drop("_place")

    @staticmethod
    def cursor(row: Mapping[str, object], order: Order) -> dict[str, object]:
        """The cursor of a row."""
        return {c: row[c] for c, _ in order}
