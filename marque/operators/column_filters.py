"""Filters on any column, what a filter panel shows, and the numbers of a pager."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marque.functions.columns import all_of, name
from marque.functions.units import leading_number
from marque.schema import BY_NAME, NUMERIC

# The quick filters (column, substring or (least, most)) and columns without a list of values.
QUICK: dict[str, tuple[str, str | tuple[float | None, float | None]]] = {
    "Electric Cars": ("propulsion", "electric"),
    "0-60 under 3s": ("0_60_mph_sec", (None, 3.0)),
    "200+ mph": ("top_speed_mph", (200.0, None)),
    "1000+ HP": ("power_hp", (1000.0, None)),
    "Nurburgring under 7 min": ("nurburgring_lap_sec", (None, 420.0)),
}
UNLISTED = ("model", "engine", "torque")
NEAR = 5  # a pager of up to two pages more shows all


def _number(column: str) -> Column:
    c = name(column)
    return c if column in NUMERIC else leading_number(c.cast("string"))


def column_filter(column: str, value: str | tuple[float | None, float | None]) -> Column:
    """A substring whatever its case, or bounds (either may be None) of a number; null passes neither."""
    if isinstance(value, str):
        return F.coalesce(F.contains(F.lower(name(column).cast("string")), F.lit(value.lower())), F.lit(False))
    low, high = value
    x = _number(column)
    bounds = ([x >= low] if low is not None else []) + ([x <= high] if high is not None else [])
    return F.coalesce(all_of(bounds), F.lit(False))


def column_values(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column, value): the different non-blank values of text columns."""
    use = [c for c in columns if c not in NUMERIC and c not in UNLISTED]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), name(c).cast("string").alias("value")) for c in use])
    return df.select(F.inline(pairs)).where(F.trim("value") != "").distinct()


def column_ranges(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column, min, max) of numeric columns that have a number."""
    use = [c for c in columns if c in NUMERIC]
    one = df.agg(*[f(name(c)).alias(f"{k}_{i}") for i, c in enumerate(use) for k, f in (("lo", F.min), ("hi", F.max))])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"lo_{i}").alias("min"), F.col(f"hi_{i}").alias("max")) for i, c in enumerate(use)]
    return one.select(F.inline(F.array(*cells))).where("min is not null")


def page_numbers(page: Column, pages: Column) -> Column:
    """The numbers of a pager: all of a few; else the first, those around the page and the last, with dots in gaps."""
    text = lambda a, b: F.transform(F.sequence(a, b), lambda x: x.cast("string"))
    none, dots = F.array().cast("array<string>"), F.array(F.lit("..."))
    start, end = F.greatest(F.lit(2), page - 1), F.least(pages - 1, page + 1)
    near = F.when(start <= end, text(start, F.greatest(start, end))).otherwise(none)
    some = F.concat(F.array(F.lit("1")), F.when(start > 2, dots).otherwise(none), near, F.when(end < pages - 1, dots).otherwise(none), F.array(pages.cast("string")))
    few = F.when(pages > 0, text(F.lit(1), F.greatest(pages, F.lit(1)))).otherwise(none)
    return F.when(pages <= NEAR + 2, few).otherwise(some)


def record_range(page: Column, size: Column, total: Column) -> Column:
    """Struct (first, last): the places of a page's records."""
    return F.struct(((page - 1) * size + 1).alias("first"), F.least(page * size, total).alias("last"))


def filtered_by(df: DataFrame, filters: dict[str, str | tuple[float | None, float | None]]) -> DataFrame:
    """Rows that pass all filters, by column."""
    unknown = [c for c in filters if c not in BY_NAME]
    if unknown:
        raise ValueError(f"no column {', '.join(unknown)}")
    return df.where(all_of(column_filter(c, v) for c, v in filters.items()))
