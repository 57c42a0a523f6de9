"""Facets and threshold counts, each family in one pass over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marque.functions.columns import name
from marque.operators.catalog_query import EQUAL, prepared, valid

FACETS = tuple(EQUAL.values())

# Metric, column, comparison and thresholds. Counts compare strictly but for torque and weight per power.
THRESHOLDS: tuple[tuple[str, str, str, str, tuple[float, ...]], ...] = (
    ("displacement", "engine_displacement", ">", "> {} L", (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)),
    ("power", "power_hp", ">", "> {} hp", (100, 200, 300, 400, 500, 600, 700, 1000)),
    ("torque", "torque_prefix", ">=", "> {} lb-ft", (100, 200, 300, 400, 500, 600)),
    ("weight", "curb_weight_lb", "<", "< {} lbs", (5000, 4000, 3500, 3000, 2500, 2000)),
    ("power_to_weight", "power_to_weight", "<=", "< {} lb/hp", (15, 10, 8, 6, 5, 4, 3)),
    ("accel_0_60", "0_60_mph_sec", "<", "< {} sec", (10, 8, 6, 5, 4, 3, 2.5)),
    ("quarter_mile", "quarter_mile_sec", "<", "< {} sec", (16, 14, 13, 12, 11, 10)),
    ("top_speed", "top_speed_mph", ">", "> {} mph", (100, 150, 175, 200, 250)),
)


def facet_counts(catalog: DataFrame, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value, count) of the non-blank values of all facets, by one unpivot and one aggregate."""
    rows = catalog.where(valid())
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), name(c).cast("string").alias("value")) for c in facets])
    return rows.select(F.explode(pairs).alias("p")).select("p.*").where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("count"))


def source_counts(catalog: DataFrame) -> DataFrame:
    """(value, count) of the sources, of which a row may have several."""
    return prepared(catalog).where(valid()).select(F.explode("sources_arr").alias("value")).groupBy("value").agg(F.count("*").alias("count"))


def _holds(column: str, op: str, bound: float):
    c, v = name(column), F.lit(float(bound))
    return {">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op]


def threshold_counts(catalog: DataFrame, metrics: tuple[str, ...] | None = None) -> DataFrame:
    """(metric, label, value, count) of all thresholds, by one conditional aggregate."""
    rows = prepared(catalog).where(valid())
    cells = [(m, label.format(f"{v:g}" if m != "displacement" else f"{v:.1f}"), float(v), _holds(c, op, v)) for m, c, op, label, vs in THRESHOLDS if metrics is None or m in metrics for v in vs]
    one = rows.agg(*[F.count_if(p).alias(f"c{i}") for i, (*_, p) in enumerate(cells)])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(label).alias("label"), F.lit(v).alias("value"), F.col(f"c{i}").alias("count")) for i, (m, label, v, _) in enumerate(cells)])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def year_range(catalog: DataFrame, fallback: tuple[int, int] | None = None) -> DataFrame:
    """(total, year_min, year_max); without rows 1900 and the current year, or the fallback."""
    low, high = (F.lit(1900), F.year(F.current_date())) if fallback is None else map(F.lit, fallback)
    return prepared(catalog).where(valid()).agg(F.count("*").alias("total"), F.coalesce(F.min("year_int"), low).alias("year_min"), F.coalesce(F.max("year_int"), high).alias("year_max"))


def meta(catalog: DataFrame) -> dict[str, DataFrame]:
    """What the filter panel asks for, in four passes at most."""
    return {"facets": facet_counts(catalog), "sources": source_counts(catalog), "thresholds": threshold_counts(catalog), "summary": year_range(catalog)}


def counted(catalog: DataFrame) -> DataFrame:
    """(kind, name, value, count): the facets, sources, years, thresholds and total of a catalog in one table, to be kept and moved on.

    Facets and thresholds of columns that the catalog lacks are left out.
    """
    rows = prepared(catalog).where(valid())
    has = set(rows.columns)
    metrics = tuple(m for m, c, *_ in THRESHOLDS if c in has)
    kind = lambda k, n, v, c="count": [F.lit(k).alias("kind"), n.alias("name"), v.alias("value"), F.col(c).cast("long").alias("count")]
    out = rows.agg(F.count("*").alias("count")).select(*kind("total", F.lit("rows"), F.lit("")))
    own = tuple(c for c in FACETS if c in has)
    if own:
        out = out.unionByName(facet_counts(rows, own).select(*kind("facet", F.col("facet"), F.col("value"))))
    if metrics:
        out = out.unionByName(threshold_counts(rows, metrics).select(*kind("threshold", F.col("metric"), F.col("label"))))
    out = out.unionByName(rows.where("year_int is not null").groupBy("year_int").count().select(*kind("year", F.lit("year"), F.col("year_int").cast("string"))))
    return out.unionByName(source_counts(rows).select(*kind("source", F.lit("source"), F.col("value"))))


def moved(state: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The counts after rows were removed and added, from those before and these rows alone: what an upsert reports.

    A value of which no row is left goes; thresholds and the total stay at 0. Equals counted() of the catalog then.
    """
    signed = counted(removed).withColumn("count", -F.col("count")).unionByName(counted(added))
    out = state.unionByName(signed).groupBy("kind", "name", "value").agg(F.sum("count").alias("count"))
    return out.where("count <> 0 or kind in ('threshold', 'total')")


def year_span(state: DataFrame) -> DataFrame:
    """(year_min, year_max) of kept counts; null without years."""
    y = F.col("value").cast("int")
    return state.where("kind = 'year'").agg(F.min(y).alias("year_min"), F.max(y).alias("year_max"))
