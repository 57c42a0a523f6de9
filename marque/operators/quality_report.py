"""Completeness, distributions and statistics of a catalog, and their report."""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marque.functions.columns import name
from marque.operators.makers import Makers, country_name
from marque.operators.store import with_derived
from marque.schema import BY_NAME, COLUMNS, NUMERIC


def completeness(df: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """(field, total, filled, empty, distinct, fill_rate), by one aggregate over an unpivoted table."""
    cols = columns or tuple(c for c in COLUMNS if c in df.columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.nullif(name(c).cast("string"), F.lit("")).alias("v")) for c in cols])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*")
    values = rows.groupBy("field", "v").agg(F.count("*").alias("n"))  # one row a value: the count of distinct ones needs no second shuffle of rows
    out = values.groupBy("field").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"), F.count("v").alias("distinct"))
    return out.select("field", "total", "filled", (F.col("total") - F.col("filled")).alias("empty"), "distinct", F.try_divide(F.col("filled") * 100.0, F.col("total")).alias("fill_rate"))


def distribution(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, count), most frequent first; ties by value."""
    out = df.groupBy(name(column).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")
    return out.limit(top) if top else out


def source_distribution(df: DataFrame) -> DataFrame:
    return distribution(with_derived(df).select(F.explode("sources_arr").alias("value")), "value")


def year_span(df: DataFrame) -> DataFrame:
    """(year_min, year_max) over years that are all digits."""
    y = F.when(F.col("year").rlike(r"^\d+$"), F.col("year").try_cast("int"))
    return df.agg(F.min(y).alias("year_min"), F.max(y).alias("year_max"))


def numeric_stats(df: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """(field, count, min, max, mean) and the schema's bounds."""
    cols = columns or tuple(c for c in NUMERIC if c in df.columns)
    one = df.agg(*[e.alias(f"{k}_{i}") for i, c in enumerate(cols) for k, e in (("n", F.count(name(c))), ("lo", F.min(name(c))), ("hi", F.max(name(c))), ("avg", F.avg(name(c))))])
    bound = lambda c, k: F.lit(float(getattr(BY_NAME[c], k)) if c in BY_NAME and getattr(BY_NAME[c], k) is not None else None).cast("double")
    cells = [F.struct(F.lit(c).alias("field"), F.col(f"n_{i}").alias("count"), F.col(f"lo_{i}").cast("double").alias("min"), F.col(f"hi_{i}").cast("double").alias("max"), F.col(f"avg_{i}").cast("double").alias("mean"), bound(c, "low").alias("schema_min"), bound(c, "high").alias("schema_max")) for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def metric_coverage(df: DataFrame) -> DataFrame:
    """One row: unique manufacturers, models and years, and the rows with each numeric metric."""
    return df.agg(F.count("*").alias("total"), *[F.count_distinct(c).alias(f"unique_{c}") for c in ("manufacturer", "model", "year")], *[F.count(name(c)).alias(c) for c in NUMERIC if c in df.columns])


Steps = dict[str, tuple[Callable[[DataFrame], DataFrame], tuple[str, ...]]]


def _flagged(df: DataFrame, steps: Steps) -> tuple[DataFrame, list[Column]]:
    """df after all steps, with a flag a step (_changed_i): whether it changed one of its columns; and their counts."""
    now, counts = df, []
    for i, (_, (step, columns)) in enumerate(steps.items()):
        before = now.withColumns({f"_before_{c}": name(c) for c in columns})
        changed = reduce(or_, [~name(c).eqNullSafe(name(f"_before_{c}")) for c in columns])
        now = step(before).withColumn(f"_changed_{i}", changed).drop(*[f"_before_{c}" for c in columns])
        counts.append(F.count_if(F.col(f"_changed_{i}")).alias(f"n_{i}"))
    return now, counts


def step_counts(df: DataFrame, steps: Steps) -> DataFrame:
    """(step, changed): for each step in turn, the rows in which it changes one of its columns; one pass over df.

    A step is a projection of df's rows and the columns that count.
    """
    now, flags = _flagged(df, steps)
    cells = [F.struct(F.lit(s).alias("step"), F.col(f"n_{i}").alias("changed")) for i, s in enumerate(steps)]
    return now.agg(*flags).select(F.inline(F.array(*cells)))


class Watched:
    """What steps changed, counted while their result is written: ``df`` is df after all steps, ``counts`` is there once df has been written.

    Steps are projections, and df should be written as it is: then rows are counted in the tasks that write them,
    each of which counts once however often it's tried. Behind a shuffle, a stage that runs again would count again.
    """

    def __init__(self, df: DataFrame, steps: Steps):
        now, counts = _flagged(df, steps)
        self._seen, self._steps = Observation(), tuple(steps)
        self.df = now.observe(self._seen, F.count(F.lit(1)).alias("rows"), *counts).drop(*[f"_changed_{i}" for i in range(len(steps))])

    def counts(self) -> dict[str, int]:
        """Changed rows by step. Waits for df's first action; an empty table has zeros."""
        seen = self._seen.get
        return {s: seen.get(f"n_{i}", 0) for i, s in enumerate(self._steps)}


def bar(share: float, width: int = 20) -> str:
    n = round(width * max(0.0, min(1.0, share)))
    return "█" * n + "░" * (width - n)


def bar_of(percent: Column, width: int = 20) -> Column:
    """The same as a column, of a share in percent."""
    n = F.bround(width * F.greatest(F.lit(0.0), F.least(F.lit(1.0), percent / 100))).cast("int")
    return F.when(percent.isNotNull(), F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), width - n)))


def report_table(df: DataFrame, top: int = 20) -> DataFrame:
    """The report's figures as rows (section, name, count, share in percent, bar), for a catalog of any size.

    Sections: total; fields (filled values); sources, manufacturers and countries (the ``top`` most frequent); years
    (first and last as counts, no share). Nothing of it comes to the driver.
    """
    rows = lambda d, section, label, count: d.select(F.lit(section).alias("section"), label.cast("string").alias("name"), count.cast("long").alias("count"))
    values = F.col("value"), F.col("count")
    out = rows(df.agg(F.count("*").alias("count")), "total", F.lit("records"), F.col("count"))
    out = out.unionByName(rows(completeness(df), "fields", F.col("field"), F.col("filled")))
    if "sources" in df.columns:
        out = out.unionByName(rows(source_distribution(df).limit(top), "sources", *values))
    for section, column in (("manufacturers", "manufacturer"), ("countries", "country")):
        if column in df.columns:
            out = out.unionByName(rows(distribution(df.where(F.coalesce(name(column), F.lit("")) != ""), column, top), section, *values))
    span = year_span(df).select(F.inline(F.array(F.struct(F.lit("first").alias("label"), F.col("year_min").alias("y")), F.struct(F.lit("last").alias("label"), F.col("year_max").alias("y")))))
    out = out.unionByName(rows(span, "years", F.col("label"), F.col("y")))
    total = F.broadcast(df.agg(F.count("*").alias("_total")))  # one row
    share = F.when(F.col("section") != "years", F.try_divide(F.col("count") * 100.0, F.col("_total")))
    return out.join(total).withColumn("share", share).withColumn("bar", bar_of(F.col("share"))).drop("_total")


def report(df: DataFrame, makers: Makers | None = None, issues: DataFrame | None = None, top: int = 20, most: int = 1000) -> dict:
    """The report's figures: a few small aggregates, collected. most: sources and countries shown, as their text is free."""
    rows = lambda d: [r.asDict() for r in d.collect()]
    out = {
        "total": df.count(),
        "fields": sorted(rows(completeness(df)), key=lambda r: COLUMNS.index(r["field"])),
        "sources": rows(source_distribution(df).limit(most)),
        "manufacturers": rows(distribution(df, "manufacturer", top)),
        "countries": rows(distribution(df, "country", most)),
        "years": rows(year_span(df))[0],
        "numeric": rows(numeric_stats(df)),
    }
    if makers is not None:
        out["country_names"] = {r["value"]: r["name"] for r in rows(distribution(df, "country", most).select("value", country_name(F.col("value"), makers).alias("name")))}
    if issues is not None:
        out["issues"] = rows(issues.groupBy("severity").agg(F.count("*").alias("count")).orderBy("severity"))
    return out


def as_text(r: dict) -> str:
    lines = ["CATALOG QUALITY REPORT", f"Records: {r['total']:,}", f"Years: {r['years']['year_min']} - {r['years']['year_max']}", "", "Fields"]
    lines += [f"  {f['field']:<24} {bar((f['fill_rate'] or 0) / 100)} {f['fill_rate'] or 0:6.1f} %  {f['distinct']:>8,} values" for f in r["fields"]]
    for title in ("sources", "manufacturers", "countries"):
        lines += ["", title.title(), *(f"  {x['value'] or '-':<30} {x['count']:>8,}" for x in r[title])]
    if "issues" in r:
        lines += ["", "Issues", *(f"  {x['severity']:<10} {x['count']:>8,}" for x in r["issues"])]
    return "\n".join(lines) + "\n"


def as_json(r: dict) -> str:
    return json.dumps(r, ensure_ascii=False, indent=2, default=str)


def as_html(r: dict) -> str:
    cell = lambda x: f"<td>{html.escape('' if x is None else str(x))}</td>"
    table = lambda rows: "<table>" + (f"<tr>{''.join(f'<th>{html.escape(k)}</th>' for k in rows[0])}</tr>" if rows else "") + "".join(f"<tr>{''.join(map(cell, x.values()))}</tr>" for x in rows) + "</table>"
    parts = [f"<h1>Catalog quality</h1><p>{r['total']:,} records</p>"]
    parts += [f"<h2>{k.title()}</h2>{table(r[k])}" for k in ("fields", "sources", "manufacturers", "countries", "numeric", "issues") if k in r]
    return "<!DOCTYPE html><meta charset='utf-8'>" + "".join(parts)


FORMATS = {"text": as_text, "json": as_json, "html": as_html}
