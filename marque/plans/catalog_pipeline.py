"""The catalog pipeline: stage, merge, deduplicate, enrich, clean, validate, write."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marque.functions.columns import name
from marque.functions.text import repaired, stored_model
from marque.operators.clean import COUNTED as CLEANED
from marque.operators.clean import clean
from marque.operators.enrich import COUNTED as ENRICHED
from marque.operators.enrich import default_propulsion, enrich
from marque.operators.makers import Makers, country_of, normalize
from marque.operators.quality_report import FORMATS, Watched, report
from marque.operators.survivorship import deduplicate, merge, merge_filling_year, merge_plain
from marque.operators.validate import PROPULSIONS, numbered, validate
from marque.schema import COLUMNS, catalog_type
from marque.session import cut
from marque.sources.changes import Changes, stage_changed
from marque.sources.readers import read_catalog_csv
from marque.sources.registry import SourceSpec, stage
from marque.sources.sinks import write_csv, write_tables

MERGES = {"key": merge, "fill_year": merge_filling_year}


@dataclass(frozen=True)
class Outcome:
    catalog: DataFrame
    rejects: DataFrame
    unknown: tuple[str, ...] = ()
    written: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)  # rows that each step changed
    changes: dict[str, Changes] = field(default_factory=dict)  # files by source, where staged rows are kept


def load_existing(spark: SparkSession, path: str | None, makers: Makers) -> DataFrame:
    """An existing catalog CSV with names, countries and models normalised anew; empty without a path."""
    if path is None:
        t = catalog_type()
        for f in t.fields:
            f.metadata = {}
        return spark.createDataFrame([], t.add("seq", "long"))
    df = repaired(read_catalog_csv(spark, path), "model")
    m = normalize(F.col("manufacturer"), makers)
    return df.withColumns({"manufacturer": m, "country": F.coalesce(F.nullif(country_of(m, makers), F.lit("")), "country"), "model": stored_model(F.col("model"))})


def transform(existing: DataFrame, staged: DataFrame, makers: Makers, variant: str = "key", counts: dict[str, int] | None = None) -> DataFrame:
    """The catalog of existing and staged rows; both have seq.

    counts: takes the rows that each step of enrichment and cleaning changed, counted as their results are written.
    """
    new = staged.select(*[name(c) for c in COLUMNS], "seq")
    once = cut(deduplicate(cut(MERGES[variant](existing, new, makers)), makers))
    if counts is None:
        better = cut(clean(cut(enrich(default_propulsion(once)))))
    else:
        better = default_propulsion(once)
        for steps in (ENRICHED, CLEANED):
            seen = Watched(better, steps)
            better = cut(seen.df)
            counts |= seen.counts()
    return cut(deduplicate(better, makers))  # cleaning may make keys equal


def run(spark: SparkSession, specs: Iterable[SourceSpec], makers: Makers, existing: str | None = None, out: str | None = None, names: Iterable[str] | None = None, variant: str = "key", dry_run: bool = False, kept: str | None = None) -> Outcome:
    """All of it. out: a folder for ``catalog_csv`` and the tables ``cars`` and ``rejected``. kept: a folder that
    holds staged rows from run to run, so that only sources' new and changed files are parsed."""
    s, changes = stage_changed(spark, specs, makers, kept, names) if kept else (stage(spark, specs, makers, names), {})
    counts: dict[str, int] = {}
    catalog = transform(load_existing(spark, existing, makers), s.rows, makers, variant, counts)
    written = {}
    if out and not dry_run:
        write_csv(catalog, f"{out}/catalog_csv")
        cars, rejected = write_tables(catalog, out)
        written = {"csv": f"{out}/catalog_csv", "cars": cars, "rejected": rejected}
    return Outcome(catalog, s.rejects, s.unknown, written, counts, changes)


def validate_csv(spark: SparkSession, path: str, makers: Makers, propulsions: tuple[str, ...] = PROPULSIONS) -> tuple[DataFrame, bool]:
    """Issues of a catalog CSV, and whether none is an error."""
    df = numbered(read_catalog_csv(spark, path).drop("seq"))
    issues = validate(df, makers, propulsions)
    return issues, issues.where("severity = 'ERROR'").isEmpty()


def report_csv(spark: SparkSession, path: str, makers: Makers | None = None, form: str = "text") -> str:
    return FORMATS[form](report(read_catalog_csv(spark, path), makers))


def dedupe_csv(spark: SparkSession, path: str, makers: Makers, out: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The deduplication job on a catalog CSV, without other sources. Without out nothing is written."""
    before = load_existing(spark, path, makers)
    after = deduplicate(before, makers)
    counts = {"before": before.count(), "after": after.count()}
    if out:
        write_csv(after, out)
    return after, counts


def upsert_plain(spark: SparkSession, path: str, new: DataFrame, makers: Makers) -> DataFrame:
    """Rows merged into a catalog CSV by plain equality of names."""
    return merge_plain(load_existing(spark, path, makers), new.select(*[name(c) for c in COLUMNS], "seq"))
