"""The catalog of sources, and staging them in order."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marque.operators.makers import Makers
from marque.session import cut
from marque.sources.parsers import autoevolution_rows, get_parser
from marque.sources.readers import read_csv


@dataclass(frozen=True)
class SourceSpec:
    name: str
    parser: str
    path: str | list[str]  # a file, glob or directory, or several; for autoevolution the directory of its CSV files
    enabled: bool = True
    skip_files: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class Staged:
    rows: DataFrame  # usable rows, with seq
    rejects: DataFrame  # reason, source, source_file, source_row
    unknown: tuple[str, ...]  # asked for but not in the catalog


def chosen(specs: Iterable[SourceSpec], names: Iterable[str] | None = None) -> tuple[list[SourceSpec], tuple[str, ...]]:
    """The enabled specs in their order, or those asked for; names that aren't known."""
    all_specs = list(specs)
    if names is None:
        return [s for s in all_specs if s.enabled], ()
    known = {s.name: s for s in all_specs}
    names = list(names)
    return [known[n] for n in names if n in known and known[n].enabled], tuple(n for n in names if n not in known)


def stage_one(spark: SparkSession, spec: SourceSpec, makers: Makers) -> DataFrame:
    parser = get_parser(spec.parser)
    if spec.parser == "autoevolution":
        engines, autos = (read_csv(spark, f"{spec.path}/{n}.csv") for n in ("engines", "automobiles"))
        return parser(autoevolution_rows(engines, autos.select("id", "image", "name")), makers)
    return parser(read_csv(spark, spec.path, spec.skip_files), makers)


def stage(spark: SparkSession, specs: Iterable[SourceSpec], makers: Makers, names: Iterable[str] | None = None) -> Staged:
    """All sources' rows, in the order of sources, files and rows as seq."""
    use, unknown = chosen(specs, names)
    if not use:
        raise ValueError("no source is enabled")
    return numbered_rows(cut(reduce(lambda a, b: a.unionByName(b), [stage_one(spark, s, makers).withColumn("_s", F.lit(i)) for i, s in enumerate(use)])), unknown)


def numbered_rows(every: DataFrame, unknown: tuple[str, ...]) -> Staged:
    """Parsed rows, with their source's place as _s, as staged ones."""
    good = every.where("reject is null").drop("reject")
    # The place among a source's files comes from a small table of file names, so numbering needs no global sort.
    files = good.select("_s", "source_file").distinct().withColumn("_f", F.dense_rank().over(Window.partitionBy("_s").orderBy("source_file")))
    seq = (F.col("_s").cast("long") * 1_000_000 + F.col("_f")) * 10_000_000_000 + F.coalesce("source_row", F.lit(0))
    good = good.join(files, (good["_s"] == files["_s"]) & good["source_file"].eqNullSafe(files["source_file"])).drop(files["_s"]).drop(files["source_file"]).withColumn("seq", seq.cast("long")).drop("_s", "_f")
    bad = every.where("reject is not null").select(F.col("reject").alias("reason"), "source", "source_file", "source_row")
    return Staged(good, bad, unknown)


def sources_df(spark: SparkSession, specs: Iterable[SourceSpec]) -> DataFrame:
    rows = [(i, s.name, s.parser, s.path, s.enabled, s.description) for i, s in enumerate(specs)]
    return spark.createDataFrame(rows, "position int, name string, parser string, path string, enabled boolean, description string")
