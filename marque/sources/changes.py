"""Sources staged again only where their files changed.

``StagedFiles`` keeps the parsed rows of a source's files in runs that are only added to, and beside them a
manifest: for each file its size, time, digest and the run that holds its rows. A refresh lists the
files, without opening them. Those of the manifest's size and time are left alone; the rest are hashed, and
only those of another digest are parsed, into a new run. What counts is what the manifest names, so rows of a
file that changed or went are retracted by the new manifest, which is written last: a job that
fails midway leaves the old state, and can be run again. One writer at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marque.operators.makers import Makers
from marque.session import cut, delete
from marque.sources.registry import SourceSpec, Staged, chosen, numbered_rows, stage_one

#: Files above this size aren't hashed, as a task would hold one whole: they count as changed when their size or time differs.
HASHED_BYTES = 256_000_000
_MANIFEST = "source_file string, path string, length long, modified timestamp, sha256 string, version string, run int, n_rows long"


@dataclass(frozen=True)
class Changes:
    """Paths by what became of them; touched ones have a new time and the same content."""

    added: tuple[str, ...]
    changed: tuple[str, ...]
    touched: tuple[str, ...]
    removed: tuple[str, ...]
    unchanged: int

    @property
    def parsed(self) -> tuple[str, ...]:
        return self.added + self.changed


def literal_path(path: str) -> str:
    """A path as it stands, for a reader that takes globs. (Spark finds the columns of multi-line CSV by a second look-up, which fails on names with brackets or braces.)"""
    return re.sub(r"([*?\[\]{}\\,])", r"\\\1", path)


def listed_files(spark: SparkSession, path: str | list[str], pattern: str = "*", skip_files: Iterable[str] = ()) -> DataFrame:
    """(source_file, path, length, modified) of files, from the listing alone; names that Spark hides (_x, .x) are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    out = files.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("_name"), "path", "length", F.col("modificationTime").alias("modified"))
    return out.where(~F.col("_name").isin(*skip_files)).drop("_name")


class StagedFiles:
    """The staged rows of one source, by file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        """The numbers of the manifests that were written whole."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        at = lambda n: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{n}/_SUCCESS")
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(at(n)))

    def manifest(self) -> DataFrame:
        """A row a file whose rows are held; empty before the first refresh."""
        known = self._versions()
        if not known:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={known[-1]}")

    def _commit(self, files: DataFrame) -> None:
        known = self._versions()
        files.select(*[f.split()[0] for f in _MANIFEST.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/manifest/v={known[-1] + 1 if known else 0}")
        for v in known[:-1]:  # the last one stays for those who read it now
            delete(self.spark, f"{self.path}/manifest/v={v}")

    def _runs(self) -> DataFrame:
        """Every row ever parsed and not yet compacted away, with its run. Only runs that the manifest names are read."""
        live = [r[0] for r in self.manifest().where("n_rows > 0").select("run").distinct().collect()]  # a number a refresh
        rows = self.spark.read.option("basePath", f"{self.path}/rows")
        if not live:  # no file is left that had rows: the columns come from what there was
            return rows.parquet(f"{self.path}/rows").where(F.lit(False)).withColumn("run", F.col("run").cast("int"))
        return rows.parquet(*[f"{self.path}/rows/run={r}" for r in live]).withColumn("run", F.col("run").cast("int"))

    def read(self) -> DataFrame:
        """The rows of the files as they were at the last refresh, with source_file. Raises ValueError if nothing was ever parsed."""
        if not self._versions():
            raise ValueError(f"nothing is staged at {self.path}")
        return self._runs().join(self.manifest().select("source_file", "run"), ["source_file", "run"], "left_semi").drop("run")

    def refresh(self, files: DataFrame, parse: Callable[[list[str]], DataFrame], version: str = "", whole: bool = False) -> Changes:
        """Parses the files that are new or changed and retracts those that went.

        files: as of listed_files. parse: the rows, with source_file, of a list of paths; it's called only if there are any.
        version: of the parser and its parameters; files parsed under another one count as changed. whole: the files
        make sense only together, so a change in one has all parsed again.
        """
        spark, old = self.spark, self.manifest()
        now = files.alias("n").join(old.alias("o"), "source_file", "full_outer")
        same = F.col("n.length").eqNullSafe(F.col("o.length")) & F.col("n.modified").eqNullSafe(F.col("o.modified"))
        state = cut(now.select(
            "source_file", F.coalesce("n.path", "o.path").alias("path"), F.col("n.length").alias("length"), F.col("n.modified").alias("modified"), F.col("o.length").alias("old_length"), "o.sha256", "o.run", "o.n_rows",
            F.col("o.path").isNull().alias("is_new"), F.col("n.path").isNull().alias("is_gone"), (same & (F.col("o.version") == version)).alias("same"), (F.col("o.version") == version).alias("same_version"),
        ))
        suspects = [r["path"] for r in state.where("not is_gone and not coalesce(same, false)").select("path").toLocalIterator()]
        if suspects:
            opened = spark.read.format("binaryFile").load([literal_path(p) for p in suspects])
            content = F.sha2(F.col("content"), 256)
            small = opened.where(F.col("length") <= HASHED_BYTES).select(F.col("_metadata.file_path").alias("source_file"), content.alias("digest"))
            state = cut(state.join(small, "source_file", "left"))
        else:
            state = state.withColumn("digest", F.lit(None).cast("string"))
        differs = ~F.coalesce("same", F.lit(False)) & (F.col("is_new") | ~F.coalesce("same_version", F.lit(False)) | F.col("digest").isNull() | ~F.col("digest").eqNullSafe(F.col("sha256")))
        kind = F.when(F.col("is_gone"), "removed").when(F.col("is_new"), "added").when(differs, "changed").when(F.coalesce("same", F.lit(False)), "unchanged").otherwise("touched")
        state = state.withColumn("kind", kind)
        if whole and not state.where("kind in ('removed', 'added', 'changed')").isEmpty():
            state = state.withColumn("kind", F.when(F.col("kind").isin("unchanged", "touched"), "changed").otherwise(F.col("kind")))
        by = {k: [] for k in ("added", "changed", "touched", "removed")}
        for r in state.where("kind <> 'unchanged'").select("kind", "path").orderBy("path").toLocalIterator():
            by[r["kind"]].append(r["path"])
        out = Changes(*(tuple(by[k]) for k in by), state.where("kind = 'unchanged'").count())
        run = (old.agg(F.max("run")).first()[0] or 0) + 1
        fresh = state.where("kind in ('added', 'changed')").select("source_file", "path", "length", "modified", F.coalesce("digest", "sha256").alias("sha256"), F.lit(version).alias("version"), F.lit(run).alias("run"))
        if out.parsed:
            parse(list(out.parsed)).write.mode("overwrite").parquet(f"{self.path}/rows/run={run}")
            held = spark.read.parquet(f"{self.path}/rows/run={run}").groupBy("source_file").agg(F.count("*").alias("n_rows"))
            fresh = fresh.join(held, "source_file", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
        else:
            fresh = fresh.withColumn("n_rows", F.lit(0))
        if out.parsed or out.touched or out.removed:
            kept = state.where("kind in ('unchanged', 'touched')").select("source_file", "path", "length", "modified", F.coalesce("digest", "sha256").alias("sha256"), F.lit(version).alias("version"), "run", "n_rows")
            self._commit(kept.unionByName(fresh))
        return out

    def compact(self) -> None:
        """Rewrites the live rows as one run and drops the others; no source file is read. Readers of the old state must be done."""
        files = cut(self.manifest())
        runs = [r[0] for r in files.select("run").distinct().collect()]
        if not runs:
            return
        run = max(runs) + 1
        self.read().write.mode("overwrite").parquet(f"{self.path}/rows/run={run}")
        self._commit(files.withColumn("run", F.lit(run)))
        for r in range(run):
            delete(self.spark, f"{self.path}/rows/run={r}")


def stage_changed(spark: SparkSession, specs: Iterable[SourceSpec], makers: Makers, path: str, names: Iterable[str] | None = None) -> tuple[Staged, dict[str, Changes]]:
    """What ``stage`` gives, with only new and changed files parsed; and what changed, by source. path: a folder of the store's own.

    The files of a source are those of its path with its parser's columns; other manufacturers have everything parsed again.
    """
    import hashlib

    use, unknown = chosen(specs, names)
    if not use:
        raise ValueError("no source is enabled")
    seen, parts = {}, []
    for i, s in enumerate(use):
        pair = s.parser == "autoevolution"  # engines and automobiles are joined
        version = hashlib.sha256(repr((s.parser, s.skip_files, makers)).encode()).hexdigest()[:16]
        store = StagedFiles(spark, f"{path}/{s.name}")
        files = listed_files(spark, [f"{s.path}/{n}.csv" for n in ("engines", "automobiles")] if pair else s.path, skip_files=s.skip_files)
        parse = lambda paths, s=s, pair=pair: stage_one(spark, s if pair else replace(s, path=[literal_path(p) for p in paths]), makers)
        seen[s.name] = store.refresh(files, parse, version, whole=pair)
        parts.append(store.read().withColumn("_s", F.lit(i)))
    return numbered_rows(reduce(lambda a, b: a.unionByName(b), parts), unknown), seen
