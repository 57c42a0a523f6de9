"""Reading files: CSV of strings with provenance, JSON in cells, file hashes, directories, HTML tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from marque.schema import conform

CSV_OPTIONS = {"header": "true", "inferSchema": "false", "multiLine": "true", "escape": '"', "encoding": "UTF-8", "mode": "PERMISSIVE"}
PROVENANCE = ("source_file", "source_row")


def read_csv(spark: SparkSession, path: str | list[str], skip_files: Iterable[str] = (), recursive: bool = False) -> DataFrame:
    """CSV files as strings, with source_file and source_row (the header is row 1). path may be a glob.

    Files with quoted line breaks can't be split, so a file is read by one task and its rows come
    in order; numbering needs a window over one file only.
    """
    r = spark.read.options(**CSV_OPTIONS)
    if recursive:
        r = r.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    df = r.csv(path)
    cols = df.columns
    df = df.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("_name"), F.monotonically_increasing_id().alias("_m"))
    if skip := list(skip_files):
        df = df.where(~F.col("_name").isin(*skip))
    row = F.row_number().over(Window.partitionBy("source_file").orderBy("_m")) + 1
    return df.withColumn("source_row", row).select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in cols], *PROVENANCE)


def read_directory(spark: SparkSession, folder: str, can_parse: Callable[[str], bool] = lambda _: True, pattern: str = "*.csv") -> DataFrame:
    """The CSV files of a folder, by name, whose path a parser can take. Paths are listed, not files read, to choose them."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").distinct().orderBy("path")
    use = [r.path for r in paths.toLocalIterator() if can_parse(r.path)]
    if not use:
        raise ValueError(f"no file of {folder} fits")
    return read_csv(spark, use)


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """A catalog CSV in the catalog's types, with seq as it stands in the file."""
    df = read_csv(spark, path)
    return conform(df, F.col("source_row").cast("long").alias("seq"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def json_objects(df: DataFrame, column: str, out: str = "specs") -> DataFrame:
    """A column of JSON objects of objects as a map of maps; rows whose text isn't such are dropped."""
    return df.withColumn(out, F.from_json(column, "map<string,map<string,string>>")).where(F.col(out).isNotNull())


def find_column(columns: Iterable[str], *parts: str) -> str | None:
    """The first column whose name holds one of the parts, in the order of the parts."""
    low = {c.lower().strip(): c for c in columns}
    return next((c for p in parts for k, c in low.items() if p in k), None)


class _Tables(HTMLParser):
    """Rows of tables of a class, with the heading before each table."""

    def __init__(self, css: str):
        super().__init__(convert_charrefs=True)
        self.css, self.rows, self.section, self.table = css, [], "", -1
        self.depth = self.row = 0
        self.cells: list[str] | None = None
        self.text: list[str] | None = None
        self.heading = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            if self.depth or self.css in (dict(attrs).get("class") or "").split():
                self.depth += 1
                if self.depth == 1:
                    self.table, self.row = self.table + 1, 0
        elif tag == "h2":
            self.heading, self.text = True, []
        elif self.depth == 1 and tag == "tr":
            self.cells = []
        elif self.depth == 1 and tag in ("td", "th") and self.cells is not None:
            self.text = []

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag == "h2" and self.heading:
            self.section, self.heading, self.text = " ".join("".join(self.text or []).split()), False, None
        elif self.depth == 1 and tag in ("td", "th") and self.cells is not None and self.text is not None:
            self.cells.append(" ".join("".join(self.text).split()))
            self.text = None
        elif self.depth == 1 and tag == "tr" and self.cells is not None:
            if self.cells:
                self.rows.append((self.section, self.table, self.row, self.cells))
                self.row += 1
            self.cells = None

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)


def table_rows(page: str | None, css: str = "wikitable") -> Iterator[tuple[str, int, int, list[str]]]:
    """(section, table, row, cells) of a page's tables of a class; row 0 is the header."""
    p = _Tables(css)
    p.feed(page or "")
    p.close()
    yield from p.rows


_ROW = T.StructType([T.StructField("section", T.StringType()), T.StructField("table_idx", T.IntegerType()), T.StructField("row_idx", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))])


@udtf(returnType=_ROW)
class html_table_rows:  # noqa: N801  called as a SQL function
    def eval(self, page: str):
        yield from table_rows(page)


def read_html_tables(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the wikitables of HTML files: section, table_idx, row_idx, cells, header, source_file."""
    pages = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))
    rows = pages.lateralJoin(html_table_rows(F.col("value").outer()))
    head = rows.where("row_idx = 0").select("source_file", "table_idx", F.col("cells").alias("header"))
    return rows.where("row_idx > 0").join(head, ["source_file", "table_idx"]).select("section", "table_idx", "row_idx", "cells", "header", "source_file")


def cell(*parts: str):
    """The cell of a table row under the first header that holds one of the parts; blank if there is none."""

    def place(part: str):
        return F.nullif(F.array_position(F.transform("header", lambda h: F.contains(F.lower(h), F.lit(part))), True), F.lit(0))

    at = F.coalesce(*[place(p) for p in parts])
    return F.coalesce(F.get("cells", (at - 1).cast("int")), F.lit(""))
