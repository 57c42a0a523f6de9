"""HTML tables as a Python data source: files are dealt to partitions by their bytes, and choices of files and sections reach the scan.

A page is read once, and each row comes with its table's header; ``readers.read_html_tables``, which goes
through Spark's own file reader, joins the headers to the rows. The files must lie where pyarrow's file
systems reach them (local or shared folders, HDFS, S3 and the like); elsewhere use that reader.

The choices are options and not filters that Spark pushes: it keeps what it pushed to a Python source in the
relation, which all branches of a plan share, so that in 4.1.2 the union of two filters of one scan got the
rows of the second twice. A filter on the result is applied by Spark, after parsing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marque.sources.readers import table_rows

SCHEMA = "section string, table_idx int, row_idx int, cells array<string>, header array<string>, source_file string"
#: Bytes of files a partition; a larger file is one by itself.
PARTITION_BYTES = 64_000_000


@dataclass
class Files(InputPartition):
    paths: tuple[tuple[str, str], ...]  # (source_file, path in the file system)


def _file_system(root: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(root if ":" in root.partition("/")[0] else f"file://{quote(root)}")


def listed(root: str, pattern: str) -> list[tuple[str, str, int]]:
    """(source_file, path, size) of a file, or of the files below a folder whose name fits and isn't hidden, by path."""
    from pyarrow.fs import FileSelector, FileType

    fs, path = _file_system(root)
    info = fs.get_file_info(path)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(root)
    scheme = root.partition(":")[0] if ":" in root.partition("/")[0] else "file"
    host = "" if scheme == "file" else f"{root.partition('://')[2].partition('/')[0]}/"
    prefix = "file:" if scheme == "file" else f"{scheme}://" + ("" if path.startswith(host) else host.rstrip("/"))
    if info.type == FileType.File:
        found = [info]
    else:
        inner = lambda p: p[len(path.rstrip("/")) + 1 :].split("/")
        found = [i for i in fs.get_file_info(FileSelector(path, recursive=True)) if i.type == FileType.File and fnmatch(i.base_name, pattern) and not any(x.startswith(("_", ".")) for x in inner(i.path))]
    uri = lambda p: "".join(c if c > "\x7f" else quote(c, safe="/!~'()*,;:$&+=@") for c in p)  # noqa: E731  as Spark writes paths
    return [(f"{prefix}{uri(i.path)}", i.path, i.size) for i in sorted(found, key=lambda i: i.path)]


class HtmlTableReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.css, self.pattern = options["path"], options.get("css", "wikitable"), options.get("pattern", "*.html")
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.sections, self.source_files = (set(json.loads(options[k])) if options.get(k) else None for k in ("sections", "sourceFiles"))

    def partitions(self) -> Sequence[InputPartition]:
        """Files in the order of their paths, as many a partition as its bytes allow; those not asked for aren't opened."""
        out: list[Files] = []
        held: list[tuple[str, str]] = []
        size = 0
        for name, path, n in listed(self.root, self.pattern):
            if self.source_files is not None and name not in self.source_files:
                continue
            if held and size + n > self.partition_bytes:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append((name, path))
            size += n
        return [*out, Files(tuple(held))]  # an empty last one where nothing fits

    def read(self, partition: Files) -> Iterator[tuple]:
        fs = _file_system(self.root)[0] if partition.paths else None
        for name, path in partition.paths:
            with fs.open_input_stream(path, compression=None) as f:
                page = f.read().decode("utf-8", "replace")
            header: list[str] = []
            for section, table, row, cells in table_rows(page, self.css):
                if row == 0:
                    header = cells
                elif self.sections is None or section in self.sections:
                    yield section, table, row, cells, header, name


class HtmlTables(DataSource):
    """Options: path (a file or a folder, read with all below it), css (the tables' class), pattern (of file names), partitionBytes, and JSON lists of the sections and sourceFiles to read."""

    @classmethod
    def name(cls) -> str:
        return "html_tables"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HtmlTableReader:
        return HtmlTableReader(self.options)


def scan_html_tables(spark: SparkSession, path: str, sections: Iterable[str] | None = None, source_files: Iterable[str] | None = None, **options: str | int) -> DataFrame:
    """Rows of the tables of HTML files below a path: what ``read_html_tables`` gives, of some sections and files if they are named."""
    spark.dataSource.register(HtmlTables)
    chosen = {k: json.dumps(list(v)) for k, v in (("sections", sections), ("sourceFiles", source_files)) if v is not None}
    return spark.read.format("html_tables").options(**options, **chosen).load(path)
