"""The data source of HTML tables against the reader that goes through Spark's files."""

from __future__ import annotations

import random

import pytest

from marque.sources import readers
from marque.sources.html_source import SCHEMA, scan_html_tables


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    rnd, folder = random.Random(3), tmp_path_factory.mktemp("pages")
    (folder / "a b=ü").mkdir()
    for i in range(40):
        tables = []
        for t in range(rnd.randrange(4)):
            body = "".join(f"<tr><td>{i}.{t}.{r} &amp; ü</td><td>{'x' * rnd.randrange(30)}</td></tr>" for r in range(rnd.randrange(5)))
            css = rnd.choice(["wikitable sortable", "wikitable", "other"])
            tables.append(f"<h2>{rnd.choice(['One', 'Two', 'Österreich', ''])}</h2><table class='{css}'><tr><th>A</th><th>B{t}</th></tr>{body}</table>")
        (folder / ("a b=ü" if i % 4 == 0 else "") / f"p {i}.html").write_text("".join(tables), encoding="utf-8")
    (folder / "empty.html").write_text("")
    (folder / "_hidden.html").write_text("<table class=wikitable><tr><th>A</th></tr><tr><td>no</td></tr></table>")
    (folder / "none.txt").write_text("<table class=wikitable><tr><th>A</th></tr><tr><td>no</td></tr></table>")
    return folder


def _all(df):
    return sorted(map(str, df.select("section", "table_idx", "row_idx", "cells", "header", "source_file").collect()))


@pytest.mark.parametrize("size", [1, 2000, 64_000_000])
def test_equals_the_reader(spark, pages, size):
    got = scan_html_tables(spark, str(pages), partitionBytes=size)
    assert got.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    paths = [str(p) for p in pages.rglob("*.html") if not p.name.startswith("_")]
    want = readers.read_html_tables(spark, paths)
    assert _all(got) == _all(want) and got.count() > 50
    n = got.rdd.getNumPartitions()
    assert 25 < n <= 41 if size == 1 else n == 1 if size > 1_000_000 else 1 < n < 25


def test_choices_of_the_scan(spark, pages):
    scan = lambda **k: scan_html_tables(spark, f"file://{pages}", partitionBytes=1, **k)
    kept = scan().collect()
    some = sorted({r.source_file for r in kept})[3:5]
    text = lambda rows: sorted(map(str, rows))
    for names in (["One"], ["Two", ""], ["nowhere"], []):
        assert text(scan(sections=names).collect()) == text(r for r in kept if r.section in names)
    two = scan(source_files=[*some, "file:/none"])
    assert text(two.collect()) == text(r for r in kept if r.source_file in some)
    assert two.rdd.getNumPartitions() == 2  # the other files aren't planned
    assert text(scan(sections=["One"], source_files=some).collect()) == text(r for r in kept if r.source_file in some and r.section == "One")


def test_branches_of_one_scan_keep_their_own_filters(spark, pages):
    df = scan_html_tables(spark, str(pages))
    kept = df.collect()
    both = df.where("section = 'One'").unionByName(df.where("section = 'Two' and row_idx > 1")).unionByName(df.where("section > 'Two'"))
    want = [r for r in kept if r.section == "One"] + [r for r in kept if r.section == "Two" and r.row_idx > 1] + [r for r in kept if r.section > "Two"]
    assert sorted(map(str, both.collect())) == sorted(map(str, want)) and sorted(map(str, df.collect())) == sorted(map(str, kept))


def test_no_file_and_no_path(spark, tmp_path):
    assert scan_html_tables(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="FileNotFound"):
        scan_html_tables(spark, f"{tmp_path}/none").collect()
