"""What stored tables leave on disk while they are made."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from marque.operators import catalog_query as cq
from marque.operators import page_directory, search_index
from marque.operators.page_directory import PageDirectory, order_of
from marque.operators.search_index import SearchIndex
from marque.operators.store import DERIVED, with_derived, write_clustered
from marque.session import cut
from tests.test_stored import _cars


def _shuffled(spark) -> set[str]:
    """The shuffle files that the executors hold."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def _stays(spark, before: set[str]) -> bool:
    """Whether shuffle files since then are still there; they go by a message to the executors."""
    for _ in range(50):
        if not _shuffled(spark) - before:
            return False
        time.sleep(0.1)
    return True


def test_cut_leaves_no_shuffle_files(spark):
    before = _shuffled(spark)
    made = spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count()
    kept = cut(made)
    assert not _stays(spark, before)
    assert kept.count() == 10
    assert made.count() == 10  # can still run


def test_listing_keeps_the_columns_that_pages_show(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(page_directory, "RANGE_ROWS", 20)
    cars = _cars(spark, 333)
    q = cq.CatalogQuery(sortBy="power_hp", sortOrder="desc", yearMin=1995)
    listing = PageDirectory.build(cars.repartition(5, "model"), q, f"file://{tmp_path}", ranges=3, columns=("model",))
    whole = [tuple(r) for r in cq.filtered(cars, q).orderBy(*cq.ordering(q)).select("model", "power_hp", "car_id").collect()]
    assert [tuple(r) for r in listing.page(1, 500).collect()] == whole and listing.page(1, 1).columns == ["model", "power_hp", "car_id"]
    assert listing.ranges().count() > 6  # more than asked for, where a range would hold too many rows
    row = dict(zip(("model", "power_hp", "car_id"), whole[100], strict=True))
    assert [tuple(r) for r in listing.after(listing.cursor(row, order_of(q)), 60).collect()] == whole[101:161]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["layout", "ranges", "rows"]


def test_clustering_derives_behind_the_shuffle(spark, tmp_path):
    cars = _cars(spark, 300)
    before = _shuffled(spark)
    write_clustered(cars, f"file://{tmp_path}", 8)
    assert not _stays(spark, before)
    got = spark.read.parquet(f"file://{tmp_path}")
    wanted = with_derived(cars)
    assert set(DERIVED) <= set(got.columns) and sorted(map(str, got.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect()))


def test_index_of_several_ranges_a_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "FOLDER_POSTINGS", 100)
    cars = with_derived(_cars(spark))
    before = _shuffled(spark)
    index = SearchIndex.build(cars, f"file://{tmp_path}", folders=4, piece=50)
    assert not _stays(spark, before)
    written = spark.read.parquet(f"{index.path}/postings")
    assert len(written.inputFiles()) > 12 and written.select("folder").distinct().count() == 4
    assert written.groupBy("token", "piece").count().where("count > 1").count() == 0
    fences = sorted((r["low"], r["high"]) for r in spark.read.parquet(f"{index.path}/fences").collect())
    assert all(a[1] <= b[0] for a, b in zip(fences, fences[1:], strict=False))
    for t in ("porsche car", "id-17", "m5", "elan 911"):
        q = cq.CatalogQuery(search=t)
        assert sorted(map(str, cq.filtered(cars, q, index).collect())) == sorted(map(str, cq.filtered(cars, q).collect()))
