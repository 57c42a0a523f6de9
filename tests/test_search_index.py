"""The search index by whole numbers, its packing and dealing, and how often it reads the catalog."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marque.operators import catalog_query as cq
from marque.operators import search_index
from marque.operators.search_index import SearchIndex
from marque.operators.store import tokens, with_derived
from tests.test_stored import TEXTS, _cars


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _numbered(spark, n=600):
    return with_derived(_cars(spark, n).withColumn("row", F.monotonically_increasing_id() - 5)).cache()


@pytest.mark.parametrize("postings", [200, 5_000_000])
def test_numbers_find_what_the_scan_finds(spark, tmp_path, monkeypatch, postings):
    monkeypatch.setattr(search_index, "FOLDER_POSTINGS", postings)
    monkeypatch.setattr(search_index, "PACKED_ROWS", 40)
    cars = _numbered(spark)
    index = SearchIndex.build(cars, f"file://{tmp_path}", "row", folders=7, piece=9, unique=True)
    assert dict(index.ids("car").dtypes) == {"id": "bigint"}
    for t in TEXTS:
        q = cq.CatalogQuery(search=t, yearMin=1995)
        rows = lambda index, q=q: sorted(map(str, cq.filtered(cars, q, index).collect()))
        assert rows(SearchIndex(spark, index.path)) == rows(None), t
    # every posting is there once, in pieces of bounded size with numbers of their own
    written = spark.read.parquet(f"{index.path}/postings")
    pairs = written.select("token", F.explode("ids").alias("row"))
    wanted = cars.select(F.explode(F.array_distinct("search_tokens")).alias("token"), "row")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, wanted.collect()))
    assert written.agg(F.max(F.size("ids"))).first()[0] <= 9 and written.select("piece").distinct().count() == written.count()


def test_rows_found_by_their_own_number_are_not_tested(spark, tmp_path):
    cars = _numbered(spark)
    q = cq.CatalogQuery(search="porsche carrera")
    by_row = SearchIndex.build(cars, f"file://{tmp_path}/row", "row", unique=True)
    by_id = SearchIndex.build(cars, f"file://{tmp_path}/id")
    assert "array_contains" not in _plan(cq.filtered(cars, q, by_row))
    assert "array_contains" in _plan(cq.filtered(cars, q, by_id))  # rows may share an id


@pytest.mark.parametrize("unique", [True, False])
def test_many_searches_equal_one_at_a_time(spark, tmp_path, unique):
    twice = spark.createDataFrame([("id-0", "Lucid", "car", "2001", 1.0), ("id-0", "Ford", "zz", "", 1.0), ("id-0", "Ford", "zz", "2001", 1.0)], "car_id string, manufacturer string, model string, year string, power_hp double")
    cars = with_derived(_cars(spark).unionByName(twice).withColumn("row", F.monotonically_increasing_id())).cache()
    index = SearchIndex.build(cars, f"file://{tmp_path}", "row" if unique else "car_id", folders=4, piece=50, unique=unique)
    texts = [*TEXTS, "id-0 car", "id-0 zz", "lucid zz", "porsche carrera porsche", TEXTS[0]]
    got = sorted((r["search"], r["row"]) for r in cq.searched(cars, texts, index).select("search", "row").collect())
    assert got == sorted((t, r["row"]) for t in set(texts) for r in cq.filtered(cars, cq.CatalogQuery(search=t)).select("row").collect() if t.strip())
    assert cq.searched(cars, [], index).count() == 0


def test_a_build_reads_the_catalog_three_times(spark, tmp_path):
    """To count it, for the bounds, and to pack it; what it shuffles are pieces, not postings."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    cars = _cars(spark)
    counted = cars.mapInArrow(seen, cars.schema)
    index = SearchIndex.build(counted, f"file://{tmp_path}", folders=5)
    assert read.value <= 3 * 600
    assert index.ids("porsche").count() == cars.where("manufacturer = 'Porsche'").count()


def test_a_token_of_many_ids_fills_several_ranges(spark, tmp_path):
    cars = _numbered(spark, 2000)
    index = SearchIndex.build(cars, f"file://{tmp_path}", "row", folders=10, piece=20, unique=True)
    written = spark.read.parquet(f"{index.path}/postings")
    held = [r["n"] for r in written.groupBy("folder").agg(F.sum(F.size("ids")).alias("n")).collect()]
    assert len(held) == 10 and max(held) <= 2 * sum(held) / 10
    assert written.where("token = 'id'").select("folder").distinct().count() > 1


def test_rows_without_id_or_tokens(spark, tmp_path):
    kind = "car_id string, search_tokens array<string>"
    rows = [("a", ["x", "x", "y"]), ("b", None), ("c", []), (None, ["x"]), ("d", ["x", None]), ("a", ["z"])]
    index = SearchIndex.build(spark.createDataFrame(rows, kind), f"file://{tmp_path}", piece=1)
    found = lambda t: sorted(r["id"] for r in index.ids(t).collect())
    assert found("x") == ["a", "d"] and found("y z") == ["a"] and found("z") == ["a"] and found("q") == []


def test_packing_is_bounded():
    from pyspark import TaskContext

    made = [pa.RecordBatch.from_pydict({"id": list(range(i * 10, i * 10 + 10)), "tokens": [["t", str(k % 3)] for k in range(10)]}) for i in range(10)]
    before, TaskContext._taskContext = TaskContext._taskContext, TaskContext()
    TaskContext._taskContext._partitionId = 3
    try:
        out = list(search_index._packing([], 4, 1000, 25, 10**9)(iter(made)))
    finally:
        TaskContext._taskContext = before
    assert [sum(len(x) for t, x in zip(b["token"].to_pylist(), b["ids"].to_pylist(), strict=True) if t == "t") for b in out] == [30, 30, 30, 10]
    assert all(r == 0 for b in out for r in b["range"].to_pylist())


def test_tokens_fold_as_before(spark):
    texts = ["", "  ", "Élan GT-R", "ŠKODA 1.9", "K 5", "a--b", "--", "ÀÉÎ õ ş", "日本 車", "İstanbul", None]
    plain = F.filter(F.split(F.translate(F.lower("t"), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿčćšžđřěůłńśźżșțőű", "aaaaaaceeeeiiiinoooooouuuuyyccszdreulnszzastou"), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t")).alias("a"), plain.alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())
