"""Answers to query strings, the report as a table, definitions from a table."""

from __future__ import annotations

import json

from marque.operators import facets, quality_report
from marque.operators.requests import as_json, meta_answer, parameters, percentiles_answer, rows_answer
from marque.operators.search_index import SearchIndex
from marque.operators.store import with_derived
from marque.schema import column_definitions

KIND = "car_id string, manufacturer string, model string, year string, country string, power_hp double, sources string"


def _cars(spark):
    return spark.createDataFrame([(f"c{i}", "BMW" if i % 3 else "Audi", f"M{i}", str(1990 + i % 5) if i else "", "DE" if i % 2 else None, float(i * 100) if i % 4 else None, "a, b" if i % 2 else "a") for i in range(30)], KIND)


def test_rows(spark, tmp_path):
    cars = _cars(spark)
    assert parameters("?a=1&a=2&b=x%20y&c=") == {"a": "1", "b": "x y", "c": ""}
    status, body = rows_answer(cars, "?manufacturer=Audi&sortBy=power_hp&sortOrder=desc&pageSize=3&page=2")
    assert status == 200 and body["pagination"] == {"page": 2, "pageSize": 3, "totalCount": 9, "totalPages": 3}
    assert [r["car_id"] for r in body["data"]] == ["c15", "c9", "c6"]
    assert json.loads(as_json(body)) == body
    index = SearchIndex.build(with_derived(cars), f"file://{tmp_path}", folders=3)
    assert rows_answer(with_derived(cars), "search=bmw+m1", index) == rows_answer(cars, "search=bmw+m1")
    assert rows_answer(cars, "page=999")[1]["data"] == []
    for bad in ("page=0", "pageSize=101", "sortOrder=up", "yearMin=soon"):
        status, body = rows_answer(cars, bad)
        assert status == 400 and body["error"] == "Invalid query parameters"


def test_meta_and_percentiles(spark):
    meta = meta_answer(facets.counted(with_derived(_cars(spark))))
    assert meta["total"] == 29 and meta["years"] == {"min": 1990, "max": 1994}
    assert meta["facets"]["manufacturer"] == [{"value": "BMW", "count": 20}, {"value": "Audi", "count": 9}]
    assert [c["value"] for c in meta["thresholds"]["power"]][:2] == ["> 100 hp", "> 200 hp"] and meta["sources"] == [{"value": "a", "count": 29}, {"value": "b", "count": 15}]
    assert meta_answer(facets.counted(_cars(spark).limit(0)))["total"] == 0
    got = percentiles_answer(_cars(spark))
    assert got == {"power_hp": {"p10": 300.0, "p90": 2600.0, "lowerIsBetter": False}}


def test_report_rows(spark):
    rows = {(r["section"], r["name"]): r for r in quality_report.report_table(_cars(spark), top=5).collect()}
    assert rows["total", "records"]["count"] == 30 and rows["fields", "country"]["count"] == 15
    assert rows["fields", "country"]["bar"] == quality_report.bar(0.5) and rows["years", "last"]["bar"] is None
    assert rows["manufacturers", "BMW"]["count"] == 20 and ("countries", "DE") in rows
    assert {r["section"] for r in quality_report.report_table(_cars(spark).limit(0)).collect()} == {"total", "years"}


def test_definitions(spark):
    got = {r["name"]: tuple(r)[1:] for r in column_definitions(_cars(spark).withColumnRenamed("power_hp", "0_60_mph_sec")).collect()}
    assert got["car_id"] == ("car_id: string;", 30, 0) and got["country"] == ("country: string | null;", 15, 0)
    assert got["0_60_mph_sec"][0] == '"0_60_mph_sec": number | null;' and got["0_60_mph_sec"][2] > 0
    assert column_definitions(spark.range(3)).count() == 0
