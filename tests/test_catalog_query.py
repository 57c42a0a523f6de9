from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marque.functions.columns import name
from marque.operators import catalog_query as cq
from marque.operators import facets, percentiles
from marque.operators.store import DERIVED, with_derived, write_catalog
from marque.schema import COLUMNS, FIELDS, NUMERIC, VISIBLE, catalog_type, columns_by_category, conform, schema_df


def cars(spark, rows):
    base = {"manufacturer": "M", "model": "x", "year": "2020"}
    full = [{**base, "car_id": f"{i:03d}", **r} for i, r in enumerate(rows)]
    cols = sorted({k for r in full for k in r})
    df = spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in cols) for r in full], ", ".join(f"`{c}` string" for c in cols))
    return with_derived(conform(df))


def ids(df):
    return [r.car_id for r in df.collect()]


def run(spark, rows, **params):
    return ids(cq.page(cars(spark, rows), cq.CatalogQuery(**params)))


def test_schema():
    assert (len(FIELDS), len(NUMERIC), len(VISIBLE)) == (37, 18, 18) and len(catalog_type()) == 37
    assert catalog_type()["power_hp"].metadata["max"] == 3000 and sum(map(len, columns_by_category().values())) == 37


def test_schema_rows(spark):
    assert [r.name for r in schema_df(spark).orderBy("position").collect()] == list(COLUMNS)


def test_base_filter_drops_rows_without_name_or_year(spark):
    assert run(spark, [{}, {"year": ""}, {"model": None}, {"manufacturer": ""}]) == ["000"]


def test_equality_is_case_sensitive(spark):
    assert run(spark, [{"body_style": "Coupe"}, {"body_style": "coupe"}], bodyStyle="Coupe") == ["000"]


@pytest.mark.parametrize("param,column,keep", [("powerMin", "power_hp", ["001", "002"]), ("weightMax", "curb_weight_lb", ["000", "001"])])
def test_bounds_are_inclusive_and_zero_means_none_q01(spark, param, column, keep):
    rows = [{column: 99}, {column: 100}, {column: 101}, {column: None}]
    assert run(spark, rows, **{param: 100}) == keep
    assert len(run(spark, rows, **{param: 0})) == 4


def test_page_size_q02():
    assert cq.CatalogQuery(pageSize=500).size == 100
    with pytest.raises(ValueError):
        cq.CatalogQuery.parse({"pageSize": "500"})
    for bad in ({"page": "0"}, {"sortOrder": "up"}, {"powerMin": "x"}, {"yearMin": "1.5"}):
        with pytest.raises(ValueError):
            cq.CatalogQuery.parse(bad)
    assert cq.CatalogQuery.parse({"page": "2", "powerMin": "3.5", "country": ""}) == cq.CatalogQuery(page=2, powerMin=3.5)


def test_unknown_sort_falls_back_q03(spark):
    assert run(spark, [{"model": "b"}, {"model": "a"}], sortBy="nope") == ["001", "000"]


def test_thresholds_and_filters_differ_at_the_bound_q04(spark):
    df = cars(spark, [{"power_hp": 200, "torque": "200 lb-ft", "curb_weight_lb": 2000}])
    n = {(r.metric, r.value): r["count"] for r in facets.threshold_counts(df).collect()}
    assert n["power", 200] == 0 and n["torque", 200] == 1 and n["power_to_weight", 10] == 1 and n["weight", 2000] == 0
    assert len(n) == 51 and ids(cq.page(df, cq.CatalogQuery(powerMin=200))) == ["000"]


def test_torque_two_ways_q05(spark):
    r = {x.car_id: (x.torque_prefix, x.torque_lbft) for x in cars(spark, [{"torque": "350"}, {"torque": "350 lb-ft"}, {"torque": "abc d"}, {}]).collect()}
    assert r == {"000": (0.0, 350.0), "001": (350.0, 350.0), "002": (0.0, 0.0), "003": (None, None)}


def test_percentiles_by_offset_q06(spark):
    df = cars(spark, [{"power_hp": 100 + i, "torque": f"{i} lb-ft", "skidpad_g": 1 if i < 9 else None} for i in range(25)])
    p = {r.column: (r.n, r.p10, r.p90) for r in percentiles.percentiles(df).collect()}
    assert p["power_hp"] == (25, 102, 122) and p["torque"] == (25, 2, 22) and p["skidpad_g"] == (9, None, None)
    s = percentiles.with_status(df, percentiles.percentiles(df), "power_hp").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in s} == {"top10": 3, "bottom10": 3, None: 19}
    with pytest.raises(ValueError):
        percentiles.with_status(df, df, "country")


def test_ratio_is_guarded_q07_q08(spark):
    rows = [{"power_hp": 0, "curb_weight_lb": 2000}, {"power_hp": 200, "curb_weight_lb": 2000}, {"power_hp": None, "curb_weight_lb": 1}, {"power_hp": 400, "curb_weight_lb": 2000}]
    assert run(spark, rows, sortBy="power_to_weight") == ["003", "001", "000", "002"]
    assert run(spark, rows, powerToWeightMax=5) == ["003"]
    df = cars(spark, rows).select(cq.display_ratio(F.col("curb_weight_lb"), F.col("power_hp")).alias("r"))
    assert [r.r for r in df.collect()] == [None, 10.0, None, 5.0]


def test_doors_sort_as_numbers_q09(spark):
    assert run(spark, [{"doors": 10}, {"doors": 2}, {}], sortBy="doors", sortOrder="desc") == ["000", "001", "002"]


def test_years_cast_leniently_q10(spark):
    assert [r.year_int for r in cars(spark, [{"year": "12abc"}, {"year": "abc"}, {"year": "1999"}]).orderBy("car_id").collect()] == [12, 0, 1999]
    assert run(spark, [{"year": "1999"}, {"year": "2001"}], yearMin=2000, yearMax=2001) == ["001"]


def test_source_is_an_exact_element_q11(spark):
    assert run(spark, [{"sources": "A, B"}, {"sources": "a"}, {"sources": "AB"}, {"sources": "%"}], source="A") == ["000"]


def test_search_q12(spark):
    rows = [{"manufacturer": "Citroën", "model": "GT-R Spider"}, {"manufacturer": "Nissan", "model": "GTR"}]
    for text, want in (("citroen gt sp", ["000"]), ("gt-r", ["000"]), ("spi citroen", []), ("gt", ["000", "001"]), ("-", []), ("nissan OR x", [])):
        assert run(spark, rows, search=text) == want, text


def test_nulls_last_both_ways_and_ties_by_id(spark):
    rows = [{"power_hp": None}, {"power_hp": 2}, {"power_hp": 1}, {"power_hp": 2}]
    assert run(spark, rows, sortBy="power_hp") == ["002", "001", "003", "000"]
    assert run(spark, rows, sortBy="power_hp", sortOrder="desc") == ["001", "003", "002", "000"]


def test_pages_and_counts(spark):
    df = cars(spark, [{"model": f"m{i:02d}"} for i in range(7)])
    rows, p = cq.run(df, cq.CatalogQuery(page=2, pageSize=3))
    assert ids(rows) == ["003", "004", "005"] and p == {"page": 2, "pageSize": 3, "total": 7, "totalPages": 3} and rows.columns == list(COLUMNS)
    assert cq.pagination(df, cq.CatalogQuery(pageSize=3)).first().total_pages == 3


def test_facets_and_summary(spark):
    df = cars(spark, [{"country": "DE", "sources": "A, B"}, {"country": "", "sources": "B"}, {"country": "DE", "year": ""}])
    assert [(r.value, r["count"]) for r in facets.facet_counts(df, ("country",)).collect()] == [("DE", 1)]
    assert {r.value: r["count"] for r in facets.source_counts(df).collect()} == {"A": 1, "B": 2}
    assert tuple(facets.year_range(df).first()) == (2, 2020, 2020)
    empty = facets.year_range(df.where("false")).first()
    assert empty.total == 0 and empty.year_min == 1900 and empty.year_max > 2000
    assert set(facets.meta(df)) == {"facets", "sources", "thresholds", "summary"}


def test_plans_scan_once(spark, tmp_path):
    path = str(tmp_path / "cars")
    write_catalog(cars(spark, [{"power_hp": i + 60} for i in range(30)]), path)
    df = spark.read.parquet(path)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert plan(facets.threshold_counts(df)).count("FileScan") == 1 and plan(facets.facet_counts(df)).count("FileScan") == 1
    from marque.operators.percentiles import percentiles as _p

    page = plan(cq.page(df.select("car_id", "manufacturer", "model", "year", "power_hp", *[c for c in df.columns if c in DERIVED]), cq.CatalogQuery(powerMin=70)))
    assert plan(_p(df)).count("FileScan") <= 2
    assert "TakeOrderedAndProject" in page and "power_hp" in page.split("PushedFilters")[1].split("ReadSchema")[0]
    narrow = plan(facets.facet_counts(df, ("country",))).split("ReadSchema")[1]
    assert "country" in narrow and "power_hp" not in narrow
    assert df.select(name("0_60_mph_sec")).count() == 30
