from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marque.functions import classify, text, units
from marque.functions.exact import python_round, repair_mojibake, unescape_html
from marque.operators.makers import country_name, country_of, normalize, parse_name, split_make
from tests.samples import MAKERS


def apply(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_parse_time(spark):
    assert apply(spark, ["6:45.123", "6:45", "45.5 sec", "45.5s", "N/A", None, "", "1:02.5[2]"], units.parse_time) == [405.123, 405.0, 45.5, 45.5, None, None, None, 62.5]


def test_parse_speed(spark):
    got = apply(spark, ["200 mph", "320 km/h", "200 mph (321.9 km/h)", "200", "250 kph", None], units.parse_speed)
    assert [tuple(x) for x in got] == [(200.0, 321.9), (198.8, 320.0), (200.0, 321.9), (200.0, 321.9), (155.3, 250.0), (None, None)]


def test_parse_power(spark):
    got = apply(spark, ["373 kW", "507 PS", "1,550 kW (2,079 hp; 2,107 PS)", "500", "500 bhp", ""], units.parse_power)
    assert [tuple(x) for x in got] == [(500.2, 373.0), (500.1, 372.9), (2079.0, 1550.0), (500.0, 372.9), (500.0, 372.9), (None, None)]


def test_parse_float(spark):
    assert apply(spark, ["1,234.56", "1234", "N/A", "n/a", "-", "—", "", None, "450 hp", "about 3.5 x", "-2.5"], units.parse_float) == [1234.56, 1234.0, None, None, None, None, None, None, 450.0, 3.5, -2.5]


def test_other_numbers(spark):
    assert apply(spark, ["350 lb-ft", "1,5", None, "abc"], units.lenient_float) == [350.0, 15.0, None, None]
    assert apply(spark, ["  12.5abc", "x1", None], units.leading_number) == [12.5, None, None]
    assert apply(spark, [405.3, 45.2, None, 60.0], units.lap_time, "double") == ["6:45.30", "45.20", None, "1:00.00"]
    assert apply(spark, ["400 lb-ft @ 3000 rpm", "x"], units.spec_torque) == ["400 lb-ft", None]
    assert apply(spark, [268.0, 0.0], units.litres_from_in3, "double") == [4.4, None] and apply(spark, [4395.0], units.litres_from_cm3, "double") == [4.4]
    assert apply(spark, [1234.5, None], lambda c: units.shown(c, 1, "hp"), "double") == ["1,234.5 hp", "—"]
    assert apply(spark, [2.675, 1.005, 1.45], lambda c: python_round(c, 2), "double") == [2.67, 1.0, 1.45]


def test_clean_text_and_year(spark):
    assert apply(spark, ["A [1] b  c", "x (needs citation here)", "N/A", "est. 5 claimed", None], text.clean_text) == ["A b c", "x", "", ". 5", ""]
    assert apply(spark, ["built 2019-2021", "1899", "in 20201", None], text.year_of) == ["2019", None, None, None]


def test_exact_functions(spark):
    assert apply(spark, ["a &#8211; b &amp; c", "plain", None], unescape_html) == ["a – b & c", "plain", None]
    assert apply(spark, ["HuracÃ¡n", "Huracán", "Â", None], repair_mojibake) == ["Huracán", "Huracán", "Â", None]


def test_model_names(spark):
    assert apply(spark, ["Camaro ZL1 Test", "Camaro ZL1", "M5 (2018) First Drive Review", "C63 (W205)", "X Page 2", "S Long-Term Road Test Wrap-Up", "Road Test Review Of It;"], text.model_key) == ["camaro zl1", "camaro zl1", "m5", "c63", "x", "s", "road"]
    assert apply(spark, ["C63 (W205)"], lambda c: text.model_key(c, True)) == ["c63 (w205)"]
    assert apply(spark, ["Huracan LP610 4 Test", "675Lt", "Gt R Nismo Tested", "911 Gts", "Odyssey Tested With Nine Speed", "First Drive", "M5 Full T |", "Rs7 –"], text.parsed_model) == ["Huracan LP610-4", "675LT", "GT-R NISMO", "911 GTS", "Odyssey", "", "M5", "RS7"]
    assert apply(spark, ["Camry Page 3", "Civic Review Still Good", "Accord;", None], text.stored_model) == ["Camry", "Civic", "Accord", ""]


def test_title_case_and_prefix(spark):
    assert apply(spark, ["mercedes-benz", "o'neil 3d"], text.title_case) == ["Mercedes-Benz", "O'Neil 3D"]
    df = spark.createDataFrame([("Audi A6", "Audi"), ("audi  A6", "Audi"), ("Audiovox", "Audi"), ("A6", ""), (" Audi A6 ", "Audi"), (None, "Audi")], "m string, p string")
    assert [r.o for r in df.select(text.without_prefix(F.col("m"), F.col("p")).alias("o")).collect()] == ["A6", "A6", "Audiovox", "A6", "A6", None]


def test_car_id(spark):
    import hashlib

    df = spark.createDataFrame([("2020", "BMW", "M5 (F90)"), (None, "", "é")], "y string, m string, n string")
    got = [r.o for r in df.select(text.car_id(F.col("y"), F.col("m"), F.col("n")).alias("o")).collect()]
    assert got == [hashlib.sha256(b"2020bmwm5f90").hexdigest()[:16], hashlib.sha256(b"").hexdigest()[:16]]


@pytest.mark.parametrize("engine,want", [("electric", "Electric"), ("hybrid V6 turbo", "Electric/Petrol"), ("electric motor and engine", "Electric/Petrol"), ("turbo diesel", "Diesel"), ("V8", "Petrol"), ("", ""), ("plug-in tdi", "Electric/Diesel"), ("2.0 l", "Petrol")])
def test_propulsion(spark, engine, want):
    assert apply(spark, [engine], classify.propulsion) == [want]


def test_categories(spark):
    assert apply(spark, ["twin-turbocharged DOHC V-8", "flat-6", "rotary", None, ""], lambda c: classify.engine_config(c, F.lit("ICE"))) == ["V8", "H6", "Rotary", None, None]
    assert apply(spark, ["turbo V6", "supercharged V-8", "V-8", "thing", None], lambda c: classify.aspiration(c, F.lit("ICE"))) == ["TC", "SC", "NA", None, None]
    assert apply(spark, ["Premium Gasoline", "Electricity", "Diesel", None], classify.fuel_propulsion) == ["Petrol", "Electric", "Diesel", ""]


def test_makers(spark):
    assert apply(spark, ["bmw", " Lucid  Motors ", "Unknown", "unknown co", "MG", None], lambda c: normalize(c, MAKERS)) == ["BMW", "Lucid", "Unknown", "Unknown Co", "MG", ""]
    assert apply(spark, ["Bmw", "nope"], lambda c: country_of(c, MAKERS)) == ["DE", ""] and apply(spark, ["DE", "XX"], lambda c: country_name(c, MAKERS)) == ["Germany", None]
    names = ["Porsche 911", "Mercedes-AMG GT", "80 Napier", "80 Napier Special", "Alfa Romeo Giulia", "Lucid Motors Air", "MGB", "123 foo", "Foo bar", "bmw", "", None]
    want = [("Porsche", "911"), ("Mercedes-AMG", "GT"), ("Napier", "80"), ("Napier", "80 Special"), ("Alfa Romeo", "Giulia"), ("Lucid", "Air"), ("MG", "B"), ("", "123 foo"), ("Foo", "bar"), ("BMW", ""), ("", ""), ("", "")]
    assert [tuple(x) for x in apply(spark, names, lambda c: parse_name(c, MAKERS))] == want
    makes = ["Porsche", "Porsche 911", "mercedes amg", "Alfa Romeo 4C", "Zed X", ""]
    assert [tuple(x) for x in apply(spark, makes, lambda c: split_make(c, MAKERS))] == [("Porsche", ""), ("Porsche", "911"), ("Mercedes-AMG", ""), ("Alfa Romeo", "4C"), ("Zed X", ""), ("", "")]
