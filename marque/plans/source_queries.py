"""Queries that run the source parsers on invented raw rows, a case for each row of part, and readers and sinks on files made of tables.

As in ``case_queries`` the SQL states what must come out. A parser's source_row carries p_partkey.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marque.functions.columns import name
from marque.plans.case_queries import MAKERS, raw, wanted
from marque.plans.driver_queries import QUERIES, SQL
from marque.session import cut, delete, scratch
from marque.sources import changes, html_source, parsers, readers, sinks
from marque.sources.registry import SourceSpec, sources_df, stage




def parser_query(label: str, parser: str, raws: dict[str, list], outcomes: dict[str, tuple[str, list]]) -> None:
    """All rows with the reason of a reject; the values of usable ones."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = raw(spark, sf_dir, raws).withColumnRenamed("p_partkey", "source_row").drop("p_size")
        out = parsers.get_parser(parser)(d, MAKERS)
        return out.select(F.col("source_row").alias("p_partkey"), "reject", *[F.when(F.col("reject").isNull(), name(c)).alias(c) for c in outcomes if c != "reject"])

    QUERIES[label] = run
    SQL[label] = wanted(outcomes)


def columns(names: str, rows: list[tuple]) -> dict[str, list]:
    return {n: list(c) for n, c in zip(names.split("|"), zip(*rows, strict=True), strict=True)}


def typed(types: dict[str, str], names: str, rows: list[tuple]) -> dict[str, tuple[str, list]]:
    return {n: (types.get(n, "varchar"), c) for n, c in columns(names, rows).items()}


_DOUBLE = dict.fromkeys((
    "lightning_lap_sec", "nurburgring_lap_sec", "top_gear_lap_sec", "0_60_mph_sec", "0_100_kmh_sec", "0_100_mph_sec", "top_speed_mph", "top_speed_kmh", "power_hp", "power_kw", "engine_displacement", "curb_weight_lb",
    "quarter_mile_sec", "skidpad_g",
), "double")

parser_query("ap2_lightning_lap", "lightning_lap", columns("Year Make Model| Lap Time", [
    ("{y} Porsche 9{z}", "2:{s}.5"), ("Porsche 911", "2:30"), ("{y} BMW M{z}", "x"), ("", "2:30.0"), ("{y} Tesla", "2:40.25"), ("{y} Alfa Romeo 4C", "3:{s}.0"),
]), typed(_DOUBLE, "reject|manufacturer|model|year|country|sources|lightning_lap_sec", [
    (None, "Porsche", "9{z}", "{y}", "DE", "Car & Driver", "120 + {z} + 0.5"), ("no year and name", *[None] * 6), ("no lap time", *[None] * 6), ("blank", *[None] * 6), (None, "Tesla", "Tesla", "{y}", "US", "Car & Driver", "160.25"),
    (None, "Alfa Romeo", "4C", "{y}", "IT", "Car & Driver", "180 + {z}"),
]))

_OUT = "lap time out of range"
parser_query("ap3_b17_nurburgring", "nurburgring", columns("Vehicle|Time|Driver|Date", [
    ("Porsche 9{z} GT", "7:{s}.25", "X Y [2]", "4 Sep {y}"), ("Porsche 911 GT3 Race Car", "7:00", "", ""), ("Ford F", "4:59", "", ""), ("Ford F", "5:00", "", ""), ("Ford G", "15:01", "", ""), ("Ford H {y}", "8:00", "", ""), ("", "7:00", "", ""), ("BMW M{z}", "DNF", "", ""), ("Ford DTM {z}", "8:00", "", ""),
    ("{z} thing", "8:00", "", ""), ("Ford G", "15:00", "", ""),
]), typed(_DOUBLE, "reject|manufacturer|model|year|nurburgring_lap_sec|nurburgring_driver|nurburgring_date", [
    (None, "Porsche", "9{z} GT", "{y}", "420 + {z} + 0.25", "X Y", "4 Sep {y}"), ("racing car", *[None] * 6), (_OUT, *[None] * 6), (None, "Ford", "F", None, "300", None, None), (_OUT, *[None] * 6), (None, "Ford", "H {y}", "{y}", "480", None, None), ("blank", *[None] * 6), ("no lap time", *[None] * 6), ("racing car", *[None] * 6),
    ("unknown manufacturer", *[None] * 6), (None, "Ford", "G", None, "900", None, None),
]))

parser_query("ap4_top_gear", "top_gear", columns("Car|Time|Episode", [("Porsche Carrera {z}[1]", "1:{s}.8", "S{z}"), ("Ford A", "0:59.0", "S1"), ("Ford B", "3:01", "S1"), ("Ford C {y}", "3:00", ""), ("Ford D", "1:00.0", "S2")]), typed(_DOUBLE, "reject|manufacturer|model|year|top_gear_lap_sec|top_gear_episode", [
    (None, "Porsche", "Carrera {z}", None, "60 + {z} + cast(0.8 AS double)", "S{z}"), (_OUT, *[None] * 5), (_OUT, *[None] * 5), (None, "Ford", "C {y}", "{y}", "180", None), (None, "Ford", "D", None, "60", "S2"),
]))

parser_query("ap5_acceleration", "acceleration", columns("Car|0-60 mph|Model year|Powertrain", [("Tesla Model S", "2.{s}", "{y}", "Battery electric"), ("Ford A", "0.9", "2000", ""), ("Ford B", "30.1", "2000", ""), ("Ford C", "30.0", "x", "V8"), ("Ford D", "N/A", "", ""), ("Ford E TDI turbo", "1.0 s", "MY{y} {y}", "")]), typed(_DOUBLE, "reject|manufacturer|model|year|propulsion|0_60_mph_sec", [
    (None, "Tesla", "Model S", "{y}", "Electric", "2 + cast({z} AS double) / 100"), ("time out of range", *[None] * 5), ("time out of range", *[None] * 5), (None, "Ford", "C", None, "Petrol", "30"), ("no time", *[None] * 5), (None, "Ford", "E TDI turbo", "{y}", "Diesel", "1"),
]))

parser_query("ap6_speed_records", "speed_records", columns("Make and model|Top speed|Year|Engine", [("Porsche A", "3{s} km/h", "{y}", "flat-6 inline"), ("Ford B", "2{s} mph", "", "V8"), ("Ford C", "205 mph (330 km/h)", "2003", ""), ("Ford D", "49 mph", "", ""), ("Ford E", "351 mph", "", ""), ("Ford F", "", "", "")]), typed(_DOUBLE, "reject|manufacturer|model|year|propulsion|top_speed_mph|top_speed_kmh", [
    (None, "Porsche", "A", "{y}", "Petrol", "round((300 + {z}) * 0.621371::double, 1)", "300 + {z}"), (None, "Ford", "B", None, "Petrol", "200 + {z}", "round((200 + {z}) * 1.60934::double, 1)"), (None, "Ford", "C", "2003", None, "205", "330"), ("speed out of range", *[None] * 6), ("speed out of range", *[None] * 6), ("no speed", *[None] * 6),
]))


def ap7_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of several vehicles become a row each; variants of one model don't."""
    cells = columns("Vehicle|Power|Year|Type", [("Bmw A{z}/Bmw B{z}", "1,0{s} hp", "2020/{y}", "Battery electric"), ("Porsche 911 GT3/GT3 RS", "5{s} kW", "2019", "Internal combustion"), ("Ford Z", "3001 hp", "2001", "ICE"), ("Bmw A/Alfa Romeo 4C/Bmw C{z}", "300 PS", "{y}", "Plug-in hybrid")])
    d = raw(spark, sf_dir, cells).withColumnRenamed("p_partkey", "source_row").drop("p_size")
    out = parsers.power_output(d, MAKERS).where("reject is null")
    return out.select(F.col("source_row").alias("p_partkey"), "manufacturer", "model", "year", "propulsion", "power_hp", "power_kw")


QUERIES["ap7_expansion"] = ap7_expansion
SQL["ap7_expansion"] = """
WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, cast(p_size AS varchar) AS z, cast(1970 + p_size AS varchar) AS y, cast(1000 + p_size AS double) AS hp, cast(500 + p_size AS double) AS kw FROM part)
SELECT p_partkey, 'BMW' AS manufacturer, v || z AS model, CASE v WHEN 'A' THEN '2020' ELSE y END AS year, 'Electric' AS propulsion, hp AS power_hp, round(hp * 0.7457::double, 1) AS power_kw FROM p, (VALUES ('A'), ('B')) t(v) WHERE k = 0
UNION ALL SELECT p_partkey, 'Porsche', '911 GT3/GT3 RS', '2019', 'ICE', round(kw * 1.341::double, 1), kw FROM p WHERE k = 1
UNION ALL SELECT p_partkey, m, replace(v, 'z', z), y, 'Plug-in Hybrid', round(300 * 0.9863::double, 1), round(round(300 * 0.9863::double, 1) * 0.7457::double, 1) FROM p, (VALUES ('BMW', 'A'), ('Alfa Romeo', '4C'), ('BMW', 'Cz')) t(m, v) WHERE k = 3
"""

parser_query("ap8_epa", "epa_vehicles", columns("make|model|year|cylinders|displ|drive|VClass|tCharger|sCharger|fuelType1", [
    ("Bmw", "M{z}", "{y}", "8", "4.4", "All-Wheel Drive", "Midsize Cars", "T", "", "Premium Gasoline"), ("Ford", "F{z}", "{y}", "7", "0", "Part-time 4-Wheel Drive", "Unknown", "", "S", "Diesel"), ("Tesla", "S", "{y}", "", "", "2-Wheel Drive", "Two Seaters", "", "", "Electricity"), ("", "X", "2000", "4", "2.0", "", "", "", "", ""),
    ("Ford", "Q", "{y}", "", "", "", "", "", "", "Diesel"), ("Ford", "W &amp; V", "x", "6", "3.46", "4-Wheel or All-Wheel Drive", "Vans, Cargo Type", "", "", "Regular Gasoline"),
]), typed(_DOUBLE, "reject|manufacturer|model|year|propulsion|body_style|engine_type|engine_displacement|engine_aspiration|drivetrain|sources", [
    (None, "BMW", "M{z}", "{y}", "Petrol", "Sedan", "V8", "cast(4.4 AS double)", "TC", "AWD", "EPA"), (None, "Ford", "F{z}", "{y}", "Diesel", None, None, None, "SC", "4WD", "EPA"), (None, "Tesla", "S", "{y}", "Electric", "Coupe", None, None, None, "RWD", "EPA"), ("blank", *[None] * 10),
    ("no specifications", *[None] * 10), (None, "Ford", "W & V", None, "Petrol", "Van", "V6", "3.5", None, "AWD", "EPA"),
]))

parser_query("ap9_kaggle", "kaggle", columns("Make|Modle|Year_from|Trim|Body_type|cylinder_layout|number_of_cylinders|boost_type|engine_placement|drive_wheels|capacity_cm3|engine_type|acceleration_0_100_km/h_s|max_speed_km_per_h|engine_hp|max_power_kw|maximum_torque_n_m|curb_weight_kg", [
    ("BMW", "M{z}", "{y}", "M{z}", "Sedan", "V-type", "8", "Biturbo", "front, longitudinal", "Rear wheel drive", "4395", "Gasoline", "4.0", "2{s}", "6{s}", "400", "7{s}", "1900"), ("Ford", "F", "{y}", "Sport {z}", "Pickup", "Rotary-piston", "2", "compressor", "central", "full", "", "Diesel", "", "", "", "3{s}", "", ""),
    ("Ford", "", "2000", "", "Sedan", "", "", "", "", "", "", "", "", "", "", "", "", ""), ("Tesla", "S", "", "", "", "", "", "none", "rear", "", "0", "Electric", "", "2{s}", "3{s}", "", "", ""), ("MG", "B", "1970", "", "boat", "", "", "", "", "", "", "Gasoline", "", "", "", "", "", ""),
]), typed(_DOUBLE, "reject|manufacturer|model|year|propulsion|body_style|engine_type|engine_displacement|engine_aspiration|engine_placement|drivetrain|0_100_kmh_sec|0_60_mph_sec|top_speed_kmh|top_speed_mph|power_hp|power_kw|torque|curb_weight_lb", [
    (None, "BMW", "M{z}", "{y}", "Petrol", "Sedan", "V8", "cast(4.4 AS double)", "TC", "Front", "RWD", "4", "cast(3.86 AS double)", "200 + {z}", "round((200 + {z}) * 0.621371::double, 1)", "600 + {z}", None, "TORQUE", "round(1900 * 2.20462::double, 0)"),
    (None, "Ford", "F Sport {z}", "{y}", "Diesel", "Truck", "Rotary", None, "SC", "Mid", "AWD", None, None, None, None, "round((300 + {z}) / 0.7457::double, 1)", "300 + {z}", None, None), ("blank", *[None] * 18),
    (None, "Tesla", "S", None, "Electric", None, None, None, "NA", "Rear", None, None, None, "200 + {z}", "round((200 + {z}) * 0.621371::double, 1)", "300 + {z}", "round((300 + {z}) * 0.7457::double, 1)", None, None), ("no specifications", *[None] * 18),
]))
SQL["ap9_kaggle"] = SQL["ap9_kaggle"].replace("'TORQUE'", "concat(cast(cast(round((700 + p_size) * 0.737562::double, 0) AS int) AS varchar), ' lb-ft')")

parser_query("ap1_review_specs", "review_specs", columns("hrst_make|hrst_model|hrst_submodel|hrst_year|hrst_body_style|hrst_fuel_type|make|model|year|engine_type|vehicle_type|displacement|zero_to_60_mph|zero_to_100_mph|quarter_mile_time|top_speed|skidpad_g|power_hp|torque_lb_ft|curb_weight", [
    ("Bmw", "M5", "BMW M5 {z} Test", "{y}", "sedan", "gas", "x", "y", "1999", "twin-turbocharged V-8", "front-engine, all-wheel-drive", "268 cu in", "3.{s} sec", "8.0", "11.5", "1{s} mph", "0.95 g", "6{s} hp", "553 lb-ft", "4,3{s} lb"),
    ("", "", "", "", "", "", "Porsche 9{z}", "Turbo", "{y}", "flat-6", "rear-engine, rear-wheel-drive coupe", "", "", "", "12.5", "", "", "", "", ""), ("Alfa Romeo", "", "Romeo 4C {z}", "x{y}", "", "", "", "", "", "", "", "", "4.5", "", "", "", "", "", "", ""),
    ("Ford", "F{z}", "", "2001", "", "", "", "", "", "", "", "", "", "", "", "", "", "400", "", ""), ("", "", "", "", "", "", "", "Z", "", "", "", "", "4", "", "", "", "", "", "", ""), ("Ford", "", "", "2001", "", "", "", "", "", "", "", "", "4", "", "", "", "", "", "", ""),
    ("Ford", "Escape Plug-In", "", "2020", "suv", "hybrid", "", "", "", "inline-4", "", "152", "7.5", "", "", "", "", "", "", ""),
]), typed(_DOUBLE, "reject|manufacturer|model|year|propulsion|body_style|engine_type|engine_displacement|engine_aspiration|engine_placement|drivetrain|0_60_mph_sec|0_100_mph_sec|quarter_mile_sec|top_speed_mph|skidpad_g|power_hp|power_kw|torque|curb_weight_lb", [
    (None, "BMW", "M5 {z}", "{y}", "ICE", "Sedan", "V8", "cast(4.4 AS double)", "TC", "Front", "AWD", "3 + cast({z} AS double) / 100", "8", "11.5", "100 + {z}", "cast(0.95 AS double)", "600 + {z}", "round((600 + {z}) * 0.7457::double, 1)", "553 lb-ft", "4300 + {z}"),
    (None, "Porsche", "9{z} Turbo", "{y}", "Petrol", "Coupe", "H6", None, "NA", "Rear", "RWD", None, None, "12.5", None, None, None, None, None, None), (None, "Alfa Romeo", "4C {z}", None, None, None, None, None, None, None, None, "4.5", *[None] * 8),
    ("no measurements", *[None] * 19), ("no manufacturer", *[None] * 19), ("no model", *[None] * 19), (None, "Ford", "Escape Plug-In", "2020", "Plug-in Hybrid", "SUV", "I4", "2.5", "NA", None, None, "7.5", *[None] * 8),
]))


def ap10_autoevolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in cells (A8), engines joined to automobiles (C1), and the parser over both."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    z, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    power = F.concat(F.lit('{"Engine Specs": {"Cylinders:": "V8", "Power:": "5'), F.lpad(z, 2, "0"), F.lit(' hp", "Fuel:": "Gasoline", "Torque:": "400 lb-ft"}, "Weight Specs": {"Unladen Weight:": "3'), F.lpad(z, 2, "0"), F.lit(' lbs"}}'))
    drive = F.concat(F.lit('{"Transmission Specs": {"Drive Type:": "All Wheel Drive"}, "Performance Specs": {"Top Speed:": "1'), F.lpad(z, 2, "0"), F.lit(' mph"}, "Engine Specs": {"Cylinders:": "FLAT 6", "Displacement:": "2995 cm3", "Fuel System:": "Turbocharged"}}'))
    engines = part.select(F.when(k == 3, "none").otherwise(F.concat(F.lit("a"), z)).alias("automobile_id"), F.when(k == 0, power).when(k == 1, drive).when(k == 2, "not json").otherwise("{}").alias("specs"), F.lit("e").alias("name"), F.col("p_partkey").alias("source_row"))
    autos = spark.range(1, 51).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("id"), F.concat(F.when(F.col("id") % 2 == 0, "ALFA ROMEO  Giulia ").otherwise("PORSCHE Cayenne "), F.col("id").cast("string"), F.lit(" 2016-2020 Photos, engines &amp; full specs")).alias("image"), F.concat(F.lit("http://x/"), F.col("id").cast("string")).alias("name"))
    out = parsers.autoevolution(parsers.autoevolution_rows(engines, autos), MAKERS)
    return out.select(F.col("source_row").alias("p_partkey"), "manufacturer", "model", "year", "propulsion", "engine_type", "engine_displacement", "engine_aspiration", "drivetrain", "top_speed_mph", "power_hp", "torque", "curb_weight_lb", F.col("source_url").alias("url"), "reject")


QUERIES["a08_c01_ap10_autoevolution"] = ap10_autoevolution
SQL["a08_c01_ap10_autoevolution"] = """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'ALFA ROMEO' ELSE 'Porsche' END AS manufacturer, concat(CASE WHEN p_size % 2 = 0 THEN 'Giulia ' ELSE 'Cayenne ' END, p_size) AS model, '2016' AS year, CASE k WHEN 0 THEN 'Petrol' END AS propulsion, CASE k WHEN 0 THEN 'V8' ELSE 'H6' END AS engine_type,
  CASE k WHEN 1 THEN 3.0::double END AS engine_displacement, CASE k WHEN 1 THEN 'TC' END AS engine_aspiration, CASE k WHEN 1 THEN 'AWD' END AS drivetrain, CASE k WHEN 1 THEN cast(100 + p_size AS double) END AS top_speed_mph, CASE k WHEN 0 THEN cast(500 + p_size AS double) END AS power_hp,
  CASE k WHEN 0 THEN '400 lb-ft' END AS torque, CASE k WHEN 0 THEN cast(300 + p_size AS double) END AS curb_weight_lb, concat('http://x/', p_size) AS url, cast(NULL AS varchar) AS reject FROM (SELECT *, p_partkey % 4 AS k FROM part) WHERE k < 2
"""


def _folder(spark: SparkSession) -> str:
    """A new folder beside the engine's own tables, which all executors share."""
    from marque.session import table_root

    return f"{table_root(spark)}/files-{uuid.uuid4().hex}"


def _written(spark: SparkSession, sf_dir: str, path: str) -> None:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").repartitionByRange(1, "p_partkey").sortWithinPartitions("p_partkey")
    k = F.col("p_partkey")
    sinks.write_csv(part.select(F.col("p_name").alias("model"), F.when(k % 3 != 0, F.concat(F.col("p_brand"), F.lit(', "x"'))).alias("manufacturer"), (k + 0.126).alias("power_hp"), F.col("p_size").cast("double").alias("power_kw"), k.alias("extra")), path, ("manufacturer", "model", "power_hp", "power_kw", "torque"), single=True)


def a01_a05_a13_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV in the columns asked for, appended to, and read back as strings with the rows' places in their file."""
    path = _folder(spark)
    _written(spark, sf_dir, path)
    return readers.read_csv(spark, path).select("source_row", "manufacturer", "model", "power_hp", "power_kw", "torque", F.col("source_file").startswith("file:").alias("has_file"))


QUERIES["a01_a05_a13_csv"] = a01_a05_a13_csv
SQL["a01_a05_a13_csv"] = """
SELECT cast(row_number() OVER (ORDER BY p_partkey) + 1 AS int) AS source_row, CASE WHEN p_partkey % 3 <> 0 THEN p_brand || ', "x"' ELSE '' END AS manufacturer, p_name AS model, p_partkey || '.13' AS power_hp, cast(p_size AS varchar) AS power_kw, '' AS torque, true AS has_file FROM part
"""


def a14_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended in the columns and the order of what is there, and counted by file."""
    path = _folder(spark)
    _written(spark, sf_dir, path)
    sinks.append_csv(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("model"), F.lit("N").alias("torque")).coalesce(1), path)
    rows = readers.read_csv(spark, path)
    return rows.groupBy("torque").agg(F.count("*").alias("n"), F.min("model").alias("least"), F.count(F.nullif("power_kw", F.lit(""))).alias("filled"))


QUERIES["a14_append"] = a14_append
SQL["a14_append"] = "SELECT '' AS torque, count(*) AS n, min(p_name) AS least, count(p_size) AS filled FROM part UNION ALL SELECT 'N', count(*), min(n_name), 0 FROM nation"


def _car(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(F.when(k % 7 != 0, F.concat(F.lit("c"), k % 500)).alias("car_id"), F.when(k % 5 != 0, F.col("p_brand")).alias("manufacturer"), F.col("p_name").alias("model"), F.when(k % 11 != 0, F.lit("2001")).alias("year"), F.col("p_size").cast("double").alias("skidpad_g"), (F.col("p_size") * 60.0).alias("power_hp"), k.alias("seq"))


def a15_a17_query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query table: rows that meet the constraints, the first of a car_id, with the search tokens; written, checked, counted, opened."""
    from marque.schema import conform

    path = _folder(spark)
    cars = _car(spark.read.parquet(f"{sf_dir}/part.parquet")).withColumn("skidpad_g", F.col("skidpad_g") / 30)
    good, bad = sinks.write_tables(conform(cars, F.col("seq")), path)
    wrong, n, rejected = sinks.check_table(spark, good), sinks.record_count(spark, good), sinks.record_count(spark, bad)
    t = sinks.open_catalog(spark, good)
    return t.select("car_id", "manufacturer", "model", "power_hp", F.array_join("search_tokens", " ").alias("tokens"), F.lit(len(wrong)).alias("wrong"), F.lit(n).cast("long").alias("n"), F.lit(rejected).cast("long").alias("rejected"))


QUERIES["a15_a16_a17_a18_a19_query_table"] = a15_a17_query_table
SQL["a15_a16_a17_a18_a19_query_table"] = """
WITH c AS (SELECT 'c' || (p_partkey % 500) AS car_id, * FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_size * 60 BETWEEN 50 AND 3000 AND cast(p_size AS double) / 30 BETWEEN 0.5 AND 1.5),
  f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY car_id ORDER BY p_partkey) = 1)
SELECT car_id, p_brand AS manufacturer, p_name AS model, cast(p_size * 60 AS double) AS power_hp, lower(concat(car_id, ' ', replace(p_brand, '#', ' '), ' ', p_name)) AS tokens, 0 AS wrong, (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM part) - (SELECT count(*) FROM f) AS rejected FROM f
"""


def a09_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with a table for each region, its nations in rows; tables of another class are passed over.

    Cleaning takes NA for a missing value even within a word, here in NATION.
    """
    path = _folder(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    row = F.concat(F.lit("<tr><td>Ford <i>"), F.col("n_name"), F.lit("</i> &amp; co</td><td>3"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(" hp</td></tr>"))
    table = nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    html = F.concat(F.lit("<h2>Region "), F.col("n_regionkey").cast("string"), F.lit("</h2><table><tr><td>no</td></tr></table><table class='wikitable sortable'><tr><th>Vehicle</th><th>Power (hp)</th></tr>"), "rows", F.lit("</table>"))
    pages = table.select("n_regionkey", html.alias("value")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_regionkey", "value"))), lambda x: x["value"]), "\\n").alias("value"))
    pages.coalesce(1).write.text(path)  # one page: five regions
    rows = readers.read_html_tables(spark, path)
    parsed = parsers.from_tables(rows, "power_output", MAKERS)
    return parsed.select(F.col("source_row").cast("int").alias("row"), "manufacturer", "model", "power_hp")


QUERIES["a09_html_tables"] = a09_html_tables
SQL["a09_html_tables"] = "SELECT cast(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS int) AS row, 'Ford' AS manufacturer, substr(n_name, 3) || ' & co' AS model, cast(300 + n_nationkey AS double) AS power_hp FROM nation"


def _pages(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A page for each hundred parts, with a table of their sizes and one of their types; tables of another class stand between."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("page", F.floor(F.col("p_partkey") / 100))
    row = lambda c: F.concat(F.lit("<tr><td>"), F.col("p_partkey").cast("string"), F.lit("</td><td>"), F.col("p_name"), F.lit(" &amp; <b>"), F.col(c).cast("string"), F.lit("</b></td></tr>"))
    rows = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", row(c).alias("r")))), lambda x: x["r"]), "")
    table = lambda title, c: F.concat(F.lit(f"<h2>{title}</h2><table><tr><td>no</td></tr></table><table class='wikitable'><tr><th>Key</th><th>{title}</th></tr>"), F.col(c), F.lit("</table>"))
    pages = part.groupBy("page").agg(rows("p_size").alias("sizes"), rows("p_type").alias("types"))  # a hundred rows a group
    pages.select("page", F.concat(table("Sizes", "sizes"), table("Types", "types")).alias("value")).write.partitionBy("page").text(path)


def a09_html_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of many pages' tables by the data source, a section at a time: rows of the other never leave the task that parses them."""
    with scratch(spark) as root:
        _pages(spark, sf_dir, root)
        scan = lambda s: html_source.scan_html_tables(spark, root, [s], pattern="*.txt", partitionBytes=1_000_000)
        parts = [scan(s).select("section", "table_idx", "row_idx", F.col("cells")[0].cast("long").alias("p_partkey"), F.col("cells")[1].alias("value"), F.array_join("header", "|").alias("header")) for s in ("Sizes", "Types")]
        return cut(parts[0].unionByName(parts[1]))


QUERIES["a09_html_source"] = a09_html_source
SQL["a09_html_source"] = """
WITH r AS (SELECT *, cast(row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) AS int) AS row_idx FROM part)
SELECT 'Sizes' AS section, 0 AS table_idx, row_idx, p_partkey, p_name || ' & ' || p_size AS value, 'Key|Sizes' AS header FROM r
UNION ALL SELECT 'Types', 1, row_idx, p_partkey, p_name || ' & ' || p_type, 'Key|Types' FROM r
"""


def a02_a03_g01_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a catalog in its order, by name; files by glob without those to skip; rejects with their reasons."""
    root = _folder(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1).orderBy("n_nationkey")
    write = lambda df, p: df.coalesce(1).write.options(header="true").csv(p)
    write(nation.select(F.concat(F.lit("Porsche "), "n_name").alias("Car"), F.concat(F.lit("1:"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(".5")).alias("Time"), F.lit("S1").alias("Episode")), f"{root}/tg")
    write(nation.select(F.concat(F.lit("Ford "), "n_name").alias("Car"), F.concat((F.col("n_nationkey") * 2).cast("string"), F.lit(" s")).alias("Time"), F.lit("2001").alias("Year"), F.lit("").alias("Propulsion")), f"{root}/ac")
    specs = [SourceSpec("tg", "top_gear", f"{root}/tg/*.csv", skip_files=("none.csv",)), SourceSpec("off", "kaggle", f"{root}/off", enabled=False), SourceSpec("ac", "acceleration", f"{root}/ac")]
    s = stage(spark, specs, MAKERS, ["ac", "tg", "off", "what"])
    good = s.rows.select("sources", "manufacturer", "model", "top_gear_lap_sec", name("0_60_mph_sec").alias("sec"), F.lit(None).cast("string").alias("reason"))
    bad = s.rejects.select(F.col("source").alias("sources"), F.lit(None).cast("string").alias("manufacturer"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("double").alias("top_gear_lap_sec"), F.lit(None).cast("double").alias("sec"), "reason")
    listed = sources_df(spark, specs).agg(F.count_if("enabled").alias("enabled"))
    return good.unionByName(bad).crossJoin(F.broadcast(listed)).withColumn("unknown", F.lit(",".join(s.unknown)))  # one row


QUERIES["a02_a03_a26_g01_staged"] = a02_a03_g01_staged
SQL["a02_a03_a26_g01_staged"] = """
SELECT 'Wikipedia' AS sources, 'Porsche' AS manufacturer, substr(n_name, 3) AS model, 60 + n_nationkey + 0.5::double AS top_gear_lap_sec, cast(NULL AS double) AS sec, cast(NULL AS varchar) AS reason, cast(2 AS bigint) AS enabled, 'what' AS unknown FROM nation
UNION ALL SELECT 'Wikipedia', CASE WHEN ok THEN 'Ford' END, CASE WHEN ok THEN substr(n_name, 3) END, NULL, CASE WHEN ok THEN cast(n_nationkey * 2 AS double) END, CASE WHEN NOT ok THEN 'time out of range' END, 2, 'what' FROM (SELECT *, n_nationkey * 2 BETWEEN 1 AND 30 AS ok FROM nation)
"""


def a06_a07_a12_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by a predicate on their path, their hashes, and an existing catalog with its names normalised anew."""
    from marque.plans.catalog_pipeline import load_existing

    root = _folder(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(F.lit("bmw").alias("manufacturer"), F.concat(F.lit("M"), F.col("p_size").cast("string"), F.lit(" Road Test")).alias("model"), F.lit("XX").alias("country"), F.col("p_partkey").cast("double").alias("power_hp"))
    sinks.write_csv(rows, root, single=True)
    n = readers.read_directory(spark, root, lambda p: "part-" in p).count()
    hashes = readers.file_hashes(spark, f"{root}/part-*.csv").agg(F.count("*").alias("files"), F.min(F.length("sha256")).alias("digits"))
    old = load_existing(spark, root, MAKERS)
    return old.groupBy("manufacturer", "model", "country").agg(F.count("*").alias("n"), F.sum("power_hp").alias("hp")).withColumn("read", F.lit(n).cast("long")).crossJoin(F.broadcast(hashes))  # one row


QUERIES["a06_a07_a12_files"] = a06_a07_a12_files
SQL["a06_a07_a12_files"] = "SELECT 'BMW' AS manufacturer, 'M' || p_size AS model, 'DE' AS country, count(*) AS n, cast(sum(p_partkey) AS double) AS hp, (SELECT count(*) FROM part) AS read, cast(1 AS bigint) AS files, 64 AS digits FROM part GROUP BY p_size"


def _files(df: DataFrame, path: str) -> None:
    """df as CSV, a folder and a file for each f."""
    df.repartition("f").write.mode("append").options(header="true").partitionBy("f").csv(path)


def a03_a06_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files staged twice; between, some files are replaced, rewritten in place, given a new time, added and removed. Only the new and the rewritten are parsed again."""
    with scratch(spark) as root:
        src, k = f"{root}/src", F.col("p_partkey")
        part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", (k % 5).alias("f"))
        _files(part, src)
        store, parsed = changes.StagedFiles(spark, f"{root}/kept"), []

        def parse(paths: list[str]) -> DataFrame:
            parsed.append(len(paths))
            return readers.read_csv(spark, [changes.literal_path(p) for p in paths])

        listed = lambda: changes.listed_files(spark, src, "*.csv")
        first = store.refresh(listed(), parse)
        old = {f: next(p for p in first.added if f"/f={f}/" in p) for f in range(5)}
        for f in (1, 2, 4):
            delete(spark, old[f])
        nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("p_partkey"), F.col("n_name").alias("p_name"), F.lit(5).alias("f"))
        _files(part.where("f = 1").withColumn("p_name", F.concat("p_name", F.lit(" new"))).unionByName(nation), src)
        _files(part.where("f = 4").withColumn("p_name", F.upper("p_name")), f"{root}/other")
        at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at(root).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.rename(at(changes.listed_files(spark, f"{root}/other", "*.csv").first()["path"]), at(old[4]))
        fs.setTimes(at(old[3]), fs.getFileStatus(at(old[3])).getModificationTime() + 5000, -1)
        seen = store.refresh(listed(), parse)
        counts = {"added": len(seen.added), "changed": len(seen.changed), "touched": len(seen.touched), "removed": len(seen.removed), "unchanged": seen.unchanged, "parsed": parsed[-1]}
        return cut(store.read().select("p_partkey", "p_name", *[F.lit(n).alias(c) for c, n in counts.items()]))


QUERIES["a03_a06_changed_files"] = a03_a06_changed_files
SQL["a03_a06_changed_files"] = """
SELECT cast(p_partkey AS varchar) AS p_partkey, CASE p_partkey % 5 WHEN 4 THEN upper(p_name) WHEN 1 THEN p_name || ' new' ELSE p_name END AS p_name, 2 AS added, 1 AS changed, 1 AS touched, 2 AS removed, 1 AS unchanged, 3 AS parsed FROM part WHERE p_partkey % 5 <> 2
UNION ALL SELECT cast(n_nationkey AS varchar), n_name, 2, 1, 1, 2, 1, 3 FROM nation
"""


def a11_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of unknown make-up, its columns found by their headers."""
    d = raw(spark, sf_dir, columns("The Car (make)|Model Year|Max. Speed|Power output", [("Porsche 9{z}", "{y}", "2{s} mph", ""), ("{z} x", "", "", ""), ("Ford F", "", "", "{z} hp"), ("Ford G", "", "", "")]))
    out = parsers.generic_rows(d.withColumnRenamed("p_partkey", "source_row").drop("p_size"), MAKERS)
    return out.select(F.col("source_row").alias("p_partkey"), "reject", *[F.when(F.col("reject").isNull(), F.col(c)).alias(c) for c in ("manufacturer", "model", "year", "top_speed_mph", "power_hp")])


QUERIES["a11_generic"] = a11_generic
SQL["a11_generic"] = wanted(typed(_DOUBLE, "reject|manufacturer|model|year|top_speed_mph|power_hp", [(None, "Porsche", "9{z}", "{y}", "200 + {z}", None), ("unknown manufacturer", *[None] * 5), (None, "Ford", "F", None, None, "{z}"), ("no values", *[None] * 5)]))
