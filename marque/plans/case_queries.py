"""Queries that run text operators on invented raw text, a case for each row of part, and what must come out.

A case is picked by p_partkey; {z} in its text is the row's p_size, {s} the same in two digits and
{y} a year made of it. The SQL doesn't parse: it states each case's outcome, so it shares no rule with the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marque.functions import classify, text, units
from marque.functions.exact import repair_mojibake, unescape_html
from marque.operators.makers import Makers, country_name, country_of, normalize, parse_name, split_make
from marque.plans.driver_queries import QUERIES, SQL
from marque.sources import parsers

MAKERS = Makers.of({
    "manufacturers": {"Porsche": {"country": "DE"}, "BMW": {"country": "DE"}, "Alfa Romeo": {"country": "IT"}, "Mercedes-AMG": {"country": "DE"}, "Lucid": {"country": "US"}, "Napier": {"country": "GB"}, "Tesla": {"country": "US"}, "Ford": {"country": "US"}, "MG": {"country": "GB"}},
    "aliases": {"Bmw": "BMW", "Lucid Motors": "Lucid", "Alfa": "Alfa Romeo"},
    "multi_word_manufacturers": ["Alfa Romeo", "Mercedes-AMG"],
    "country_names": {"DE": "Germany", "US": "United States", "IT": "Italy"},
})

Run = Callable[[DataFrame], DataFrame]


def _filled_in(c):
    z = F.col("p_size")
    marks = {"{z}": z.cast("string"), "{s}": F.lpad(z.cast("string"), 2, "0"), "{y}": (1970 + z).cast("string")}
    for mark, v in marks.items():
        c = F.replace(c, F.lit(mark), v)
    return c


def raw(spark: SparkSession, sf_dir: str, columns: dict[str, list[str | None]]) -> DataFrame:
    """All parts, each with the texts of its case."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    pick = lambda vs: F.element_at(F.array(*[F.lit(v).cast("string") for v in vs]), (F.col("p_partkey") % len(vs) + 1).cast("int"))
    return part.select("p_partkey", "p_size", *[_filled_in(pick(vs)).alias(c) for c, vs in columns.items()])


def _sql_value(v, kind: str) -> str:
    if v is None:
        return "NULL"
    if kind != "varchar":
        return f"({v})".replace("{z}", "p_size")
    quoted = "'" + v.replace("'", "''") + "'"
    marks = {"{z}": "cast(p_size AS varchar)", "{s}": "lpad(cast(p_size AS varchar), 2, '0')", "{y}": "cast(1970 + p_size AS varchar)"}
    for mark, x in marks.items():
        if mark in v:
            quoted = f"replace({quoted}, '{mark}', {x})"
    return quoted


def wanted(outcomes: dict[str, tuple[str, list]], where: str = "") -> str:
    """SQL of the outcomes: column -> (type, one outcome a case: text, or an expression in {z} for numbers)."""
    cols = []
    for c, (kind, vs) in outcomes.items():
        cases = " ".join(f"WHEN {i} THEN {_sql_value(v, kind)}" for i, v in enumerate(vs))
        cols.append(f'cast(CASE p_partkey % {len(vs)} {cases} END AS {kind}) AS "{c}"')
    return f"SELECT p_partkey, {', '.join(cols)} FROM part{where}"


def case_query(label: str, columns: dict[str, list], run: Run, outcomes: dict[str, tuple[str, list]], where: str = "") -> None:
    QUERIES[label] = lambda spark, sf_dir: run(raw(spark, sf_dir, columns))
    SQL[label] = wanted(outcomes, where)


def _by_row(rows: list[tuple]) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)]


# --- Names of manufacturers (C2-C5, C10, F10, H2, H14) ---

_makes = _by_row([
    ("Bmw", "BMW", "DE", "Germany"), ("bmw", "BMW", "DE", "Germany"), (" Lucid   Motors ", "Lucid", "US", "United States"), ("Porsche", "Porsche", "DE", "Germany"),
    ("porsche", "Porsche", "DE", "Germany"), ("alfa", "Alfa Romeo", "IT", "Italy"), ("Unknown {z}", "Unknown {z}", "", None), ("unknown co-op", "Unknown Co-Op", "", None),
    ("", "", "", None), (None, "", "", None), ("MG", "MG", "GB", None), ("Mercedes-AMG", "Mercedes-AMG", "DE", "Germany"),
])
case_query(
    "c02_c03_c10_makers", {"v": _makes[0]},
    lambda d: d.select("p_partkey", normalize(F.col("v"), MAKERS).alias("maker"), country_of(F.col("v"), MAKERS).alias("country"), country_name(country_of(F.col("v"), MAKERS), MAKERS).alias("country_name")),
    {"maker": ("varchar", _makes[1]), "country": ("varchar", _makes[2]), "country_name": ("varchar", _makes[3])},
)

_names = _by_row([
    ("Porsche 9{z}", "Porsche", "9{z}"), ("porsche 9{z}", "Porsche", "9{z}"), ("Alfa Romeo G{z}", "Alfa Romeo", "G{z}"), ("Mercedes-AMG GT {z}", "Mercedes-AMG", "GT {z}"), ("80 Napier", "Napier", "80"),
    ("{z} Napier S{z}", "Napier", "{z} S{z}"), ("Lucid Motors Air {z}", "Lucid", "Air {z}"), ("MGB{z}", "MG", "B{z}"), ("{z} foo", "", "{z} foo"), ("Foo  b{z}", "Foo", "b{z}"), ("", "", ""), (None, "", ""), ("Tesla", "Tesla", ""),
])
case_query("c04_f10_parse_name", {"v": _names[0]}, lambda d: d.select("p_partkey", parse_name(F.col("v"), MAKERS).alias("n")).select("p_partkey", "n.*"), {"manufacturer": ("varchar", _names[1]), "model": ("varchar", _names[2])})

_fields = _by_row([("Porsche", "Porsche", ""), ("Porsche 9{z}", "Porsche", "9{z}"), ("mercedes amg", "Mercedes-AMG", ""), ("Alfa Romeo {z}C", "Alfa Romeo", "{z}C"), ("Zed X{z}", "Zed X{z}", ""), ("", "", ""), ("bmw M{z}", "BMW", "M{z}")])
case_query("c05_split_make", {"v": _fields[0]}, lambda d: d.select("p_partkey", split_make(F.col("v"), MAKERS).alias("n")).select("p_partkey", "n.*"), {"manufacturer": ("varchar", _fields[1]), "model": ("varchar", _fields[2])})

_titles = _by_row([("mercedes-benz", "Mercedes-Benz"), ("o'neil {z}d", "O'Neil {z}D"), ("ASTON martin", "Aston Martin"), ("", ""), ("x", "X")])
case_query("h14_title_case", {"v": _titles[0]}, lambda d: d.select("p_partkey", text.title_case(F.col("v")).alias("t")), {"t": ("varchar", _titles[1])})

# --- Text (H1, H2, H12, H13, H15) ---

_noisy = _by_row([
    ("Fast [1] car  {z}", "Fast car {z}", None), ("A{z} (citation needed) (kept)", "A{z} (kept)", None), ("N/A", "", None), ("est. {y} {z} hp, claimed", ". {y} {z} hp,", "{y}"), ("Café\t[a]\n{z}", "Café {z}", None),
    ("banana {z}", "ba {z}", None), (None, "", None), ("model of {y}, not 1899", "model of {y}, not 1899", "{y}"), ("  x  y ", "x y", None), ("n/a {y}x", "{y}x", None), ("estimate", "estimate", None),
])
case_query(
    "h01_h02_h15_clean_text", {"v": _noisy[0]}, lambda d: d.select("p_partkey", text.clean_text(F.col("v")).alias("t"), text.year_of(F.col("v")).alias("year")),
    {"t": ("varchar", _noisy[1]), "year": ("varchar", _noisy[2])},
)

_garbled = _by_row([
    ("a &#8211; {z} &amp; c", "a – {z} & c"), ("HuracÃ¡n {z}", "Huracán {z}"), ("Huracán &lt;{z}&gt;", "Huracán <{z}>"), ("plain {z}", "plain {z}"), (None, None), ("&copy; &unknown; {z}", "© &unknown; {z}"), ("SÃ£o &eacute; {z}", "São é {z}"),
])
case_query("h12_h13_repair", {"v": _garbled[0]}, lambda d: d.select("p_partkey", unescape_html(repair_mojibake(F.col("v"))).alias("t")), {"t": ("varchar", _garbled[1])})

# --- Model names (H4-H11) ---

_TAILS = (
    " First Drive", " First Drive Review", " First Drive Reviews 2 |", " First Ride Review", " Full Test Review", " Test Reviews", " Tested Review", " Test A Review", " Instrumented Test", " First Ride -", " Prototype Ride", " Prototype Drive",
    " Full Test", " by the Numbers", " Long-Term Test Wrap-Up", " Long-Term Update", " Road Test", " Retest", " Test", " Tested", " Review", " Reviews", " Prototype", " Instrumented", " Long Term", " Long-Term Road Test Wrap-Up",
)
_named = [("Modelx {z}" + t, "modelx {z}", "Modelx {z}", "Modelx {z}") for t in _TAILS]
_named += [
    ("Modelx {z} Touring", "modelx {z} touring", "Modelx {z} Touring", "Modelx {z} Touring"), ("Modelx {z} (2018)", "modelx {z}", "Modelx {z} (2018)", "Modelx {z} (2018)"), ("Modelx  {z} (W205)", "modelx {z}", "Modelx  {z} (W205)", "Modelx {z} (W205)"),
    ("Modelx {z} Page 3", "modelx {z}", "Modelx {z}", "Modelx {z} Page 3"), ("Modelx {z};", "modelx {z}", "Modelx {z}", "Modelx {z}"), ("Modelx {z} Review of It", "modelx {z}", "Modelx {z}", "Modelx {z} Review of It"), (None, "", "", ""),
    ("Modelx {z} Tested on Ice", "modelx {z} tested on ice", "Modelx {z}", "Modelx {z}"), ("First Drive", "first drive", "First Drive", ""), ("Modelx {z} T |", "modelx {z} t |", "Modelx {z} T |", "Modelx {z}"),
]
_named = _by_row(_named)
case_query(
    "h07_h08_h09_model_names", {"v": _named[0]}, lambda d: d.select("p_partkey", text.model_key(F.col("v")).alias("key"), text.stored_model(F.col("v")).alias("stored"), text.parsed_model(F.col("v")).alias("parsed")),
    {"key": ("varchar", _named[1]), "stored": ("varchar", _named[2]), "parsed": ("varchar", _named[3])},
)

_spelt = _by_row([
    ("Pamera {z}", "Panamera {z}"), ("Laferrari", "LaFerrari"), ("Huracan LP6{s} 4", "Huracan LP6{s}-4"), ("LP 7{s}-2", "LP7{s}-2"), ("{z}Lt", "{z}LT"), ("{z}Gt", "{z}GT"), ("Gt R {z}", "GT-R {z}"), ("911 Gts", "911 GTS"), ("Nsx", "NSX"), ("Rs{z}", "RS{z}"), ("Amg Pdk nismo", "AMG PDK NISMO"), ("Rest {z}", "Rest {z}"),
])
case_query("h10_spellings", {"v": _spelt[0]}, lambda d: d.select("p_partkey", text.spelled(F.col("v")).alias("t")), {"t": ("varchar", _spelt[1])})

_prefixed = _by_row([("BMW M{z}", "BMW", "M{z}"), ("bmw  M{z}", "BMW", "M{z}"), ("BMWX{z}", "BMW", "BMWX{z}"), ("M{z}", "BMW", "M{z}"), ("M{z}", "", "M{z}"), (" BMW M{z} ", "BMW", "M{z}"), ("Alfa Romeo {z}C", "alfa romeo", "{z}C")])
case_query("h05_without_prefix", {"m": _prefixed[0], "p": _prefixed[1]}, lambda d: d.select("p_partkey", text.without_prefix(F.col("m"), F.col("p")).alias("model")), {"model": ("varchar", _prefixed[2])})


def _digest(v: str) -> str:
    return f"substr(sha256(replace(replace('{v}', '{{y}}', cast(1970 + p_size AS varchar)), '{{z}}', cast(p_size AS varchar))), 1, 16)"


_ided = _by_row([("{y}", "Bmw", "BMW M{z}", "{y}bmwm{z}"), ("{y}", "BMW", "M-{z}", "{y}bmwm{z}"), ("", "alfa", "4C {z}", "alfaromeo4c{z}"), (None, "Zed", "X (É) {z}", "zedx{z}"), ("{y}", "Ford", "Fordo {z}", "{y}fordfordo{z}")])
QUERIES["h04_catalog_id"] = lambda spark, sf_dir: _catalog_ids(raw(spark, sf_dir, {"year": _ided[0], "manufacturer": _ided[1], "model": _ided[2]}))
SQL["h04_catalog_id"] = "SELECT p_partkey, CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN {_digest(v)}" for i, v in enumerate(_ided[3])) + " END AS car_id FROM part"


def _catalog_ids(d: DataFrame) -> DataFrame:
    from marque.operators.survivorship import with_car_id

    return with_car_id(d, MAKERS).select("p_partkey", "car_id")


def _keys(d: DataFrame) -> DataFrame:
    from marque.operators.survivorship import keyed

    key = text.record_key(F.col("year"), F.col("manufacturer"), F.col("model"))
    return keyed(d, MAKERS).select("p_partkey", F.col("_mk").alias("maker"), F.col("_md").alias("model"), text.label(F.col("year"), F.col("manufacturer"), d["model"]).alias("label"), key["year"].alias("key_year"), key["manufacturer"].alias("key_maker"), key["model"].alias("key_model"))


_keyed = _by_row([
    ("{y}", "Bmw", "BMW M{z} (F90) Test", "bmw", "m{z}", "{y} Bmw BMW M{z} (F90) Test", "{y}", "bmw", "bmw m{z} test"), ("", " Lucid Motors", "Air  {z}", "lucid", "air {z}", " Lucid Motors Air  {z}", None, "lucid motors", "air {z}"),
    (None, "Ford", "GT {z}", "ford", "gt {z}", "Ford GT {z}", None, "ford", "gt {z}"), ("{y}", None, None, "", "", "{y}", "{y}", "", ""),
])
case_query(
    "h06_h11_h20_keys", {"year": _keyed[0], "manufacturer": _keyed[1], "model": _keyed[2]}, _keys,
    {"maker": ("varchar", _keyed[3]), "model": ("varchar", _keyed[4]), "label": ("varchar", _keyed[5]), "key_year": ("varchar", _keyed[6]), "key_maker": ("varchar", _keyed[7]), "key_model": ("varchar", _keyed[8])},
)

# --- Numbers (H16, H17, H34-H39) ---

_numbers = _by_row([
    ("{z} lb-ft", "{z}", "{z}"), ("  {z}.5abc", "{z} + 0.5", "{z} + 0.5"), ("1,{s}", "100 + {z}", "1"), ("x{z}", "{z}", None), (None, None, None), ("", None, None), ("abc", None, None), ("-{z}.25", "-{z} - 0.25", "-{z} - 0.25"),
])
case_query("h34_h38_numbers", {"v": _numbers[0]}, lambda d: d.select("p_partkey", units.lenient_float(F.col("v")).alias("lenient"), units.leading_number(F.col("v")).alias("leading")), {"lenient": ("double", _numbers[1]), "leading": ("double", _numbers[2])})

QUERIES["h35_h36_conversions"] = lambda spark, sf_dir: _conversions(spark.read.parquet(f"{sf_dir}/part.parquet"))
SQL["h35_h36_conversions"] = """
SELECT p_partkey, round(p_size * 1.60934::double, 1) AS kmh, round(p_size * 0.621371::double, 1) AS mph, round(p_size * 0.7457::double, 1) AS kw, round(p_size * 1.341::double, 1) AS hp,
  round(p_size * 10 * 0.0163871::double, 1) AS litres_in3, round(cast(p_size * 97 AS double) / 1000, 1) AS litres_cm3, CASE WHEN p_size % 3 = 0 THEN NULL ELSE cast(p_size AS double) END AS litres FROM part
"""


def _conversions(part: DataFrame) -> DataFrame:
    z = F.col("p_size").cast("double")
    return part.select(
        "p_partkey", units.mph_to_kmh(z).alias("kmh"), units.kmh_to_mph(z).alias("mph"), units.hp_to_kw(z).alias("kw"), units.kw_to_hp(z).alias("hp"), units.litres_from_in3(z * 10).alias("litres_in3"),
        units.litres_from_cm3(z * 97).alias("litres_cm3"), units.litres(F.when(F.col("p_size") % 3 == 0, -z).otherwise(z)).alias("litres"),
    )


_specs = _by_row([
    ("1{s} mph (2{s} km/h)", "100 + {z}", "200 + {z}", "1{s} bhp / 7{s} kW", "100 + {z}", "700 + {z}", "{z}.5 s", "{z} + 0.5", "4{s} lb-ft @ 3000 rpm", "4{s} lb-ft", "3{s} lbs (1500 kg)", "300 + {z}"),
    ("2{s} kmh", None, "200 + {z}", "{z} HP", "{z}", None, "none", None, "x", None, "{z} lb", "{z}"), ("", None, None, "", None, None, "", None, "", None, "", None),
])
case_query(
    "h37_spec_units", {"speed": _specs[0], "power": _specs[3], "accel": _specs[6], "torque": _specs[8], "weight": _specs[10]},
    lambda d: d.select("p_partkey", units.spec_speed(F.col("speed")).alias("s"), units.spec_power(F.col("power")).alias("p"), units.spec_seconds(F.col("accel")).alias("sec"), units.spec_torque(F.col("torque")).alias("torque"), units.spec_pounds(F.col("weight")).alias("lb")).select("p_partkey", "s.mph", "s.kmh", "p.hp", "p.kw", "sec", "torque", "lb"),
    {"mph": ("double", _specs[1]), "kmh": ("double", _specs[2]), "hp": ("double", _specs[4]), "kw": ("double", _specs[5]), "sec": ("double", _specs[7]), "torque": ("varchar", _specs[9]), "lb": ("double", _specs[11])},
)

_script = _by_row([
    ("6:{s}.25", "360 + {z} + 0.25", "1{s},5 km/h (12 mph)", "12", "100 + {z} + 0.5", "1,5{s} kW (2,0{s} hp)", "2000 + {z}", "1500 + {z}"), ("DNF", None, "2{s} mph", "200 + {z}", "round((200 + {z}) * 1.60934::double, 1)", "3{s} hp", "300 + {z}", "round((300 + {z}) * 0.7457::double, 1)"),
    ("9.5 s at {z} km/h", "9.5", "2{s} km/h", "round((200 + {z}) / 1.60934::double, 1)", "200 + {z}", "3{s} kW", "round((300 + {z}) / 0.7457::double, 1)", "300 + {z}"), ("about {z}", None, "fast", None, None, "strong", None, None), (None, None, None, None, None, None, None, None),
    ("DNS", None, "", None, None, "5{s} PS", "round((500 + {z}) * 0.9863::double, 1)", "round(round((500 + {z}) * 0.9863::double, 1) * 0.7457::double, 1)"),
])
case_query(
    "h39_script_variants", {"t": _script[0], "s": _script[2], "p": _script[5]},
    lambda d: d.select("p_partkey", units.strict_time(F.col("t")).alias("sec"), units.comma_speed(F.col("s")).alias("s"), units.exact_power(F.col("p")).alias("p")).select("p_partkey", "sec", "s.mph", "s.kmh", "p.hp", "p.kw"),
    {"sec": ("double", _script[1]), "mph": ("double", _script[3]), "kmh": ("double", _script[4]), "hp": ("double", _script[6]), "kw": ("double", _script[7])},
)

QUERIES["h16_h17_shown"] = lambda spark, sf_dir: _shown(spark.read.parquet(f"{sf_dir}/part.parquet"))
SQL["h16_h17_shown"] = """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '—' ELSE format('{:,}', p_partkey * 7) || ' lb' END AS weight, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_partkey < 60 THEN concat(p_partkey, '.25') ELSE concat(cast(p_partkey // 60 AS varchar), ':', lpad(cast(p_partkey % 60 AS varchar), 2, '0'), '.25') END AS lap,
  concat(lpad(cast(p_size AS varchar), CASE WHEN p_size < 10 THEN 1 ELSE 2 END, '0'), '.5') AS sec FROM part
"""


def _shown(part: DataFrame) -> DataFrame:
    some = lambda c: F.when(F.col("p_size") % 5 != 0, c)
    lap = units.lap_time(some(F.col("p_partkey") + 0.25))
    return part.select("p_partkey", units.shown(some(F.col("p_partkey") * 7), 0, "lb").alias("weight"), lap.alias("lap"), units.lap_time(F.col("p_size") + 0.5, 1).alias("sec"))


# --- Categories (H50-H57) ---

_engines = _by_row([
    ("electric", "", "", "Electric"), ("hybrid V6 turbo", "X{z}", "", "Electric/Petrol"), ("electric motor and engine", "", "", "Electric/Petrol"), ("turbo diesel", "", "", "Diesel"), ("V8", "", None, "Petrol"), ("", "", "", ""), ("plug-in tdi", "", "", "Electric/Diesel"), ("2.{z} l", "", "", "Petrol"),
    ("", "Golf TDI inline", "", "Diesel"), ("", "", "battery", "Electric"), (None, None, None, ""), ("rotary", "X", "gas", "Petrol"), ("evolved v", "X", "", ""),
])
case_query("h50_propulsion", {"e": _engines[0], "m": _engines[1], "f": _engines[2]}, lambda d: d.select("p_partkey", classify.propulsion(F.col("e"), F.col("m"), F.col("f")).alias("propulsion")), {"propulsion": ("varchar", _engines[3])})

_fuels = _by_row([
    ("Electric", "", "", "Electric"), ("Hybrid", "", "A{z} Plug-In", "Plug-in Hybrid"), ("hybrid", "", "A{z} PHEV", "Plug-in Hybrid"), ("Hybrid", "", "A{z}", "Hybrid"), ("Gas", "", "", "ICE"), ("diesel", "", "", "ICE"), ("", "V-8 turbo v8", "", "Petrol"), ("unknown", "electric", "", "Electric"),
])
case_query("h51_review_propulsion", {"f": _fuels[0], "e": _fuels[1], "m": _fuels[2]}, lambda d: d.select("p_partkey", classify.review_propulsion(F.col("f"), F.col("e"), F.col("m")).alias("propulsion")), {"propulsion": ("varchar", _fuels[3])})

_kinds = _by_row([
    ("Premium Gasoline", "Petrol", "Petrol", None), ("Electricity", "Electric", "Electric", "Electric"), ("Diesel", "Diesel", "Diesel", None), (None, "", "", None), ("Regular", "Petrol", "", None), ("hybrid diesel", "Diesel", "Electric/Diesel", "Hybrid"), ("Hybrid petrol", "", "Electric/Petrol", "Hybrid"), ("Plug-in hybrid electric", "Electric", "Electric", "Plug-in Hybrid"),
    ("Battery electric", "Electric", "Electric", "Electric"), ("Internal combustion", "", "", "ICE"),
])
case_query(
    "h52_source_propulsions", {"v": _kinds[0]}, lambda d: d.select("p_partkey", classify.fuel_propulsion(F.col("v")).alias("epa"), classify.engine_propulsion(F.col("v")).alias("kaggle"), parsers.power_propulsion(F.col("v")).alias("power")),
    {"epa": ("varchar", _kinds[1]), "kaggle": ("varchar", _kinds[2]), "power": ("varchar", _kinds[3])},
)

_configs = _by_row([
    ("twin-turbocharged DOHC V-8", "ICE", "V8", "TC"), ("supercharged W16", "ICE", "W16", "SC"), ("flat-6", "ICE", "H6", "NA"), ("rotary", "", "Rotary", "NA"), ("AC motor", "Electric", "Electric", None), (None, "ICE", None, None), ("", "ICE", None, None), ("4-in-line turbo", "ICE", "I4", "TC"), ("thing {z}", "ICE", None, None),
    ("V12 inline-6", "ICE", "V12", "NA"), ("flat-four", "ICE", "H4", "NA"), ("inline-5", "ICE", "I5", "NA"),
])
case_query(
    "h53_h54_engines", {"e": _configs[0], "p": _configs[1]}, lambda d: d.select("p_partkey", classify.engine_config(F.col("e"), F.col("p")).alias("config"), classify.aspiration(F.col("e"), F.col("p")).alias("aspiration")),
    {"config": ("varchar", _configs[2]), "aspiration": ("varchar", _configs[3])},
)

_bodies = _by_row([
    ("mid-engine, rear-wheel-drive, 2-passenger, 2-door coupe", "Coupe", "Mid", "RWD", "sedan", "Sedan"), ("front-engine, all-wheel-drive 4-door SUV", "SUV", "Front", "AWD", "station wagon", "Wagon"), ("rear-motor, 4-wheel-drive pickup", "Truck", "Rear", "4WD", "pickup", "Truck"), ("front-motor, front-wheel-drive, 5-door hatchback", "Hatchback", "Front", "FWD", "minivan", "Van"),
    ("four-wheel-drive targa", "Targa", None, "4WD", "boat", None), ("", None, None, None, "", None),
])
case_query(
    "h55_h56_bodies", {"v": _bodies[0], "b": _bodies[4]},
    lambda d: d.select("p_partkey", classify.by_pattern(F.col("v"), classify.BODY_WORDS).alias("body"), classify.by_pattern(F.col("v"), classify.PLACEMENT_WORDS).alias("placement"), classify.by_pattern(F.col("v"), classify.DRIVE_WORDS).alias("drive"), classify.mapped(F.col("b"), classify.BODY_NAMES).alias("named")),
    {"body": ("varchar", _bodies[1]), "placement": ("varchar", _bodies[2]), "drive": ("varchar", _bodies[3]), "named": ("varchar", _bodies[5])},
)

_slashes = _by_row([("Porsche 911 GT3/GT3 RS", "true"), ("Bmw A{z}/Bmw B{z}", "false"), ("Ford A/B", "true"), ("A/B/C", "false"), ("Ford A/Alfa Romeo B", "false"), ("Ford A/zed B", "false"), ("Ford A/Zed B", "true")])
case_query("h57_variants", {"v": _slashes[0]}, lambda d: d.select("p_partkey", parsers.is_variant(F.col("v"), MAKERS).alias("variant")), {"variant": ("boolean", _slashes[1])})
_paths = _by_row([("/x/Acceleration_{z}.csv", "acceleration"), ("/x/top speed.csv", "speed_records"), ("/x/power.csv", "power_output"), ("/x/Nürburgring.csv", "nurburgring"), ("/x/top_gear.csv", "top_gear"), ("/x/other{z}.csv", "generic"), ("/x/Nu\u0308rburgring laps.csv", "nurburgring")])
case_query("a10_parser_for", {"v": _paths[0]}, lambda d: d.select("p_partkey", parsers.parser_for(F.col("v")).alias("parser")), {"parser": ("varchar", _paths[1])})
