"""One function a source: raw strings in, staged catalog rows out.

A parser is ``(raw DataFrame, Makers) -> DataFrame`` of catalog columns with provenance (``source``,
``source_file``, ``source_row``, ``source_url``) and ``reject``: null for a usable row, else why it isn't one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marque.functions import classify, units
from marque.functions.columns import filled, first_match, name
from marque.functions.text import clean_text, parsed_model, repaired, without_prefix, year_of
from marque.operators.makers import Makers, country_of, normalize, parse_name, split_make
from marque.schema import BY_NAME, COLUMNS

PARSERS: dict[str, Callable[[DataFrame, Makers], DataFrame]] = {}


def register_parser(label: str):
    """Decorator: makes a parser known by a name (a later one replaces it)."""

    def put(fn):
        PARSERS[label] = fn
        return fn

    return put


def get_parser(label: str) -> Callable[[DataFrame, Makers], DataFrame]:
    if label not in PARSERS:
        raise KeyError(f"no parser {label!r}; known: {', '.join(sorted(PARSERS))}")
    return PARSERS[label]


def unregister(label: str) -> None:
    PARSERS.pop(label, None)


def _raw(df: DataFrame, *names: str) -> Column:
    """The first non-blank of some columns, whichever exist; blank otherwise."""
    has = [F.nullif(name(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*has, F.lit("")) if has else F.lit("")


def _stage(df: DataFrame, source: str, makers: Makers, values: dict[str, Column], reject: Column, url: Column | None = None) -> DataFrame:
    kinds = {"string": "string", "numeric": "double", "integer": "int"}
    blank = F.lit(None).cast("string")
    values = {"country": F.nullif(country_of(values["manufacturer"], makers), F.lit("")), "sources": F.lit(source), **values}
    cols = [(F.nullif(values[c], F.lit("")) if BY_NAME[c].kind == "string" else values[c].cast(kinds[BY_NAME[c].kind])).alias(c) if c in values else F.lit(None).cast(kinds[BY_NAME[c].kind]).alias(c) for c in COLUMNS]
    place = [name(c) if c in df.columns else blank.alias(c) for c in ("source_file",)] + [name("source_row").cast("long").alias("source_row") if "source_row" in df.columns else F.lit(None).cast("long").alias("source_row")]
    return df.select(*cols, F.lit(source).alias("source"), *place, (F.nullif(url, F.lit("")) if url is not None else blank).alias("source_url"), reject.alias("reject"))


def _why(*rules: tuple[Column, str]) -> Column:
    return first_match([(F.coalesce(c, F.lit(True)), why) for c, why in rules]) if rules else F.lit(None)


def _no_data(values: dict[str, Column], *names: str) -> Column:
    out = F.lit(True)
    for n in names or [n for n in values if n not in ("manufacturer", "model", "year", "country", "propulsion")]:
        out = out & ~filled(values[n])
    return out


@register_parser("review_specs")
def review_specs(df: DataFrame, makers: Makers) -> DataFrame:
    """Road-test specifications: newer columns first, older ones as fallback."""
    raw = lambda *n: F.trim(_raw(df, *n))
    df = repaired(df, "hrst_submodel", "hrst_model", "model", "make")
    df = df.withColumn("_made", split_make(raw("make"), makers))
    made, new = F.col("_made"), raw("hrst_make")
    df = df.withColumn("_maker", F.when(new != "", normalize(new, makers)).otherwise(made["manufacturer"]))
    maker = F.col("_maker")
    old_model = F.when(new != "", raw("model")).otherwise(F.trim(F.concat_ws(" ", F.nullif(made["model"], F.lit("")), F.nullif(raw("model"), F.lit("")))))
    full = F.when(raw("hrst_submodel") != "", without_prefix(raw("hrst_submodel"), maker)).when(raw("hrst_model") != "", raw("hrst_model")).otherwise(old_model)
    full = F.when((maker == "Alfa Romeo") & F.startswith(F.lower(full), F.lit("romeo ")), F.trim(F.substring(full, 7, 10_000))).otherwise(full)
    df = df.withColumn("_full", full)
    df = df.withColumn("_model", parsed_model(F.col("_full")))
    full, model, engine, kind = F.col("_full"), F.col("_model"), raw("engine_type"), F.lower(raw("vehicle_type"))
    df = df.withColumn("_drive", classify.review_propulsion(raw("hrst_fuel_type"), engine, model))
    drive = F.col("_drive")
    body = raw("hrst_body_style")
    numbers = ("displacement", "zero_to_60_mph", "zero_to_100_mph", "quarter_mile_time", "quarter_mile_speed", "top_speed", "braking_70_0", "braking_100_0", "skidpad_g", "power_hp", "torque_lb_ft", "curb_weight")
    df = df.withColumns({f"_x_{n}": units.parse_float(raw(n)) for n in numbers})
    num = lambda n: F.col(f"_x_{n}")
    hp = num("power_hp")
    v = {
        "manufacturer": maker, "model": model, "year": F.coalesce(year_of(F.when(raw("hrst_year") != "", raw("hrst_year")).otherwise(raw("year"))), F.lit("")), "propulsion": drive,
        "body_style": F.when(body != "", classify.mapped(F.lower(body), classify.BODY_NAMES)).otherwise(classify.by_pattern(kind, classify.BODY_WORDS)),
        "engine_type": classify.engine_config(engine, drive), "engine_displacement": units.litres_from_in3(num("displacement")), "engine_aspiration": classify.aspiration(engine, drive),
        "engine_placement": classify.by_pattern(kind, classify.PLACEMENT_WORDS), "drivetrain": classify.by_pattern(kind, classify.DRIVE_WORDS),
        "0_60_mph_sec": num("zero_to_60_mph"), "0_100_mph_sec": num("zero_to_100_mph"), "quarter_mile_sec": num("quarter_mile_time"), "quarter_mile_speed_mph": num("quarter_mile_speed"),
        "top_speed_mph": num("top_speed"), "braking_70_0_ft": num("braking_70_0"), "braking_100_0_ft": num("braking_100_0"), "skidpad_g": num("skidpad_g"),
        "power_hp": hp, "power_kw": units.hp_to_kw(hp), "torque": F.when(num("torque_lb_ft") != 0, units.torque_text(num("torque_lb_ft"))), "curb_weight_lb": num("curb_weight"),
    }
    none = _no_data(v, "0_60_mph_sec", "0_100_mph_sec", "quarter_mile_sec", "top_speed_mph", "braking_70_0_ft", "skidpad_g")
    return _stage(df, "Car & Driver", makers, v, _why((maker == "", "no manufacturer"), (full == "", "no model"), (none, "no measurements")), raw("url"))


@register_parser("lightning_lap")
def lightning_lap(df: DataFrame, makers: Makers) -> DataFrame:
    text, time = F.trim(_raw(df, "Year Make Model")), F.trim(_raw(df, " Lap Time", "Lap Time"))
    rest = F.trim(F.regexp_extract(text, r"^(\d{4})\s+(.+)$", 2))
    df = df.withColumns({"_n": parse_name(rest, makers), "_lap": units.parse_time(time)})
    n, lap = F.col("_n"), F.col("_lap")
    v = {"manufacturer": n["manufacturer"], "model": F.when(n["model"] == "", rest).otherwise(n["model"]), "year": F.regexp_extract(text, r"^(\d{4})\s+(.+)$", 1), "lightning_lap_sec": lap}
    return _stage(df, "Car & Driver", makers, v, _why(((text == "") | (time == ""), "blank"), (rest == "", "no year and name"), (n["manufacturer"] == "", "unknown manufacturer"), (lap.isNull(), "no lap time")))


# Words of racing cars.
RACE_CARS = r"(?i)\b(?:F1|F2|F3|Formula|GT3|GT2|GT1|LMP\d?|DTM|WRC|TCR|Race\s*Car|Pro(?:totype)?\s*Class|cycling|bicycle)\b"


def _named(df: DataFrame, makers: Makers, columns: tuple[str, ...], value: Callable[[Column], Column], cells: tuple[str, ...]) -> tuple[DataFrame, Column, Column, Column]:
    """df with the vehicle's text and name and a parsed value as columns of their own, and these columns."""
    df = df.withColumns({"_vehicle": clean_text(_raw(df, *columns)), "_value": value(_raw(df, *cells))})
    df = df.withColumn("_n", parse_name(F.col("_vehicle"), makers))
    return df, F.col("_vehicle"), F.col("_n"), F.col("_value")


@register_parser("nurburgring")
def nurburgring(df: DataFrame, makers: Makers) -> DataFrame:
    df, vehicle, n, lap = _named(df, makers, ("Vehicle", "Car"), units.parse_time, ("Time", "Lap Time"))
    date = clean_text(_raw(df, "Date"))
    v = {"manufacturer": n["manufacturer"], "model": n["model"], "year": F.coalesce(year_of(date), year_of(vehicle), F.lit("")), "nurburgring_lap_sec": lap, "nurburgring_driver": clean_text(_raw(df, "Driver")), "nurburgring_date": date}
    return _stage(df, "Wikipedia", makers, v, _why((vehicle == "", "blank"), (vehicle.rlike(RACE_CARS), "racing car"), (n["manufacturer"] == "", "unknown manufacturer"), (lap.isNull(), "no lap time"), (~lap.between(300, 900), "lap time out of range")))


@register_parser("top_gear")
def top_gear(df: DataFrame, makers: Makers) -> DataFrame:
    df, vehicle, n, lap = _named(df, makers, ("Vehicle", "Car"), units.parse_time, ("Time", "Lap Time"))
    v = {"manufacturer": n["manufacturer"], "model": n["model"], "year": F.coalesce(year_of(vehicle), F.lit("")), "top_gear_lap_sec": lap, "top_gear_episode": clean_text(_raw(df, "Episode"))}
    return _stage(df, "Wikipedia", makers, v, _why((vehicle == "", "blank"), (n["manufacturer"] == "", "unknown manufacturer"), (lap.isNull(), "no lap time"), (~lap.between(60, 180), "lap time out of range")))


@register_parser("acceleration")
def acceleration(df: DataFrame, makers: Makers) -> DataFrame:
    df, vehicle, n, sec = _named(df, makers, ("Car", "Vehicle"), units.parse_float, ("Time", "0-60 mph"))
    v = {"manufacturer": n["manufacturer"], "model": n["model"], "year": F.coalesce(year_of(_raw(df, "Model year", "Year")), F.lit("")), "propulsion": classify.propulsion(_raw(df, "Propulsion", "Powertrain"), n["model"]), "0_60_mph_sec": sec}
    return _stage(df, "Wikipedia", makers, v, _why((vehicle == "", "blank"), (n["manufacturer"] == "", "unknown manufacturer"), (sec.isNull(), "no time"), (~sec.between(1.0, 30.0), "time out of range")))


@register_parser("speed_records")
def speed_records(df: DataFrame, makers: Makers) -> DataFrame:
    df, vehicle, n, s = _named(df, makers, ("Make and model", "Vehicle", "Car"), units.parse_speed, ("Top speed", "Speed"))
    v = {"manufacturer": n["manufacturer"], "model": n["model"], "year": F.coalesce(year_of(_raw(df, "Year")), F.lit("")), "propulsion": classify.propulsion(_raw(df, "Engine"), n["model"]), "top_speed_mph": s["mph"], "top_speed_kmh": s["kmh"]}
    return _stage(df, "Wikipedia", makers, v, _why((vehicle == "", "blank"), (n["manufacturer"] == "", "unknown manufacturer"), (s["mph"].isNull(), "no speed"), (~s["mph"].between(50, 350), "speed out of range")))


def is_variant(vehicle: Column, makers: Makers) -> Column:
    """Whether a slash joins variants of one model rather than vehicles of their own."""
    parts = F.split(vehicle, "/")
    second = F.trim(F.get(parts, F.lit(1)))
    word = F.split_part(second, F.lit(" "), F.lit(1))
    spaced = F.lit(False)
    for n in makers.spaced:
        spaced = spaced | F.startswith(second, F.lit(n))
    return (F.size(parts) == 2) & (~F.contains(second, F.lit(" ")) | ((normalize(word, makers) == word) & ~spaced))


def power_propulsion(kind: Column) -> Column:
    t = F.lower(F.trim(kind))
    return F.when(t.rlike("electric") & ~t.rlike("plug|hybrid"), "Electric").when(t.rlike("plug-in hybrid|phev"), "Plug-in Hybrid").when(t.rlike("hybrid|hev"), "Hybrid").when(t.rlike("internal combustion|ice"), "ICE")


@register_parser("power_output")
def power_output(df: DataFrame, makers: Makers) -> DataFrame:
    """Cells that name several vehicles become a row for each, with the year at the same place."""
    df = df.withColumns({"_all": clean_text(_raw(df, "Vehicle", "Car")), "_p": units.parse_power(_raw(df, "Power"))})
    vehicle = F.col("_all")
    several = F.contains(vehicle, F.lit("/")) & ~is_variant(vehicle, makers)
    years = _raw(df, "Year")
    names = F.when(several, F.split(vehicle, "/")).otherwise(F.array(vehicle))
    flat = df.select(*[name(c) for c in df.columns], F.posexplode(names).alias("_i", "_vehicle"), several.alias("_several"))
    year = F.when(F.contains(years, F.lit("/")) & F.col("_several"), F.coalesce(F.get(F.split(years, "/"), F.col("_i")), F.lit(""))).otherwise(years)
    flat = flat.withColumn("_n", parse_name(F.trim("_vehicle"), makers))
    n, p = F.col("_n"), F.col("_p")
    v = {"manufacturer": n["manufacturer"], "model": n["model"], "year": F.coalesce(year_of(year), F.lit("")), "propulsion": power_propulsion(_raw(df, "Type")), "power_hp": p["hp"], "power_kw": p["kw"]}
    one = ~F.col("_several")
    return _stage(flat, "Wikipedia", makers, v, _why((F.col("_vehicle") == "", "blank"), (n["manufacturer"] == "", "unknown manufacturer"), (one & p["hp"].isNull() & p["kw"].isNull(), "no power"), (one & (F.coalesce(p["hp"], F.lit(0.0)) > 3000), "power out of range")))


# The agency's vehicle classes and drives.
_CLASSES = (("Coupe", ("Two Seaters", "Minicompact Cars")), ("Sedan", ("Subcompact Cars", "Compact Cars", "Midsize Cars", "Large Cars")), ("Wagon", ("Small Station Wagons", "Midsize Station Wagons")), ("Van", ("Vans", "Vans Passenger", "Vans, Cargo Type", "Vans, Passenger Type", "Minivan - 2WD", "Minivan - 4WD")), ("SUV", ("Sport Utility Vehicle", "Sport Utility Vehicle - 2WD", "Sport Utility Vehicle - 4WD", "Small Sport Utility Vehicle 2WD", "Small Sport Utility Vehicle 4WD", "Standard Sport Utility Vehicle 2WD", "Standard Sport Utility Vehicle 4WD")), ("Truck", ("Small Pickup Trucks", "Small Pickup Trucks 2WD", "Small Pickup Trucks 4WD", "Standard Pickup Trucks", "Standard Pickup Trucks 2WD", "Standard Pickup Trucks 4WD", "Standard Pickup Trucks/2WD", "Pickup Trucks")))
VEHICLE_CLASSES = {c: style for style, cs in _CLASSES for c in cs}
DRIVES = {"Front-Wheel Drive": "FWD", "Rear-Wheel Drive": "RWD", "All-Wheel Drive": "AWD", "4-Wheel Drive": "4WD", "4-Wheel or All-Wheel Drive": "AWD", "2-Wheel Drive": "RWD", "Part-time 4-Wheel Drive": "4WD"}


def _number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


@register_parser("epa_vehicles")
def epa_vehicles(df: DataFrame, makers: Makers) -> DataFrame:
    raw = lambda n: F.trim(_raw(df, n))
    df = repaired(df, "model")
    df = df.withColumns({"_maker": normalize(raw("make"), makers), "_model": parsed_model(raw("model"))})
    maker, model = F.col("_maker"), F.col("_model")
    v = {
        "manufacturer": maker, "model": model, "year": F.coalesce(year_of(raw("year")), F.lit("")), "propulsion": classify.fuel_propulsion(raw("fuelType1")),
        "body_style": classify.mapped(raw("VClass"), VEHICLE_CLASSES), "engine_type": classify.mapped(_number(raw("cylinders")).cast("int"), classify.CYLINDERS), "engine_displacement": units.litres(_number(raw("displ"))),
        "engine_aspiration": F.when(F.upper(raw("tCharger")) == "T", "TC").when(F.upper(raw("sCharger")) == "S", "SC"), "drivetrain": classify.mapped(raw("drive"), DRIVES),
    }
    return _stage(df, "EPA", makers, v, _why(((raw("make") == "") | (raw("model") == ""), "blank"), ((maker == "") | (model == ""), "no name"), (_no_data(v), "no specifications")))


# The vocabulary of the specification tables.
BODY_TYPES = {"Sedan": "Sedan", "Hatchback": "Hatchback", "Hatchback 3 doors": "Hatchback", "Wagon": "Wagon", "Crossover": "Crossover", "Minivan": "Van", "Coupe": "Coupe", "Pickup": "Truck", "Cabriolet": "Convertible", "Liftback": "Hatchback", "hardtop": "Coupe", "Roadster": "Roadster", "Targa": "Targa", "Fastback": "Coupe", "Limousine": "Sedan", "SUV": "SUV"}
LAYOUTS = {"Inline": "I", "inline": "I", "V-type": "V", "V-type with small angle": "V", "Opposed": "H", "opposed": "H", "W-type": "W", "Rotary-piston": "Rotary", "Rotary": "Rotary"}
BOOSTS = {"Turbo": "TC", "turbine": "TC", "Biturbo": "TC", "Twin-scroll": "TC", "Triple turbo": "TC", "compressor": "SC", "Turbine + compressor": "TC", "none": "NA", "Intercooler": "TC"}
WHEELS = {"Front wheel drive": "FWD", "Rear wheel drive": "RWD", "All wheel drive (AWD)": "AWD", "Four wheel drive (4WD)": "4WD", "full": "AWD", "Constant all wheel drive": "AWD"}
PLACES = {"front, cross-section": "Front", "front, longitudinal": "Front", "Front, longitudinally": "Front", "Front": "Front", "central": "Mid", "rear": "Rear"}


@register_parser("kaggle")
def kaggle(df: DataFrame, makers: Makers) -> DataFrame:
    raw = lambda n: F.trim(_raw(df, n))
    df = repaired(df, "Modle", "Trim")
    numbers = ("acceleration_0_100_km/h_s", "max_speed_km_per_h", "engine_hp", "max_power_kw", "maximum_torque_n_m", "curb_weight_kg")
    df = df.withColumns({f"_x_{n}": F.nullif(units.parse_float(raw(n)), F.lit(0.0)) for n in numbers} | {"_maker": normalize(raw("Make"), makers)})
    num = lambda n: name(f"_x_{n}")
    maker, trim = F.col("_maker"), raw("Trim")
    df = df.withColumn("_model", parsed_model(F.when((trim != "") & (trim != raw("Modle")), F.concat_ws(" ", raw("Modle"), trim)).otherwise(raw("Modle"))))
    model = F.col("_model")
    layout, count = classify.mapped(raw("cylinder_layout"), LAYOUTS), _number(raw("number_of_cylinders")).cast("int")
    accel, kmh, hp, kw = num("acceleration_0_100_km/h_s"), num("max_speed_km_per_h"), num("engine_hp"), num("max_power_kw")
    v = {
        "manufacturer": maker, "model": model, "year": F.coalesce(year_of(raw("Year_from")), F.lit("")), "propulsion": classify.engine_propulsion(raw("engine_type")),
        "body_style": classify.mapped(raw("Body_type"), BODY_TYPES), "engine_type": F.when(raw("number_of_cylinders") != "", F.when(layout == "Rotary", "Rotary").otherwise(F.concat(layout, count.cast("string")))),
        "engine_displacement": units.litres_from_cm3(_number(raw("capacity_cm3"))), "engine_aspiration": classify.mapped(raw("boost_type"), BOOSTS), "engine_placement": classify.mapped(raw("engine_placement"), PLACES), "drivetrain": classify.mapped(raw("drive_wheels"), WHEELS),
        "0_100_kmh_sec": accel, "0_60_mph_sec": F.round(accel * 0.9656, 2), "top_speed_kmh": kmh, "top_speed_mph": units.kmh_to_mph(kmh),
        "power_hp": F.coalesce(hp, F.round(kw / units.HP_TO_KW, 1)), "power_kw": F.when(hp.isNull(), kw).when(kw.isNull(), units.hp_to_kw(hp)),
        "torque": units.torque_text(F.round(num("maximum_torque_n_m") * units.NM_TO_LBFT, 0)), "curb_weight_lb": F.round(num("curb_weight_kg") * units.KG_TO_LB, 0),
    }
    return _stage(df, "Kaggle", makers, v, _why(((raw("Make") == "") | (raw("Modle") == ""), "blank"), ((maker == "") | (model == ""), "no name"), (_no_data(v), "no specifications")))


_CONFIGS = ("V8", "V6", "V10", "V12", "W12", "W16", "I4", "I6", "I3", "H4", "H6")
_DRIVE_TYPES = (("rear wheel drive", "RWD"), ("front wheel drive", "FWD"), ("all wheel drive", "AWD"), ("four wheel drive", "4WD"), ("4wd", "4WD"), ("awd", "AWD"), ("rwd", "RWD"), ("fwd", "FWD"))


@register_parser("autoevolution")
def autoevolution(df: DataFrame, makers: Makers) -> DataFrame:
    """Engines joined to their automobiles (columns specs as a map of maps, title, url)."""
    spec = lambda group, key: F.coalesce(F.col("specs")[group][key], F.lit(""))
    title = F.replace(F.coalesce(F.col("title"), F.lit("")), F.lit("&amp;"), F.lit("&"))
    title = F.trim(F.replace(F.replace(title, F.lit("Photos, engines & full specs"), F.lit("")), F.lit("Photos"), F.lit("")))
    tail = r"(\d{4})(?:-\d{4})?\s*$"
    df = repaired(df, "title").withColumn("_title", title)
    df = df.withColumns({"_year": F.regexp_extract("_title", tail, 1), "_bare": F.trim(F.regexp_replace("_title", tail, ""))})
    df = df.withColumn("_n", parse_name(F.col("_bare"), makers))
    year, bare, n = F.col("_year"), F.col("_bare"), F.col("_n")
    double = F.contains(bare, F.lit("  "))
    maker = normalize(F.when(double, F.trim(F.split_part(bare, F.lit("  "), F.lit(1)))).otherwise(n["manufacturer"]), makers)
    model = parsed_model(F.when(double, F.trim(F.regexp_extract(bare, r"^.*?  (.*)$", 1))).otherwise(n["model"]))
    df = df.withColumns({"_maker": maker, "_model": model})
    maker, model = F.col("_maker"), F.col("_model")
    cyl, fuel = F.upper(F.trim(spec("Engine Specs", "Cylinders:"))), F.lower(spec("Engine Specs", "Fuel System:"))
    count = F.regexp_extract(cyl, r"(\d+)", 1).try_cast("int")
    config = first_match([(F.contains(cyl, F.lit(k)), k) for k in _CONFIGS] + [(cyl.rlike("FLAT[ -]4"), "H4"), (cyl.rlike("FLAT[ -]6"), "H6")])
    config = F.coalesce(config, F.when(count.isNotNull(), F.when(F.contains(cyl, F.lit("V")), F.concat(F.lit("V"), count.cast("string"))).when(F.contains(cyl, F.lit("W")), F.concat(F.lit("W"), count.cast("string"))).when(count <= 6, F.concat(F.lit("I"), count.cast("string")))))
    speed, power = units.spec_speed(spec("Performance Specs", "Top Speed:")), units.spec_power(spec("Engine Specs", "Power:"))
    accel = units.spec_seconds(spec("Performance Specs", "Acceleration 0-62 Mph (0-100 Kph):"))
    v = {
        "manufacturer": maker, "model": model, "year": year, "propulsion": classify.engine_propulsion(spec("Engine Specs", "Fuel:")), "engine_type": config,
        "engine_displacement": F.round(F.regexp_extract(spec("Engine Specs", "Displacement:"), r"(?i)(\d+(?:\.\d+)?)\s*(?:cm3|cc)", 1).try_cast("double") / 1000, 1),
        "engine_aspiration": F.when(fuel.rlike("turbo"), "TC").when(fuel.rlike("supercharged|compressor"), "SC").when(fuel.rlike("naturally aspirated"), "NA"),
        "drivetrain": classify.by_pattern(F.lower(spec("Transmission Specs", "Drive Type:")), _DRIVE_TYPES), "top_speed_mph": speed["mph"], "top_speed_kmh": speed["kmh"],
        "0_100_kmh_sec": accel, "0_60_mph_sec": accel, "power_hp": power["hp"], "power_kw": power["kw"], "torque": units.spec_torque(spec("Engine Specs", "Torque:")), "curb_weight_lb": units.spec_pounds(spec("Weight Specs", "Unladen Weight:")),
    }
    return _stage(df, "Autoevolution", makers, v, _why((maker == "", "no manufacturer"), (model == "", "no model"), (_no_data(v), "no specifications")), F.col("url"))


def autoevolution_rows(engines: DataFrame, automobiles: DataFrame) -> DataFrame:
    """Engines with their automobile's title and URL; engines without one, or without readable specs, drop out."""
    from marque.sources.readers import json_objects

    autos = automobiles.select(name("id").alias("automobile_id"), F.col("image").alias("title"), F.col("name").alias("url")).dropDuplicates(["automobile_id"])
    e = json_objects(engines.where("automobile_id <> '' and specs <> ''").withColumnRenamed("specs", "_text"), "_text")
    return e.drop("name").join(autos, "automobile_id").where("title <> ''")


def generic_rows(df: DataFrame, makers: Makers) -> DataFrame:
    """A CSV of unknown make-up: its car, year, speed and power columns are found by their headers."""
    from marque.sources.readers import find_column

    car, year = find_column(df.columns, "car", "vehicle", "model", "make"), find_column(df.columns, "year")
    speed, power = find_column(df.columns, "speed"), find_column(df.columns, "power")
    if car is None:
        raise ValueError("no column names the car")
    df = df.withColumn("_n", parse_name(clean_text(name(car)), makers))
    n = F.col("_n")
    s, p = units.parse_speed(name(speed) if speed else F.lit("")), units.parse_power(name(power) if power else F.lit(""))
    v = {"manufacturer": n["manufacturer"], "model": n["model"], "year": F.coalesce(year_of(name(year)) if year else F.lit(None).cast("string"), F.lit("")), "top_speed_mph": s["mph"], "top_speed_kmh": s["kmh"], "power_hp": p["hp"], "power_kw": p["kw"]}
    return _stage(df, "Wikipedia", makers, v, _why((n["manufacturer"] == "", "unknown manufacturer"), (_no_data(v), "no values")))


def parser_for(path: Column) -> Column:
    """The parser that a file's path asks for."""
    p = F.lower(path)
    words = (("acceleration", "acceleration"), ("speed", "speed_records"), ("power", "power_output"), ("n(ü|ü|u)rburgring", "nurburgring"), ("top.?gear", "top_gear"), ("lightning", "lightning_lap"))
    return classify.by_pattern(p, words, "generic")


HTML_COLUMNS = {"acceleration": {"Car": ("car", "vehicle", "model"), "Time": ("time", "0-60"), "Model year": ("year",), "Propulsion": ("propulsion", "powertrain")}, "speed_records": {"Make and model": ("make", "car", "vehicle"), "Top speed": ("speed",), "Year": ("year",), "Engine": ("engine",)}, "power_output": {"Vehicle": ("vehicle", "car", "model"), "Power": ("power",), "Year": ("year",), "Type": ("type", "section")}, "nurburgring": {"Vehicle": ("vehicle", "car", "model"), "Time": ("time",), "Driver": ("driver",), "Date": ("date",)}, "top_gear": {"Vehicle": ("vehicle", "car"), "Time": ("time",), "Episode": ("episode",)}}


def from_tables(rows: DataFrame, parser: str, makers: Makers) -> DataFrame:
    """Rows of HTML tables through the parser of the CSV of the same content."""
    from marque.sources.readers import cell

    cols = [cell(*parts).alias(c) for c, parts in HTML_COLUMNS[parser].items()]
    return get_parser(parser)(rows.select(*cols, "source_file", F.col("row_idx").alias("source_row")), makers)
