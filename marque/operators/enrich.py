"""Values derived from other values of the row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marque.functions.classify import mapped
from marque.functions.columns import filled, first_match, name
from marque.functions.units import TO_0_100, hp_to_kw, kmh_to_mph, kw_to_hp, mph_to_kmh

# Fixed values: (manufacturer, model) patterns of the engine's place, in order; aspiration words; doors and seats by body.
PLACEMENTS: tuple[tuple[str, str, str], ...] = (
    ("^porsche$", "911|carrera|targa|turbo s$|gt3|gt2", "Rear"),
    ("^porsche$", "718|boxster|cayman|spyder", "Mid"),
    ("^porsche$", "taycan|panamera|cayenne|macan", "Front"),
    ("^ferrari$", "f8|sf90|296|488|458|f430|360|355|348|328|308|288|dino|testarossa|512|enzo|laferrari|f40|f50", "Mid"),
    ("^ferrari$", "812|roma|portofino|gtc4|ff|599|612|f12|550|575|456|california|mondial", "Front"),
    ("^lamborghini$", "huracan|aventador|gallardo|murcielago|diablo|countach", "Mid"),
    ("^lamborghini$", "urus", "Front"),
    ("^mclaren$", ".*", "Mid"),
    ("^bugatti$", ".*", "Mid"),
    ("^koenigsegg$", ".*", "Mid"),
    ("^pagani$", ".*", "Mid"),
    ("^chevrolet$", "corvette.*c8|corvette.*stingray.*202[0-9]|corvette.*z06.*202[0-9]", "Mid"),
    ("^chevrolet$", "corvette", "Front"),
    ("^(acura|honda)$", "nsx", "Mid"),
    ("^lotus$", "elise|exige|evora|emira|evija", "Mid"),
    ("^lotus$", "esprit", "Mid"),
    ("^alpine$", "a110", "Mid"),
    ("^audi$", "r8", "Mid"),
    ("^ford$", "^gt$|gt40", "Mid"),
    ("^de tomaso$", "pantera|mangusta", "Mid"),
    ("^tvr$", ".*", "Front"),
    ("^alfa romeo$", "4c|8c", "Mid"),
    ("^smart$", "fortwo|eq fortwo", "Rear"),
)
ASPIRATIONS = ((r"twin.?turbo|bi.?turbo|tt\b", "TC"), (r"turbo(?:charged)?|t\d+\b|tsi\b|tfsi\b|tdi\b", "TC"), (r"super.?charged?|kompressor|blown", "SC"), (r"naturally.?aspirated|na\b|n/a\b|atmospheric", "NA"))
DOORS = {"Coupe": 2, "Convertible": 2, "Roadster": 2, "Targa": 2, "Sedan": 4, "Wagon": 4, "Hatchback": 4, "SUV": 4, "Crossover": 4, "Truck": 4, "Van": 4}
SEATS = {"Coupe": 4, "Convertible": 4, "Roadster": 2, "Targa": 2, "Sedan": 5, "Wagon": 5, "Hatchback": 5, "SUV": 5, "Crossover": 5, "Truck": 5, "Van": 7}
TWO_SEATS = ("roadster|spider|spyder", "viper|corvette|miata|mx-5|z4|boxster|cayman|elise|exige", "f430|458|488|f8|296|sf90", "huracan|gallardo|aventador|murcielago", "gt-r|gtr|nsx|s2000", "mclaren|pagani|koenigsegg|bugatti", "^(?:sls|amg gt)", "r8 (?!sedan)")


def _text(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _pair(a: str, b: str, to_b, to_a):
    """Each of two columns filled from the other; zero counts as missing."""

    def run(df: DataFrame) -> DataFrame:
        x, y = name(a), name(b)
        return df.withColumns({a: F.when(filled(x), x).otherwise(F.when(filled(y), to_a(y)).otherwise(x)), b: F.when(filled(y), y).otherwise(F.when(filled(x), to_b(x)).otherwise(y))})

    return run


def default_propulsion(df: DataFrame) -> DataFrame:
    """General kinds become the usual specific ones."""
    p = F.col("propulsion")
    return df.withColumn("propulsion", F.when(p == "ICE", "Petrol").when(p.isin("Hybrid", "Plug-in Hybrid"), "Electric/Petrol").otherwise(p))


speeds = _pair("top_speed_mph", "top_speed_kmh", mph_to_kmh, kmh_to_mph)
powers = _pair("power_hp", "power_kw", hp_to_kw, kw_to_hp)
accelerations = _pair("0_60_mph_sec", "0_100_kmh_sec", lambda c: F.round(c * TO_0_100, 2), lambda c: F.round(c / TO_0_100, 2))


def engine_placement(df: DataFrame) -> DataFrame:
    now, maker, model = F.col("engine_placement"), F.trim(_text("manufacturer")), F.trim(_text("model"))
    rules = [(maker.rlike(a) & model.rlike(b), v) for a, b, v in PLACEMENTS]
    known = filled(F.col("engine_type")) & (F.coalesce("propulsion", F.lit("")) != "Electric")
    return df.withColumn("engine_placement", F.when(filled(now), now).otherwise(F.coalesce(first_match(rules), F.when(known, "Front"), now)))


def engine_aspiration(df: DataFrame) -> DataFrame:
    now = F.col("engine_aspiration")
    text = F.concat_ws(" ", _text("engine"), _text("engine_type"), _text("model"))
    rules = [(text.rlike(p), v) for p, v in ASPIRATIONS]
    plain = filled(F.col("engine_type")) & ~_text("engine_type").rlike("electric|motor")
    electric = F.coalesce("propulsion", F.lit("")) == "Electric"
    return df.withColumn("engine_aspiration", F.when(filled(now) | electric, now).otherwise(F.coalesce(first_match(rules), F.when(plain, "NA"), now)))


def doors(df: DataFrame) -> DataFrame:
    now = F.col("doors")
    return df.withColumn("doors", F.when(filled(now), now).otherwise(F.coalesce(mapped(F.col("body_style"), DOORS), now)))


def seats(df: DataFrame) -> DataFrame:
    now, two = F.col("seats"), reduce(lambda a, p: a | _text("model").rlike(p), TWO_SEATS, F.lit(False))
    return df.withColumn("seats", F.when(filled(now), now).otherwise(F.coalesce(F.when(two, 2), mapped(F.col("body_style"), SEATS), now)))


STEPS = (speeds, powers, accelerations, engine_placement, engine_aspiration, doors, seats)
#: The steps by name, with the columns that each may change.
COUNTED = {
    "speed_conversions": (speeds, ("top_speed_mph", "top_speed_kmh")),
    "power_conversions": (powers, ("power_hp", "power_kw")),
    "accel_conversions": (accelerations, ("0_60_mph_sec", "0_100_kmh_sec")),
    "engine_placement_inferred": (engine_placement, ("engine_placement",)),
    "aspiration_inferred": (engine_aspiration, ("engine_aspiration",)),
    "doors_inferred": (doors, ("doors",)),
    "seats_inferred": (seats, ("seats",)),
}


def enrich(df: DataFrame) -> DataFrame:
    """All steps, in their order, over a catalog-typed DataFrame; one projection after optimisation."""
    return reduce(lambda d, step: step(d), STEPS, df)
