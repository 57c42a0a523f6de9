"""Categories derived from text: ordered rules, the first that matches decides."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from marque.functions.columns import first_match

# Patterns and maps, in order.
DIESEL = r"\b(?:diesel|tdi|cdi|hdi|jtd|dci)\b"
ELECTRIC = r"\b(?:electric|bev|ev|battery|permanent.?magnet|ac.?motor|dc.?motor|induction.?motor)\b"
HYBRID = r"\b(?:hybrid|phev|plug.?in)\b"
ENGINE_PARTS = r"\b(?:engine|cylinder|turbo|v\d+|inline)\b"
COMBUSTION = r"\b(?:cylinder|turbo|supercharge|v\d+|inline|flat|rotary|\d+\.\d+\s*l)\b"
ENGINE_CONFIGS = (
    (r"\bW-?16\b", "W16"), (r"\bW-?12\b", "W12"), (r"\bV-?12\b", "V12"), (r"\bV-?10\b", "V10"), (r"\bV-?8\b", "V8"), (r"\bV-?6\b", "V6"),
    (r"\bflat-?6\b", "H6"), (r"\bflat-?four\b", "H4"), (r"\bflat-?4\b", "H4"), (r"\binline-?6\b", "I6"), (r"\binline-?5\b", "I5"),
    (r"\binline-?4\b", "I4"), (r"\binline-?3\b", "I3"), (r"\b4-in-line\b", "I4"), (r"\b3-in-line\b", "I3"), (r"\brotary\b", "Rotary"),
)
BODY_WORDS = tuple((rf"\b{w}\b", s) for w, s in (("sedan", "Sedan"), ("coupe", "Coupe"), ("convertible", "Convertible"), ("roadster", "Roadster"), ("targa", "Targa"), ("wagon", "Wagon"), ("hatchback", "Hatchback"), ("suv", "SUV"), ("crossover", "Crossover"), ("van", "Van"), ("truck", "Truck"), ("pickup", "Truck")))
BODY_NAMES = {"sedan": "Sedan", "coupe": "Coupe", "convertible": "Convertible", "roadster": "Roadster", "targa": "Targa", "wagon": "Wagon", "station wagon": "Wagon", "hatchback": "Hatchback", "suv": "SUV", "crossover": "Crossover", "van": "Van", "minivan": "Van", "truck": "Truck", "pickup": "Truck"}
PLACEMENT_WORDS = (("mid-(?:engine|motor)", "Mid"), ("rear-(?:engine|motor)", "Rear"), ("front-(?:engine|motor)", "Front"))
DRIVE_WORDS = (("all-wheel-drive", "AWD"), ("(?:4|four)-wheel-drive", "4WD"), ("rear-wheel-drive", "RWD"), ("front-wheel-drive", "FWD"))
CYLINDERS = {3: "I3", 4: "I4", 5: "I5", 6: "V6", 8: "V8", 10: "V10", 12: "V12", 16: "W16"}


def mapped(c: Column, table: Mapping) -> Column:
    """table[c], or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def by_pattern(c: Column, rules: tuple[tuple[str, str], ...], default: str | None = None) -> Column:
    return first_match([(c.rlike("(?i)" + p), v) for p, v in rules], default)


def propulsion(engine: Column, model: Column | None = None, fuel: Column | None = None) -> Column:
    """Electric, Electric/Petrol, Electric/Diesel, Petrol, Diesel, or blank if the text doesn't tell."""
    blank = F.lit("")
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, blank) if c is not None else blank for c in (engine, model, fuel)]))
    diesel, electric, hybrid = (text.rlike(p) for p in (DIESEL, ELECTRIC, HYBRID))
    both = F.when(diesel, "Electric/Diesel").otherwise("Electric/Petrol")
    return F.when(electric & (hybrid | text.rlike(ENGINE_PARTS)), both).when(electric, "Electric").when(hybrid, both).when(text.rlike(COMBUSTION), F.when(diesel, "Diesel").otherwise("Petrol")).otherwise("")


def review_propulsion(fuel: Column, engine: Column, model: Column) -> Column:
    """From a fuel type where it's a known one, else from the engine and model."""
    f = F.lower(F.trim(fuel))
    text = F.lower(F.concat_ws(" ", model, engine))
    plug = text.rlike("plug-in") | F.lower(F.coalesce(model, F.lit(""))).rlike("phev")
    return F.when(f == "electric", "Electric").when(f == "hybrid", F.when(plug, "Plug-in Hybrid").otherwise("Hybrid")).when(f.isin("gas", "diesel", "gasoline"), "ICE").otherwise(propulsion(engine, model))


def fuel_propulsion(fuel: Column) -> Column:
    f = F.lower(F.coalesce(fuel, F.lit("")))
    return by_pattern(f, (("electric", "Electric"), ("diesel", "Diesel"), ("gasoline|regular|premium", "Petrol")), "")


def engine_propulsion(engine: Column) -> Column:
    e = F.lower(F.coalesce(engine, F.lit("")))
    diesel = F.contains(e, F.lit("diesel"))
    return F.when(F.contains(e, F.lit("electric")), "Electric").when(F.contains(e, F.lit("hybrid")), F.when(diesel, "Electric/Diesel").otherwise("Electric/Petrol")).when(diesel, "Diesel").when(e.rlike("gas|petrol"), "Petrol").otherwise("")


def engine_config(engine: Column, drive: Column) -> Column:
    e = F.nullif(engine, F.lit(""))
    return F.when(e.isNotNull() & (drive == "Electric"), "Electric").otherwise(by_pattern(e, ENGINE_CONFIGS))


def aspiration(engine: Column, drive: Column) -> Column:
    e = F.nullif(engine, F.lit(""))
    known = e.rlike("(?i)" + "|".join(p for p, _ in ENGINE_CONFIGS))
    return F.when(F.coalesce(drive, F.lit("")) != "Electric", F.when(e.rlike("(?i)turbo"), "TC").when(e.rlike("(?i)supercharged"), "SC").when(known, "NA"))
