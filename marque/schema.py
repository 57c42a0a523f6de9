"""The catalog's columns: one declarative table, and what is derived from it."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # string, numeric or integer
    category: str
    header: str
    unit: str | None = None
    low: float | None = None
    high: float | None = None
    enum: tuple[str, ...] | None = None
    pattern: str | None = None
    required: bool = False
    visible: bool = False


def _text(name, category, header, **more):
    return Field(name, "string", category, header, **more)


def _real(name, category, header, unit, low, high, **more):
    return Field(name, "numeric", category, header, unit, low, high, **more)


_STYLES = ("Sedan", "Coupe", "Convertible", "Wagon", "Hatchback", "SUV", "Crossover", "Truck", "Van", "Roadster", "Targa")

# Names, order, units and bounds of the catalog's columns.
FIELDS: tuple[Field, ...] = (
    _text("car_id", "Meta", "Car ID", required=True),
    _text("country", "General", "Country", visible=True),
    _text("year", "General", "Year", pattern=r"^(19|20)\d{2}$", visible=True),
    _text("manufacturer", "General", "Manufacturer", required=True, visible=True),
    _text("model", "General", "Model", required=True, visible=True),
    _text("body_style", "General", "Body Style", enum=_STYLES, visible=True),
    Field("doors", "integer", "Specs", "Doors", None, 1, 6),
    Field("seats", "integer", "Specs", "Seats", None, 1, 12),
    _text("propulsion", "General", "Propulsion", enum=("ICE", "Electric", "Hybrid", "Plug-in Hybrid"), visible=True),
    _text("engine_type", "Specs", "Engine Type", visible=True),
    _real("engine_displacement", "Specs", "Displacement", "liters", 0.5, 10.0, visible=True),
    _text("engine_aspiration", "Specs", "Aspiration", enum=("TC", "SC", "NA"), visible=True),
    _text("engine_placement", "Specs", "Engine Placement", enum=("Front", "Mid", "Rear"), visible=True),
    _text("drivetrain", "Specs", "Drivetrain", enum=("FWD", "RWD", "AWD", "4WD"), visible=True),
    _real("power_hp", "Power", "Power", "hp", 50, 3000, visible=True),
    _real("power_kw", "Power", "Power (kW)", "kW", 37, 2240),
    _text("torque", "Power", "Torque", unit="lb-ft", visible=True),
    _real("curb_weight_lb", "Specs", "Curb Weight", "lb", 1000, 10000, visible=True),
    _real("0_60_mph_sec", "Acceleration", "0-60 mph", "seconds", 1, 30, visible=True),
    _real("0_100_kmh_sec", "Acceleration", "0-100 km/h", "seconds", 1, 30),
    _real("0_100_mph_sec", "Acceleration", "0-100 mph", "seconds", 3, 60),
    _real("0_200_kmh_sec", "Acceleration", "0-200 km/h", "seconds", 5, 120),
    _real("quarter_mile_sec", "Acceleration", "1/4 Mile", "seconds", 7, 25, visible=True),
    _real("quarter_mile_speed_mph", "Acceleration", "1/4 Mile Speed", "mph", 50, 250),
    _real("top_speed_mph", "Speed", "Top Speed", "mph", 50, 350, visible=True),
    _real("top_speed_kmh", "Speed", "Top Speed (km/h)", "km/h", 80, 560),
    _real("braking_70_0_ft", "Braking", "70-0 Braking", "ft", 100, 300),
    _real("braking_100_0_ft", "Braking", "100-0 Braking", "ft", 200, 500),
    _real("skidpad_g", "Handling", "Skidpad", "g", 0.5, 1.5),
    _text("engine", "Specs", "Engine"),
    _real("nurburgring_lap_sec", "Lap Times", "Nürburgring Lap", "seconds", 300, 900),
    _text("nurburgring_date", "Lap Times", "Nürburgring Date"),
    _text("nurburgring_driver", "Lap Times", "Nürburgring Driver"),
    _real("top_gear_lap_sec", "Lap Times", "Top Gear Lap", "seconds", 60, 180),
    _text("top_gear_episode", "Lap Times", "Top Gear Episode"),
    _real("lightning_lap_sec", "Lap Times", "Lightning Lap", "seconds", 150, 300),
    _text("sources", "Meta", "Sources", visible=True),
)

BY_NAME = {f.name: f for f in FIELDS}
COLUMNS = tuple(f.name for f in FIELDS)
NUMERIC = tuple(f.name for f in FIELDS if f.kind == "numeric")
VISIBLE = tuple(f.name for f in FIELDS if f.visible)
_TYPES = {"string": T.StringType(), "numeric": T.DoubleType(), "integer": T.IntegerType()}


def catalog_type() -> T.StructType:
    """The catalog's StructType; each field carries its unit, bounds and the like as metadata."""
    return T.StructType([T.StructField(f.name, _TYPES[f.kind], True, {k: v for k, v in {"unit": f.unit, "min": f.low, "max": f.high, "enum": list(f.enum) if f.enum else None, "pattern": f.pattern, "category": f.category, "header": f.header, "required": f.required}.items() if v is not None}) for f in FIELDS])


def columns_by_category() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for f in FIELDS:
        out.setdefault(f.category, []).append(f.name)
    return out


def schema_df(spark: SparkSession) -> DataFrame:
    """The columns as rows (A22, A26)."""
    rows = [(i, f.name, f.kind, f.category, f.header, f.unit, f.low and float(f.low), f.high and float(f.high), list(f.enum) if f.enum else None, f.pattern, f.required, f.visible) for i, f in enumerate(FIELDS)]
    return spark.createDataFrame(rows, "position int, name string, kind string, category string, header string, unit string, min double, max double, enum array<string>, pattern string, required boolean, visible boolean")


def conform(df: DataFrame, *more: Column) -> DataFrame:
    """df in the catalog's columns, order and types; missing ones null, blanks null, bad numbers null, others dropped but more."""
    has = set(df.columns)
    return df.select(*[_cast(F.col(f"`{f.name}`") if f.name in has else F.lit(None).cast("string"), f).alias(f.name) for f in FIELDS], *more)


def _cast(c: Column, f: Field) -> Column:
    if f.kind == "string":
        return F.nullif(c.cast("string"), F.lit(""))
    text = F.nullif(F.trim(c.cast("string")), F.lit(""))
    return text.try_cast("double") if f.kind == "numeric" else text.try_cast("double").cast("int")


def type_definitions(country_names: Mapping[str, str] | None = None) -> str:
    """The catalog's types as a TypeScript module: the row, the columns' metadata, the categories and countries."""
    key = lambda c: json.dumps(c) if c[0].isdigit() or "-" in c else c
    row = "".join(f"  {key(f.name)}: {'string' if f.kind == 'string' else 'number'} | null;\n" for f in FIELDS)
    about = [{"id": f.name, "header": f.header, "category": f.category, "unit": f.unit, "isNumeric": f.kind != "string", "visible": f.visible} for f in FIELDS]
    parts = {"COLUMNS": about, "CATEGORIES": columns_by_category(), "COUNTRY_NAMES": dict(country_names or {})}
    return f"export interface CatalogRow {{\n{row}}}\n" + "".join(f"\nexport const {k} = {json.dumps(v, ensure_ascii=False, indent=2)} as const;\n" for k, v in parts.items())


def column_definitions(df: DataFrame) -> DataFrame:
    """(name, definition, filled, outside): the catalog's columns in df as members of the row type, by one aggregate.

    A column is nullable in the definition where the table has a row without a value; outside counts what its bounds exclude.
    """
    has = set(df.columns)
    own = [f for f in FIELDS if f.name in has]
    figures = []
    for i, f in enumerate(own):
        c = F.col(f"`{f.name}`")
        outside = F.lit(False) if f.kind == "string" else F.coalesce((c < f.low) if f.low is not None else F.lit(False), F.lit(False)) | F.coalesce((c > f.high) if f.high is not None else F.lit(False), F.lit(False))
        figures += [F.count(c).alias(f"n{i}"), F.count_if(outside).alias(f"o{i}")]
    if not own:
        return df.sparkSession.createDataFrame([], "name string, definition string, filled long, outside long")
    key = lambda c: json.dumps(c) if c[0].isdigit() or "-" in c else c
    kind = lambda f: "string" if f.kind == "string" else "number"
    cells = [F.struct(F.lit(f.name).alias("name"), F.concat(F.lit(f"{key(f.name)}: {kind(f)}"), F.when(F.col(f"n{i}") < F.col("n"), F.lit(" | null;")).otherwise(F.lit(";"))).alias("definition"), F.col(f"n{i}").alias("filled"), F.col(f"o{i}").alias("outside")) for i, f in enumerate(own)]
    return df.agg(F.count("*").alias("n"), *figures).select(F.inline(F.array(*cells)))
