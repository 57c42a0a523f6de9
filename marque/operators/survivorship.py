"""Merging records of one entity: survivorship in closed form, deduplication and upserts.

The rules are order-dependent (the first filled value wins), so each row carries its place
``seq`` and every merge is one aggregate of "first filled by seq": partial before the shuffle, one
row a key and task after it. No group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marque.functions.columns import filled, name
from marque.functions.text import car_id, model_key, without_prefix
from marque.operators.makers import Makers, country_of, normalize

# Fields that a merge fills.
FILLED = (
    "0_60_mph_sec", "0_100_kmh_sec", "0_100_mph_sec", "0_200_kmh_sec", "quarter_mile_sec", "quarter_mile_speed_mph",
    "top_speed_mph", "top_speed_kmh", "power_hp", "power_kw", "torque", "engine", "braking_70_0_ft", "braking_100_0_ft",
    "skidpad_g", "curb_weight_lb", "nurburgring_lap_sec", "nurburgring_date", "nurburgring_driver", "top_gear_lap_sec",
    "top_gear_episode", "lightning_lap_sec", "body_style", "doors", "seats", "engine_type", "engine_displacement",
    "engine_aspiration", "engine_placement", "drivetrain",
)


def first_filled(c: Column, order: Column) -> Column:
    """Aggregate: the first value, by order, that is neither null nor blank nor zero."""
    return F.min_by(F.when(filled(c), c), F.when(filled(c), order))


def _among(c: Column, values: tuple[str, ...], order: Column) -> Column:
    return F.min_by(F.when(c.isin(*values), c), F.when(c.isin(*values), order))


def merged_propulsion(c: Column, order: Column) -> Column:
    """Aggregate: the first propulsion, made specific by a later one (ICE by a fuel, a hybrid by its fuel)."""
    p = first_filled(c, order)
    return F.when(p == "ICE", F.coalesce(_among(c, ("Petrol", "Diesel"), order), p)).when(p.isin("Hybrid", "Plug-in Hybrid"), F.coalesce(_among(c, ("Electric/Petrol", "Electric/Diesel"), order), p)).otherwise(p)


def merged_sources(c: Column, order: Column) -> Column:
    """Aggregate: the distinct comma-separated sources in order of first mention."""
    parts = F.filter(F.transform(F.split(c, ","), lambda s: F.trim(s)), lambda s: s != "")
    lists = F.sort_array(F.collect_list(F.when(filled(c), F.struct(order.alias("o"), parts.alias("p")))))
    return F.array_join(F.array_distinct(F.flatten(F.transform(lists, lambda x: x["p"]))), ", ")


def _fold(rows: DataFrame, keys: list[str], order: Column, first: tuple[str, ...], extra: dict[str, Column] | None = None) -> DataFrame:
    """One row a key: filled fields, propulsion and sources merged, ``first`` from the first row."""
    has = set(rows.columns)
    agg = {c: F.min_by(name(c), order) for c in first if c in has} | {c: first_filled(name(c), order) for c in FILLED if c in has}
    if "propulsion" in has:
        agg["propulsion"] = merged_propulsion(F.col("propulsion"), order)
    if "sources" in has:
        agg["sources"] = merged_sources(F.col("sources"), order)
    return rows.groupBy(*[name(k) for k in keys]).agg(*[v.alias(k) for k, v in (agg | (extra or {})).items()])


def with_car_id(df: DataFrame, makers: Makers) -> DataFrame:
    """car_id computed anew from year, manufacturer (by its canonical name) and model (without the maker's name)."""
    df = df.withColumn("_m", normalize(F.col("manufacturer"), makers))
    return df.withColumn("car_id", car_id(F.col("year"), F.col("_m"), without_prefix(F.coalesce("model", F.lit("")), F.col("_m")))).drop("_m")


def deduplicate(df: DataFrame, makers: Makers, seq: str = "seq") -> DataFrame:
    """One row for each car_id: the row of the shortest model (then the first) stays, the others fill it in that order."""
    rows = with_car_id(df, makers).withColumn("_order", F.struct(F.length(F.coalesce("model", F.lit(""))).alias("n"), name(seq).alias("s")))
    out = _fold(rows, ["car_id"], F.col("_order"), ("country", "year", "manufacturer", "model"), {seq: F.min(name(seq))})
    return out.select(*[name(c) for c in df.columns if c in out.columns], *([] if "car_id" in df.columns else ["car_id"]))


def effective_year(rows: DataFrame, keys: tuple[str, ...], seq: str = "seq", existing: str = "existing") -> DataFrame:
    """rows with ``eff_year``: the year under which a row merges.

    A row without a year joins the year-less group of its key if there is one (an existing row without a
    year, or a first row without one), else the year of the key's first row. The key's facts are a
    small aggregate joined back, so a key with very many rows is split like any skewed join.
    """
    year = F.coalesce(F.col("year"), F.lit(""))
    facts = rows.groupBy(*keys).agg(F.max(name(existing) & (year == "")).alias("_blank"), F.min_by(year, name(seq)).alias("_first"))
    out = rows.join(facts, list(keys))
    eff = F.when(year != "", year).when(F.col("_blank") | (F.col("_first") == ""), "").otherwise(F.col("_first"))
    return out.withColumn("eff_year", eff).drop("_blank", "_first")


def keyed(df: DataFrame, makers: Makers, keep_parens: bool = False) -> DataFrame:
    """df with what merging compares: _mk, the manufacturer, and _md, the model."""
    df = df.withColumn("_m", normalize(F.col("manufacturer"), makers))
    return df.withColumns({"_mk": F.lower("_m"), "_md": model_key(without_prefix(F.coalesce("model", F.lit("")), F.col("_m")), keep_parens)}).drop("_m")


def merge(existing: DataFrame, new: DataFrame, makers: Makers, seq: str = "seq", keep_parens: bool = False) -> DataFrame:
    """New records merged into existing ones on (year, manufacturer, model), in order of seq after all existing.

    Both have catalog columns and seq. Existing values aren't overwritten; what is empty is
    filled; a new key makes a new row with the country of its manufacturer.
    """
    rows = existing.withColumn("existing", F.lit(True)).unionByName(new.withColumn("existing", F.lit(False)), allowMissingColumns=True)
    rows = keyed(rows, makers, keep_parens).withColumn("_o", F.struct((~F.col("existing")).alias("e"), name(seq).alias("s")))
    rows = effective_year(rows, ("_mk", "_md"), "_o")
    out = _fold(rows, ["eff_year", "_mk", "_md"], F.col("_o"), ("country", "manufacturer", "model"), {"year": first_filled(F.col("year"), F.col("_o")), seq: F.min("_o"), "existing": F.max("existing")})
    out = out.withColumn("country", F.when(filled(F.col("country")) | F.col("existing"), F.col("country")).otherwise(F.nullif(country_of(F.col("manufacturer"), makers), F.lit(""))))
    return out.withColumn(seq, F.col(f"{seq}.s")).drop("eff_year", "_mk", "_md", "existing")


def merge_filling_year(existing: DataFrame, new: DataFrame, makers: Makers, seq: str = "seq") -> DataFrame:
    """The tolerant variant: a new row with a year also matches an existing row of its key without one, and fills the year."""
    old, fresh = keyed(existing, makers), keyed(new, makers)
    blank = old.groupBy("_mk", "_md").agg(F.max(F.coalesce("year", F.lit("")) == "").alias("_blank"))
    dated = fresh.where(filled(F.col("year"))).groupBy("_mk", "_md").agg(F.min_by("year", name(seq)).alias("_year"))
    fill = blank.where("_blank").join(dated, ["_mk", "_md"]).select("_mk", "_md", "_year")
    old = old.join(fill, ["_mk", "_md"], "left").withColumn("year", F.when(filled(F.col("year")), F.col("year")).otherwise(F.coalesce("_year", "year"))).drop("_mk", "_md", "_year")
    return merge(old, new, makers, seq)


def merge_plain(existing: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """The simple variant: equal manufacturer and model, empty fields filled, sources appended."""
    rows = existing.withColumn("_e", F.lit(0)).unionByName(new.withColumn("_e", F.lit(1)), allowMissingColumns=True).withColumn("_o", F.struct("_e", name(seq).alias("s")))
    out = _fold(rows, ["manufacturer", "model"], F.col("_o"), ("car_id", "country"), {"year": first_filled(F.col("year"), F.col("_o")), seq: F.min("_o.s")})
    return out.select(*[name(c) for c in existing.columns if c in out.columns])


def merge_first(existing: DataFrame, new: DataFrame, makers: Makers, seq: str = "seq") -> DataFrame:
    """The scraped pages' variant: equal manufacturer and model; of existing rows of one name the first stays, others go.

    Empty fields are filled in order. A source is appended after a comma unless the text of sources holds it already,
    be it within another name. A new name gets its maker's country. Null names count as blank.
    """
    keys = {"_m": F.coalesce("manufacturer", F.lit("")), "_n": F.coalesce("model", F.lit(""))}
    old = existing.withColumns(keys).groupBy("_m", "_n").agg(F.min_by(F.struct(*[name(c) for c in existing.columns]), name(seq)).alias("r")).select("r.*")
    rows = old.withColumn("_e", F.lit(0)).unionByName(new.withColumn("_e", F.lit(1)), allowMissingColumns=True)
    rows = rows.withColumns(keys).withColumn("_o", F.struct("_e", name(seq).alias("s")))
    agg = {c: first_filled(name(c), F.col("_o")) for c in rows.columns if c in FILLED or c in ("year", "propulsion", "car_id", "country")}
    agg |= {c: F.min_by(name(c), F.col("_o")) for c in ("manufacturer", "model")} | {"_base": F.min_by("sources", F.when(F.col("_e") == 0, F.col("_o")))} | {seq: F.min("_o.s"), "_known": F.min("_e") == 0}
    out = rows.groupBy("_m", "_n").agg(*[v.alias(c) for c, v in agg.items()])
    # Each source of a name once, at its first place, so that what is gathered grows with the sources and not the rows.
    told = rows.where((F.col("_e") == 1) & filled(F.col("sources"))).groupBy("_m", "_n", "sources").agg(F.min("_o.s").alias("s"))
    told = told.groupBy("_m", "_n").agg(F.sort_array(F.collect_list(F.struct("s", "sources"))).alias("told"))
    out = out.join(told, ["_m", "_n"], "left")
    text = F.aggregate(F.coalesce("told", F.array().cast(told.schema["told"].dataType)), F.coalesce("_base", F.lit("")), lambda a, x: F.when(F.contains(a, x["sources"]), a).when(a == "", x["sources"]).otherwise(F.concat(a, F.lit(","), x["sources"])))
    out = out.withColumn("sources", F.nullif(text, F.lit("")))
    if "country" in out.columns:
        out = out.withColumn("country", F.when(F.col("_known"), F.col("country")).otherwise(F.nullif(country_of(F.col("manufacturer"), makers), F.lit(""))))
    return out.select(*[name(c) for c in existing.columns if c in out.columns])


def catalog_order(df: DataFrame) -> DataFrame:
    return df.orderBy("manufacturer", "model", "year", "car_id")
