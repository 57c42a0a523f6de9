"""Numbers with units out of free text, as Column expressions. Rounding is half up on the decimal value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marque.functions.columns import group, let
from marque.functions.text import clean_text

# Conversion factors (the pairs aren't exact inverses).
MPH_TO_KMH, KMH_TO_MPH = 1.60934, 0.621371
HP_TO_KW, KW_TO_HP = 0.7457, 1.341
PS_TO_HP, HP_TO_PS = 0.9863, 1.0139
TO_0_100 = 1.036
IN3_TO_L, KG_TO_LB, NM_TO_LBFT = 0.0163871, 2.20462, 0.737562
_NUMBER, _GROUPED = r"(\d+(?:\.\d+)?)", r"(\d[\d,]*(?:\.\d+)?)"


def _double(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("double")


def _first(c: Column, unit: str, number: str = _NUMBER) -> Column:
    return _double(group(c, rf"(?i){number}\s*{unit}"))


def times(c: Column, factor: float, digits: int = 1) -> Column:
    return F.round(c * F.lit(factor), digits)


def mph_to_kmh(c: Column) -> Column:
    return times(c, MPH_TO_KMH)


def kmh_to_mph(c: Column) -> Column:
    return times(c, KMH_TO_MPH)


def hp_to_kw(c: Column) -> Column:
    return times(c, HP_TO_KW)


def kw_to_hp(c: Column) -> Column:
    return times(c, KW_TO_HP)


def parse_time(c: Column) -> Column:
    """Seconds of ``m:ss(.f)``, or else of the first number."""
    def parse(t: Column) -> Column:
        clock = r"(\d+):(\d{1,2})(?:\.(\d+))?"
        seconds = group(t, clock, 1).try_cast("double") * 60 + group(t, clock, 2).try_cast("double")
        part = F.coalesce(F.concat(F.lit("0."), F.nullif(group(t, clock, 3), F.lit(""))).try_cast("double"), F.lit(0.0))
        return F.round(F.coalesce(seconds + part, group(t, _NUMBER).try_cast("double")), 3)

    return let(clean_text(c), parse)


def parse_speed(c: Column) -> Column:
    """Struct (mph, kmh): each as given, or from the other; a bare number is mph."""
    def parse(t: Column) -> Column:
        mph, kmh = _first(t, "mph"), _first(t, "(?:km/?h|kph)")
        bare = F.when(mph.isNull() & kmh.isNull(), group(t, _NUMBER).try_cast("double"))
        mph = F.coalesce(mph, bare)
        return F.struct(F.coalesce(mph, kmh_to_mph(kmh)).alias("mph"), F.coalesce(kmh, mph_to_kmh(mph)).alias("kmh"))

    return let(clean_text(c), parse)


def parse_power(c: Column) -> Column:
    """Struct (hp, kw): hp (or bhp), else PS, else from kW; a bare number is hp."""
    def parse(t: Column) -> Column:
        hp, kw, ps = _first(t, "(?:hp|bhp)", _GROUPED), _first(t, "kw", _GROUPED), _first(t, "ps", _GROUPED)
        hp = F.coalesce(hp, times(ps, PS_TO_HP))
        bare = F.when(hp.isNull() & kw.isNull(), _double(group(t, _GROUPED)))
        hp = F.coalesce(hp, bare)
        return F.struct(F.coalesce(hp, kw_to_hp(kw)).alias("hp"), F.coalesce(kw, hp_to_kw(hp)).alias("kw"))

    return let(clean_text(c), parse)


def strict_time(c: Column) -> Column:
    """Seconds of ``m:ss(.f)``, or of a number that the text begins with; null for DNF, DNS and other text."""
    def parse(t: Column) -> Column:
        clock = r"(\d+):(\d+(?:\.\d+)?)"
        seconds = group(t, clock, 1).try_cast("double") * 60 + group(t, clock, 2).try_cast("double")
        return F.coalesce(seconds, group(t, r"^(\d+(?:\.\d+)?)").try_cast("double"))

    return let(clean_text(c), parse)


def comma_speed(c: Column) -> Column:
    """Struct (mph, kmh): numbers with decimal commas or points; the missing one from the other by one factor."""
    def parse(t: Column) -> Column:
        number = lambda unit: F.replace(group(t, rf"(?i)(\d+(?:[.,]\d+)?)\s*{unit}"), F.lit(","), F.lit(".")).try_cast("double")
        mph, kmh = number("(?:mph|mi/?h)"), number("(?:km/?h|kph|kmh)")
        return F.struct(F.coalesce(mph, F.round(kmh / MPH_TO_KMH, 1)).alias("mph"), F.coalesce(kmh, mph_to_kmh(mph)).alias("kmh"))

    return let(clean_text(c), parse)


def exact_power(c: Column) -> Column:
    """Struct (hp, kw): hp, else PS; the missing one from the other by one factor; a bare number says nothing."""
    def parse(t: Column) -> Column:
        kw, hp, ps = _first(t, "kw", _GROUPED), _first(t, "(?:hp|bhp)", _GROUPED), _double(group(t, rf"{_GROUPED}\s*PS"))
        hp = F.coalesce(hp, times(ps, PS_TO_HP))
        return F.struct(F.coalesce(hp, F.round(kw / HP_TO_KW, 1)).alias("hp"), F.coalesce(kw, hp_to_kw(hp)).alias("kw"))

    return let(clean_text(c), parse)


def parse_float(c: Column) -> Column:
    """A number without thousands commas and unit; else the first number in the text; null for placeholders."""
    def parse(bare: Column) -> Column:
        plain = F.when(bare.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(bare).try_cast("double"))
        return F.coalesce(plain, group(bare, _NUMBER).try_cast("double"))

    none = c.isNull() | F.lower(F.trim(c)).isin("", "n/a", "-", "—")
    bare = F.regexp_replace(F.regexp_replace(clean_text(c), ",", ""), r"(?i)\s*(sec|s|mph|km/?h|hp|kw|ft|lb|g)s?\.?$", "")
    return F.when(~none, let(bare, parse))


def lenient_float(c: Column) -> Column:
    """The first word without anything but digits, points and signs."""
    return F.nullif(F.regexp_replace(F.split_part(F.trim(c), F.lit(" "), F.lit(1)), r"[^\d.-]", ""), F.lit("")).try_cast("double")


def leading_number(c: Column) -> Column:
    """The number that the text begins with."""
    return F.nullif(F.regexp_extract(c, r"^\s*[+-]?\d+\.?\d*", 0), F.lit("")).try_cast("double")


def spec_speed(c: Column) -> Column:
    return F.struct(_first(c, "mph").alias("mph"), _first(c, "km/?h").alias("kmh"))


def spec_power(c: Column) -> Column:
    return F.struct(_first(c, "(?:hp|bhp)").alias("hp"), _first(c, "kw").alias("kw"))


def spec_seconds(c: Column) -> Column:
    return _first(c, "s")


def spec_pounds(c: Column) -> Column:
    return _first(c, "lbs?")


def torque_text(lbft: Column) -> Column:
    """A torque as the catalog stores it."""
    return F.when(lbft.isNotNull(), F.concat(F.format_string("%.0f", lbft), F.lit(" lb-ft")))


def spec_torque(c: Column) -> Column:
    return torque_text(_first(c, "lb-ft"))


def litres_from_in3(c: Column) -> Column:
    return F.when(c > 0, F.round(c * IN3_TO_L, 1))


def litres_from_cm3(c: Column) -> Column:
    return F.when(c > 0, F.round(c / 1000, 1))


def litres(c: Column) -> Column:
    return F.when(c > 0, F.round(c, 1))


def lap_time(seconds: Column, digits: int = 2) -> Column:
    """``m:ss.ff`` from a minute on, else seconds; null stays null."""
    minutes = F.floor(seconds / 60)
    rest = seconds % 60
    return F.when(minutes > 0, F.format_string(f"%d:%0{3 + digits}.{digits}f", minutes, rest)).when(seconds.isNotNull(), F.format_string(f"%.{digits}f", rest))


def shown(c: Column, digits: int = 0, unit: str = "") -> Column:
    """A number with thousands separators and unit, or a dash."""
    return F.coalesce(F.concat(F.format_number(c, digits), F.lit(f" {unit}" if unit else "")), F.lit("—"))
