"""Repairs of misplaced, implausible and inconsistent values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marque.functions.classify import mapped
from marque.functions.columns import filled, first_match, name
from marque.functions.text import title_case

# Keywords of body styles in model names (plain substrings, in order), source labels, names in capitals.
BODY_KEYWORDS = {
    "Convertible": ("convertible", "cabriolet", "cabrio", "roadster", "spyder", "spider"),
    "Coupe": ("coupe", "coupé"),
    "Wagon": ("wagon", "estate", "avant", "touring", "sportwagen", "allroad", "outback"),
    "Hatchback": ("hatchback", "hatch", "sportback", "liftback"),
    "SUV": ("suv",),
    "Crossover": ("crossover",),
    "Truck": ("truck", "pickup"),
    "Van": ("van", "minivan"),
    "Targa": ("targa",),
    "Sedan": ("sedan", "saloon"),
}
SOURCE_LABELS = ((r"Wikipedia\s*-\s*.*", "Wikipedia"), (r"Car & Driver\s*-\s*Lightning\s*Lap", "Car & Driver"), (r"Car\s*&\s*Driver\s*-\s*.*", "Car & Driver"), (r"EPA\s*-\s*Fuel\s*Economy", "EPA"), (r"EPA\s*-\s*.*", "EPA"), (r"Kaggle\s*-\s*Car\s*Specifications", "Kaggle"), (r"Kaggle\s*-\s*.*", "Kaggle"))
KEEP_CAPS = ("BMW", "AMG", "GMC", "MG", "TVR", "AC")
CAPS = {
    **{n.upper(): n for n in ("Aston Martin", "Alfa Romeo", "Audi", "Bentley", "BMW", "Bugatti", "Cadillac", "Chevrolet", "Chrysler", "Dodge", "Ferrari", "Fiat", "Ford", "GMC", "Honda", "Hyundai", "Infiniti", "Jaguar", "Jeep", "Kia", "Lamborghini", "Land Rover", "Lexus", "Lincoln", "Lotus", "Maserati", "Mazda", "McLaren", "Mini", "Mitsubishi", "Nissan", "Opel", "Peugeot", "Porsche", "Ram", "Renault", "Subaru", "Suzuki", "Toyota", "Vauxhall", "Volkswagen", "Volvo")},
    **{n: "Mercedes-Benz" for n in ("MERCEDES", "MERCEDES BENZ", "MERCEDES-BENZ")},
    **{n: "Rolls-Royce" for n in ("ROLLS ROYCE", "ROLLS-ROYCE")},
}
CAPS_PREFIXES = ("ASTON MARTIN", "ALFA ROMEO", "LAND ROVER", "MERCEDES BENZ", "MERCEDES-BENZ", "ROLLS ROYCE", "ROLLS-ROYCE")
_YEAR = r"(?:19|20)\d{2}"


def accelerations(df: DataFrame) -> DataFrame:
    """An implausible 0-60 time for the quarter mile is cleared."""
    a, q = name("0_60_mph_sec"), name("quarter_mile_sec")
    bad = (q <= a) | ((a < 2.0) & (q > 10.0)) | ((a < 4.0) & (q > 14.0)) | ((a < 6.0) & (q > 18.0))
    return df.withColumn("0_60_mph_sec", F.when(F.coalesce(bad, F.lit(False)), None).otherwise(a))


def _leading_year(column: str, pattern: str):
    """A year in front of a name moves to the year column, if that is blank or says the same."""

    def run(df: DataFrame) -> DataFrame:
        c, year = F.col(column), F.coalesce("year", F.lit(""))
        found = F.regexp_extract(c, pattern, 1)
        use = (found != "") & ((year == "") | (year == found))
        return df.withColumns({"year": F.when(use, found).otherwise(F.col("year")), column: F.when(use, F.trim(F.regexp_extract(c, pattern, 2))).otherwise(c)})

    return run


year_in_manufacturer = _leading_year("manufacturer", rf"^({_YEAR})\s*(.+)$")
year_in_model = _leading_year("model", rf"^({_YEAR})\s+(.+)$")


def year_range_in_model(df: DataFrame) -> DataFrame:
    """A range of years after the model is cut; its first year fills a blank one."""
    m = F.col("model")
    pattern = rf"(?i)\s+({_YEAR})[-–](?:{_YEAR}|Present)$"
    start = F.regexp_extract(m, pattern, 1)
    return df.withColumns({"year": F.when((start != "") & ~filled(F.col("year")), start).otherwise(F.col("year")), "model": F.when(start != "", F.trim(F.regexp_replace(m, pattern, ""))).otherwise(m)})


def model_in_manufacturer(df: DataFrame) -> DataFrame:
    """Where the model is but a range of years, the model is taken from behind a known manufacturer's name."""
    maker, model = F.col("manufacturer"), F.col("model")
    start = F.regexp_extract(model, rf"(?i)^({_YEAR})[-–](?:{_YEAR}|Present)$", 1)
    names = sorted(CAPS, key=len, reverse=True)
    known = F.regexp_extract(F.upper(maker), f"^({'|'.join(names)}) ", 1)
    rest = F.trim(F.substr(maker, F.length(known) + 1))
    use = (start != "") & (known != "") & (rest != "")
    return df.withColumns({"year": F.when(use & ~filled(F.col("year")), start).otherwise(F.col("year")), "manufacturer": F.when(use, mapped(known, CAPS)).otherwise(maker), "model": F.when(use, rest).otherwise(model)})


def manufacturer_case(df: DataFrame) -> DataFrame:
    """Names in capitals get their usual case; long ones are cut to a known manufacturer."""
    c = F.col("manufacturer")
    caps = c.rlike(r"^[A-Z0-9\s\-]+$") & ~c.isin(*KEEP_CAPS)
    known = [(F.startswith(c, F.lit(n)), CAPS[n]) for n in CAPS_PREFIXES]
    title = F.when(F.contains(c, F.lit("-")), F.replace(title_case(F.replace(title_case(c), F.lit("-"), F.lit(" "))), F.lit(" "), F.lit("-"))).otherwise(title_case(c))
    long = F.size(F.split(F.trim(c), r"\s+")) > 3
    return df.withColumn("manufacturer", F.when(caps, F.coalesce(F.when(long, first_match(known)), title)).otherwise(c))


def detected_body(model: Column) -> Column:
    m = F.lower(model)
    return first_match([(reduce(lambda a, k: a | F.contains(m, F.lit(k)), ks, F.lit(False)), s) for s, ks in BODY_KEYWORDS.items()])


def body_style(df: DataFrame) -> DataFrame:
    """A body style named by the model fills or replaces the given one."""
    return df.withColumn("body_style", F.coalesce(detected_body(F.col("model")), F.col("body_style")))


def _body_style(when_filled: bool):
    """The rows of body_style whose value was, or wasn't, filled before."""

    def run(df: DataFrame) -> DataFrame:
        now = F.col("body_style")
        return df.withColumn("body_style", F.when(filled(now) == F.lit(when_filled), F.coalesce(detected_body(F.col("model")), now)).otherwise(now))

    return run


def source_label(c: Column) -> Column:
    return F.coalesce(first_match([(c.rlike("(?i)^" + p), v) for p, v in SOURCE_LABELS]), c)


def sources(df: DataFrame) -> DataFrame:
    """Short labels, each once, in order."""
    c = F.col("sources")
    parts = F.filter(F.transform(F.split(c, ","), lambda s: source_label(F.trim(s))), lambda s: s != "")
    return df.withColumn("sources", F.when(filled(c), F.array_join(F.array_distinct(parts), ", ")).otherwise(c))


STEPS = (year_in_manufacturer, year_in_model, year_range_in_model, model_in_manufacturer, manufacturer_case, body_style, accelerations, sources)
#: The steps by name, with the columns that each may change; body styles in two, those filled and those replaced.
COUNTED = {
    "year_extracted_from_manufacturer": (year_in_manufacturer, ("year", "manufacturer")),
    "year_extracted_from_model": (year_in_model, ("year", "model")),
    "year_range_cleaned": (year_range_in_model, ("year", "model")),
    "model_extracted_from_manufacturer": (model_in_manufacturer, ("year", "manufacturer", "model")),
    "manufacturer_case_normalized": (manufacturer_case, ("manufacturer",)),
    "body_style_inferred": (_body_style(False), ("body_style",)),
    "body_style_corrected": (_body_style(True), ("body_style",)),
    "implausible_0_60_cleared": (accelerations, ("0_60_mph_sec",)),
    "sources_normalized": (sources, ("sources",)),
}


def clean(df: DataFrame) -> DataFrame:
    return reduce(lambda d, step: step(d), STEPS, df)
