"""Queries that run the catalog's enrichment, cleaning, validation, merging and listing over tables, with SQL that states the rules anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marque.functions.columns import name
from marque.operators import catalog_query as cq
from marque.operators import clean, column_filters, enrich, quality_report, survivorship, validate
from marque.plans.case_queries import MAKERS, _by_row, case_query, raw, wanted
from marque.plans.driver_queries import _C, CATALOG_SQL, KEY, QUERIES, SQL, catalog, table
from marque.schema import BY_NAME, COLUMNS, column_definitions, columns_by_category, schema_df
from marque.session import cut

_KEYS = ", ".join(KEY)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return put


# --- Enrichment (I0, I-E2 to I-E7, D17) ---


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, k = F.col("p_size").cast("double"), F.col("p_partkey") % 4
    some = lambda c, *ks: F.when(k.isin(*ks), c)
    return table(spark, sf_dir, "part").select("p_partkey", some(z * 10, 0, 2).alias("power_hp"), some(z * 7 + 0.25, 1, 2).alias("power_kw"), some(z / 10 + 2, 0).alias("0_60_mph_sec"), F.when(k == 3, 0.0).otherwise(some(z / 8 + 2, 1)).alias("0_100_kmh_sec"))


@query("""
WITH n AS (SELECT p_partkey, p_partkey % 4 AS k, cast(p_size AS double) AS z FROM part), r AS (SELECT p_partkey, k, z * 10 AS hp, z * 7 + 0.25 AS kw, z / 10 + 2 AS a, z / 8 + 2 AS b FROM n)
SELECT p_partkey, CASE WHEN k IN (0, 2) THEN hp WHEN k = 1 THEN round(kw * 1.341::double, 1) END AS power_hp, CASE WHEN k IN (1, 2) THEN kw WHEN k = 0 THEN round(hp * 0.7457::double, 1) END AS power_kw,
  CASE k WHEN 0 THEN a WHEN 1 THEN round(b / 1.036::double, 2) END AS sec_60, CASE k WHEN 0 THEN round(a * 1.036::double, 2) WHEN 1 THEN b WHEN 3 THEN 0.0 END AS sec_100 FROM r
""")
def ie2_ie3_fill_pairs(spark, sf_dir):
    out = enrich.accelerations(enrich.powers(_numbers(spark, sf_dir)))
    return out.select("p_partkey", "power_hp", "power_kw", name("0_60_mph_sec").alias("sec_60"), name("0_100_kmh_sec").alias("sec_100"))


@query("SELECT 'power' AS step, count(*) FILTER (WHERE p_partkey % 4 IN (0, 1)) AS changed FROM part UNION ALL SELECT 'acceleration', count(*) FILTER (WHERE p_partkey % 4 IN (0, 1)) FROM part")
def d17_step_counts(spark, sf_dir):
    steps = {"power": (enrich.powers, ("power_hp", "power_kw")), "acceleration": (enrich.accelerations, ("0_60_mph_sec", "0_100_kmh_sec"))}
    return quality_report.step_counts(_numbers(spark, sf_dir), steps)


@query("""
WITH n AS (SELECT p_partkey, p_partkey % 4 AS k, cast(p_size AS double) AS z FROM part)
SELECT p_partkey, CASE WHEN k IN (0, 2) THEN z * 10 WHEN k = 1 THEN round((z * 7 + 0.25) * 1.341::double, 1) END AS power_hp, (SELECT count(*) FROM n WHERE k IN (0, 1)) AS power, (SELECT count(*) FROM n WHERE k IN (0, 1)) AS acceleration FROM n
""")
def d17_watched_write(spark, sf_dir):
    """A written result of two steps, with the rows that each changed, counted by the tasks that wrote them."""
    seen = quality_report.Watched(_numbers(spark, sf_dir), {"power": (enrich.powers, ("power_hp", "power_kw")), "acceleration": (enrich.accelerations, ("0_60_mph_sec", "0_100_kmh_sec"))})
    out = cut(seen.df)
    return out.select("p_partkey", "power_hp", *[F.lit(n).cast("long").alias(s) for s, n in seen.counts().items()])


_placed = _by_row([
    ("Porsche", "911 GT3", "H6", "Petrol", None, "Rear"), ("porsche", "Boxster {z}", "H6", "Petrol", None, "Mid"), ("Porsche", "Cayenne", "V8", "Petrol", None, "Front"), ("Ferrari", "F430", None, "Petrol", "", "Mid"), ("Ferrari", "Roma", None, None, None, "Front"), ("McLaren", "X{z}", None, None, None, "Mid"),
    ("Chevrolet", "Corvette C8", None, None, None, "Mid"), ("Chevrolet", "Corvette {z}", None, None, None, "Front"), ("Ford", "GT", None, None, None, "Mid"), ("Ford", "GT500", "V8", "Petrol", None, "Front"), ("Ford", "GT500", None, None, None, None), ("Tesla", "S", "Electric", "Electric", None, None),
    ("Smart", "EQ Fortwo", None, None, None, "Rear"), ("Porsche", "911", "H6", "Petrol", "Front", "Front"), ("Audi", "R8 {z}", None, None, None, "Mid"), ("TVR", "any {z}", None, None, None, "Front"), ("Alfa Romeo", "4C", None, None, None, "Mid"), (None, "911", None, None, None, None),
])
case_query(
    "ie4_placement", {"manufacturer": _placed[0], "model": _placed[1], "engine_type": _placed[2], "propulsion": _placed[3], "engine_placement": _placed[4]}, lambda d: enrich.engine_placement(d).select("p_partkey", "engine_placement"), {"engine_placement": ("varchar", _placed[5])},
)

_breath = _by_row([
    ("twin-turbo", "V8", "", "Petrol", None, "TC"), ("", "V8", "X TSI", "", None, "TC"), ("blown {z}", "V8", "", "", None, "SC"), ("kompressor", None, "C", "", None, "SC"), ("naturally aspirated", None, "", "", None, "NA"), ("", "V8", "", "", None, "NA"), ("", "Electric", "", "", None, None), ("", "", "", "", None, None),
    ("turbo", "V8", "", "Electric", None, None), ("turbo", "V8", "", "", "SC", "SC"), ("", "AC motor", "", "", None, None), ("T{z}", "I4", "", "", None, "TC"), ("", "I4", "V60 T6", "", None, "TC"),
])
case_query(
    "ie5_aspiration", {"engine": _breath[0], "engine_type": _breath[1], "model": _breath[2], "propulsion": _breath[3], "engine_aspiration": _breath[4]}, lambda d: enrich.engine_aspiration(d).select("p_partkey", "engine_aspiration"), {"engine_aspiration": ("varchar", _breath[5])},
)

_seated = _by_row([
    ("Coupe", "X{z}", "2", "4"), ("Sedan", "X{z}", "4", "5"), ("Van", "X{z}", "4", "7"), ("Roadster", "X", "2", "2"), ("Sedan", "Corvette {z}", "4", "2"), ("boat", "X", None, None), (None, "MX-5", None, "2"), ("Coupe", "AMG GT {z}", "2", "2"), ("Coupe", "X AMG GT", "2", "4"), ("Coupe", "R8 Spyder", "2", "2"), ("Sedan", "R8 sedan", "4", "5"), (None, None, None, None),
])


def _seats(d: DataFrame) -> DataFrame:
    d = d.withColumns({"doors": F.when(F.col("p_size") == 50, 3), "seats": F.when(F.col("p_size") == 50, 9)})
    return enrich.seats(enrich.doors(d)).select("p_partkey", F.col("doors").cast("int").alias("doors"), F.col("seats").cast("int").alias("seats"))


case_query("ie6_ie7_doors_seats", {"body_style": _seated[0], "model": _seated[1]}, _seats, {"doors": ("int", [f"CASE WHEN p_size = 50 THEN 3 ELSE {v or 'NULL'} END" for v in _seated[2]]), "seats": ("int", [f"CASE WHEN p_size = 50 THEN 9 ELSE {v or 'NULL'} END" for v in _seated[3]])})

_general = _by_row([("ICE", "Petrol"), ("Hybrid", "Electric/Petrol"), ("Plug-in Hybrid", "Electric/Petrol"), ("Diesel", "Diesel"), (None, None), ("", "")])
case_query("i0_default_propulsion", {"propulsion": _general[0]}, lambda d: enrich.default_propulsion(d).select("p_partkey", "propulsion"), {"propulsion": ("varchar", _general[1])})

# --- Cleaning (I-C1 to I-C6, I-C8) ---

_moved = _by_row([  # year, manufacturer, model -> the same, cleaned
    ("", "{y}Ford", "F", "{y}", "Ford", "F"), (None, "{y} Ford", "F", "{y}", "Ford", "F"), ("1950", "{y}Ford", "F", "1950", "{y}Ford", "F"), ("{y}", "{y}Ford", "F", "{y}", "Ford", "F"), ("", "Ford", "{y} Mustang", "{y}", "Ford", "Mustang"), ("1950", "Ford", "{y} Mustang", "1950", "Ford", "{y} Mustang"),
    ("", "Ford", "Mustang {y}-2021", "{y}", "Ford", "Mustang"), ("1950", "Ford", "Mustang {y}–Present", "1950", "Ford", "Mustang"), ("", "ASTON MARTIN DB{z}", "{y}-2021", "{y}", "Aston Martin", "DB{z}"), ("", "Zed DB{z}", "{y}-2021", "", "Zed DB{z}", "{y}-2021"), ("", "Ford", "2008GT", "", "Ford", "2008GT"),
])


def _names(d: DataFrame) -> DataFrame:
    for step in (clean.year_in_manufacturer, clean.year_in_model, clean.year_range_in_model, clean.model_in_manufacturer):
        d = step(d)
    return d.select("p_partkey", "year", "manufacturer", "model")


case_query("ic1_ic2_ic3_ic4_names", {"year": _moved[0], "manufacturer": _moved[1], "model": _moved[2]}, _names, {"year": ("varchar", _moved[3]), "manufacturer": ("varchar", _moved[4]), "model": ("varchar", _moved[5])})

_cased = _by_row([("FORD", "Ford"), ("BMW", "BMW"), ("TVR", "TVR"), ("MERCEDES-BENZ", "Mercedes-Benz"), ("ASTON MARTIN LAGONDA GROUP {z}", "Aston Martin"), ("Ford", "Ford"), ("ford", "ford"), ("ALFA ROMEO", "Alfa Romeo"), (None, None)])
case_query("ic5_manufacturer_case", {"manufacturer": _cased[0]}, lambda d: clean.manufacturer_case(d).select("p_partkey", "manufacturer"), {"manufacturer": ("varchar", _cased[1])})

_styled = _by_row([
    ("A{z} Cabriolet", "Coupe", "Convertible"), ("Spyder coupe", None, "Convertible"), ("C coupé", "Sedan", "Coupe"), ("Outback {z}", None, "Wagon"), ("Sportback", "", "Hatchback"), ("X SUV", None, "SUV"), ("Pickup", None, "Truck"), ("minivan", None, "Van"), ("GT{z}", "Coupe", "Coupe"), ("GT{z}", None, None), ("Saloon", "Coupe", "Sedan"), ("Vantage", None, "Van"), (None, "Coupe", "Coupe"),
])
case_query("ic6_body_style", {"model": _styled[0], "body_style": _styled[1]}, lambda d: clean.body_style(d).select("p_partkey", "body_style"), {"body_style": ("varchar", _styled[2])})

_labels = _by_row([("Wikipedia - Nürburgring, EPA - Fuel Economy", "Wikipedia, EPA"), ("Car & Driver - Lightning Lap, Car&Driver - x", "Car & Driver"), ("Kaggle - Car Specifications,Kaggle - {z}", "Kaggle"), ("Own {z}, Own {z}", "Own {z}"), ("", ""), (None, None), ("wikipedia-x,  ,Wikipedia", "Wikipedia")])
case_query("ic8_sources", {"sources": _labels[0]}, lambda d: clean.sources(d).select("p_partkey", "sources"), {"sources": ("varchar", _labels[1])})

# --- Validation (I-V2 to I-V9, D15, E6) ---

_checked = _by_row([  # manufacturer, model, country, propulsion, mph, km/h, hp, kW, 0-60, 0-100, quarter mile -> the fields with issues
    ("BMW", "M{z}", "DE", "Electric", "100", "160.9", "100", "74.6", "4.5", "9", "12.5", ""), (None, "M", "", "", None, None, None, None, None, None, None, "manufacturer"), ("", "", "", "", None, None, None, None, None, None, None, "manufacturer,model"), ("Bmw", "M", "US", "ICE", "100", "180", "100", "90", "9", "8", "8", "0_60_mph_sec,country,power_hp/kw,quarter_mile_sec,top_speed_mph/kmh"),
    ("Zed{z}", "X", "", "Steam", "100", None, None, "90", "1.9", None, "10.5", "0_60_mph_sec,manufacturer,propulsion"), ("Ford", "X", "US", "Hybrid", "0", "100", "100", "71", "3.9", "8", "14.5", "0_60_mph_sec"), ("Ford", "X", "US", "Plug-in Hybrid", "100", "168", "100", "78.2", "2.0", "8", "10.5", ""),
])
_CHECKED = ("manufacturer", "model", "country", "propulsion", "top_speed_mph", "top_speed_kmh", "power_hp", "power_kw", "0_60_mph_sec", "0_100_mph_sec", "quarter_mile_sec")


def _consistency(d: DataFrame) -> DataFrame:
    found = validate.issues_of(d, validate.consistency_issues(MAKERS), "p_partkey")
    return found


def _checked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raw(spark, sf_dir, dict(zip(_CHECKED, _checked[:-1], strict=True)))
    return d.select(*[name(c).cast("double").alias(c) if c in BY_NAME and BY_NAME[c].kind == "numeric" else name(c) for c in d.columns])


@query(f"SELECT p_partkey, fields FROM ({wanted({'fields': ('varchar', _checked[-1])})}) WHERE fields <> ''")
def iv2_to_iv7_consistency(spark, sf_dir):
    found = _consistency(_checked_rows(spark, sf_dir))
    return found.groupBy(F.col("row_index").alias("p_partkey")).agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


@query("""
WITH n AS (SELECT p_partkey % 7 AS k, count(*) AS n FROM part GROUP BY 1), i(k, severity, field, times) AS (VALUES (1, 'ERROR', 'manufacturer', 1), (2, 'ERROR', 'manufacturer', 1), (2, 'ERROR', 'model', 1), (3, 'ERROR', '0_60_mph_sec', 1), (3, 'WARNING', 'country', 1), (3, 'WARNING', 'power_hp/kw', 1), (3, 'ERROR', 'quarter_mile_sec', 1),
  (3, 'WARNING', 'top_speed_mph/kmh', 1), (4, 'ERROR', '0_60_mph_sec', 1), (4, 'WARNING', 'manufacturer', 1), (4, 'WARNING', 'propulsion', 1), (5, 'ERROR', '0_60_mph_sec', 1))
SELECT severity, cast(sum(n * times) AS bigint) AS count FROM i JOIN n USING (k) GROUP BY severity
""")
def d15_issue_counts(spark, sf_dir):
    return validate.issue_counts(_consistency(_checked_rows(spark, sf_dir)))


_schema_rows = _by_row([
    ("BMW", "M", "{y}", "Coupe", "4", "1.0", ""), (None, "", "1899", "boat", "9", "1.6", "body_style,doors,manufacturer,model,skidpad_g,year"), ("BMW", "M", "", "", "", "x{z}", "skidpad_g"), ("BMW", "M", "20{s}x", None, "two", "0.4", "doors,skidpad_g,year"), ("BMW", "M", "2001", "Sedan", "1", "0.5", ""),
])


@query(f"SELECT p_partkey, fields FROM ({wanted({'fields': ('varchar', _schema_rows[-1])})}) WHERE fields <> ''")
def iv9_schema(spark, sf_dir):
    d = raw(spark, sf_dir, dict(zip(("manufacturer", "model", "year", "body_style", "doors", "skidpad_g"), _schema_rows[:-1], strict=True)))
    found = validate.issues_of(d, validate.schema_issues(set(d.columns)), "p_partkey")
    return found.groupBy(F.col("row_index").alias("p_partkey")).agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


@query("SELECT 'ERROR' AS severity, 'Duplicate entry in rows ' || array_to_string(list_sort(list(p_partkey)), ', ') AS message, '2001 ' || lower(CASE WHEN p_size % 3 = 0 THEN 'BMW' ELSE 'Ford' END) || ' ' || lower(p_name) AS value, min(p_partkey) AS row_index FROM part GROUP BY p_size % 3 = 0, p_name HAVING count(*) > 1")
def iv8_duplicates(spark, sf_dir):
    """Rows alike but for case and alias; every row is listed."""
    z = F.col("p_size") % 3
    rows = table(spark, sf_dir, "part").select(F.lit("2001").alias("year"), F.when(z == 0, F.when(F.col("p_partkey") % 2 == 0, "Bmw").otherwise("BMW")).otherwise("Ford").alias("manufacturer"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("model"), F.col("p_partkey").alias("row_index"))
    return validate.duplicate_issues(rows, MAKERS).select("severity", "message", "value", "row_index")


@query(f"SELECT {_KEYS}, row_number() OVER (ORDER BY l_extendedprice, {_KEYS}) AS row_index FROM lineitem")
def e06_f07_numbered(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*KEY)
    return validate.numbered(rows, [F.col("l_extendedprice"), *[F.col(c) for c in KEY]])


@query("SELECT car_id, place FROM (SELECT p_partkey AS car_id, row_number() OVER (ORDER BY p_brand, p_name, p_size::varchar, p_partkey) AS place FROM part)")
def f07_catalog_order(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("manufacturer"), F.col("p_name").alias("model"), F.col("p_size").cast("string").alias("year"), F.col("p_partkey").alias("car_id"))
    return validate.numbered(survivorship.catalog_order(p), column="place").select("car_id", "place")


# --- Merging (C8, C9) ---


@query("""
WITH r AS (SELECT p_partkey AS seq, p_partkey % 2 = 0 AS old, p_brand AS m, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE cast(1990 + p_size % 2 AS varchar) END AS y, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS v FROM part),
  f AS (SELECT m, max(old) AS has_old, min_by(y, seq) FILTER (WHERE NOT old) AS first_year FROM r GROUP BY m), g AS (SELECT r.*, CASE WHEN old THEN coalesce(first_year, '') ELSE y END AS eff, CASE WHEN old THEN 0 ELSE 1000000000 END + seq AS o FROM r JOIN f USING (m))
SELECT m AS manufacturer, eff AS year, min_by(v, o) FILTER (WHERE v <> 0) AS power_hp, min(o) % 1000000000 AS seq FROM g GROUP BY m, eff
""")
def c08_merge_filling_year(spark, sf_dir):
    """Existing rows without a year take that of the first new row of their key."""
    old = F.col("p_partkey") % 2 == 0
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("manufacturer"), F.lit("x").alias("model"), F.lit("C").alias("country"), F.when(old, "").otherwise((1990 + F.col("p_size") % 2).cast("string")).alias("year"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("power_hp"), F.col("p_partkey").alias("seq"))
    from marque.operators.makers import Makers

    out = survivorship.merge_filling_year(p.where("seq % 2 = 0"), p.where("seq % 2 <> 0"), Makers({}))
    return out.select("manufacturer", F.coalesce("year", F.lit("")).alias("year"), "power_hp", "seq")


@query("""
WITH k AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1000000000 END + p_partkey AS o, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS v FROM part)
SELECT p_brand AS manufacturer, p_name AS model, min_by('c' || p_partkey, o) AS car_id, min_by(v, o) FILTER (WHERE v <> 0) AS power_hp, array_to_string(list_distinct_ordered, ', ') AS sources FROM (
  SELECT * FROM k JOIN (SELECT p_brand, p_name, list(src ORDER BY first_o) AS list_distinct_ordered FROM (SELECT p_brand, p_name, 'S' || (p_size % 3) AS src, min(o) AS first_o FROM k GROUP BY ALL) GROUP BY ALL) USING (p_brand, p_name)) GROUP BY p_brand, p_name, list_distinct_ordered
""")
def c09_merge_plain(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("car_id"), F.col("p_brand").alias("manufacturer"), F.col("p_name").alias("model"), F.lit("").alias("year"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("power_hp"), F.concat(F.lit("S"), (F.col("p_size") % 3).cast("string")).alias("sources"), F.col("p_partkey").alias("seq"))
    out = survivorship.merge_plain(p.where("seq % 3 = 0"), p.where("seq % 3 <> 0"))
    return out.select("manufacturer", "model", "car_id", "power_hp", "sources")


# --- Reading the catalog (B4, B12 to B16, D12, F11, G3, G4, A22, A26) ---


@query(f"{_C} SELECT {_KEYS}, CASE WHEN curb_weight_lb > 0 AND power_hp <> 0 THEN round(curb_weight_lb / power_hp, 1) END AS ratio, manufacturer, model FROM c")
def b13_display_ratio(spark, sf_dir):
    c = cq.prepared(catalog(spark, sf_dir))
    return c.select(*KEY, cq.display_ratio(F.col("curb_weight_lb"), F.col("power_hp")).alias("ratio"), "manufacturer", "model")


@query("SELECT concat(p_partkey) AS car_id, p_brand AS manufacturer, p_name AS model, '2001' AS year FROM part ORDER BY p_brand, p_name, concat(p_partkey) LIMIT 20 OFFSET 20")
def b04_b12_b14_page(spark, sf_dir):
    """Parameters as text; a page in the catalog's columns; of these the visible ones of some categories."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("power_hp"), F.lit("2001").alias("year"), F.col("p_partkey").cast("string").alias("car_id"), F.col("p_name").alias("model"), F.col("p_brand").alias("manufacturer"))
    rows, _ = cq.run(p, cq.CatalogQuery.parse({"page": "2", "pageSize": "20", "sortBy": "", "powerMin": "", "search": None}))
    shown = [c for c in COLUMNS if c in rows.columns and c in {*columns_by_category()["Meta"], *columns_by_category()["General"]}]
    return rows.select(*shown)


@query(f"{_C} SELECT count(*) FILTER (WHERE lower(model) LIKE '%ring%') AS rings, count(*) FILTER (WHERE power_hp >= 1000) AS quick, count(*) FILTER (WHERE a_0_60 <= 3) AS fast, count(*) FILTER (WHERE curb_weight_lb BETWEEN 2000 AND 4000 AND lower(manufacturer) LIKE '%brand#1%') AS both_ FROM c")
def b15_column_filters(spark, sf_dir):
    c = catalog(spark, sf_dir)
    quick = lambda k: column_filters.column_filter(*column_filters.QUICK[k])
    return c.agg(
        F.count_if(column_filters.column_filter("model", "RING")).alias("rings"), F.count_if(quick("1000+ HP")).alias("quick"), F.count_if(quick("0-60 under 3s")).alias("fast"),
        F.count_if(column_filters.column_filter("curb_weight_lb", (2000, 4000)) & column_filters.column_filter("manufacturer", "Brand#1")).alias("both_"),
    )


@query(f"{_C} SELECT DISTINCT 'country' AS \"column\", country AS value, NULL::double AS min, NULL::double AS max FROM c UNION ALL SELECT DISTINCT 'drivetrain', drivetrain, NULL, NULL FROM c UNION ALL SELECT 'power_hp', NULL, min(power_hp), max(power_hp) FROM c")
def b15_g04_values_and_ranges(spark, sf_dir):
    c = catalog(spark, sf_dir)
    values, ranges = column_filters.column_values(c, ("country", "drivetrain", "model", "power_hp")), column_filters.column_ranges(c, ("country", "power_hp"))
    return values.unionByName(ranges, allowMissingColumns=True).select("column", "value", "min", "max")


@query("""
WITH n AS (SELECT p_partkey, p_size % 12 AS pages, least(greatest(p_partkey % 12 + 1, 1), greatest(p_size % 12, 1)) AS page FROM part)
SELECT p_partkey, array_to_string(CASE WHEN pages <= 7 THEN range(1, pages + 1)::varchar[] ELSE list_concat(['1'], CASE WHEN page - 1 > 2 THEN ['...'] ELSE [] END, [cast(x AS varchar) FOR x IN range(2, pages) IF abs(x - page) <= 1], CASE WHEN page + 1 < pages - 1 THEN ['...'] ELSE [] END, [cast(pages AS varchar)]) END, ' ') AS numbers,
  cast((page - 1) * 50 + 1 AS int) AS first, cast(least(page * 50, 333) AS int) AS last FROM n
""")
def f11_b16_page_numbers(spark, sf_dir):
    pages = F.col("p_size") % 12
    page = F.least(F.greatest((F.col("p_partkey") % 12 + 1).cast("int"), F.lit(1)), F.greatest(pages, F.lit(1)))
    places = column_filters.record_range(page, F.lit(50), F.lit(333))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(column_filters.page_numbers(page, pages), " ").alias("numbers"), places["first"].cast("int").alias("first"), places["last"].cast("int").alias("last"))


_years = _by_row([("{y}",), ("x{y}",), ("",), (None,), (" 1900",)])


@query("SELECT min(1970 + p_size) AS year_min, max(1970 + p_size) AS year_max FROM part WHERE p_partkey % 5 = 0")
def d12_year_span(spark, sf_dir):
    return quality_report.year_span(raw(spark, sf_dir, {"year": _years[0]}))


@query(f"{_C} SELECT 'power_hp' AS name, 'numeric' AS kind, 50.0::double AS min, 3000.0::double AS max, true AS visible, count(power_hp) AS filled, count(*) FILTER (WHERE power_hp < 50 OR power_hp > 3000) AS outside FROM c UNION ALL SELECT 'car_id', 'string', NULL, NULL, false, count(car_id), 0 FROM c UNION ALL SELECT 'doors', 'integer', 1, 6, false, 0, 0 UNION ALL SELECT 'country', 'string', NULL, NULL, true, count(country), 0 FROM c")
def a22_a26_g03_schema(spark, sf_dir):
    """The declared columns, and of each how many rows of the catalog fill it and lie outside its bounds; 'doors' it lacks."""
    figures = column_definitions(catalog(spark, sf_dir)).select("name", "filled", "outside")
    declared = schema_df(spark).where(F.col("name").isin("power_hp", "car_id", "doors", "country")).select("name", "kind", "min", "max", "visible")
    return declared.join(figures, "name", "left").fillna(0, ["filled", "outside"])


assert CATALOG_SQL in _C
