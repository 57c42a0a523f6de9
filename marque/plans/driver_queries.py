"""The engine's operators over the star-schema tables, and the same in DuckDB's SQL.

A catalog is derived from lineitem, orders, part, supplier and nation. Its columns are those
of the real catalog; the SQL below is read by both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marque.functions import classify, text, units
from marque.functions.columns import name
from marque.operators import catalog_query as cq
from marque.operators import clean, enrich, facets, percentiles, quality_report, survivorship, validate
from marque.operators.makers import Makers
from marque.operators.store import with_derived
from marque.schema import NUMERIC

Query = Callable[[SparkSession, str], DataFrame]

#: A unique order of lineitem's rows.
KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
_KEY_SQL = ", ".join(KEY)

CATALOG_SQL = """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice,
  concat(cast(l.l_orderkey AS varchar), '-', cast(l.l_linenumber AS varchar), '-', cast(l.l_partkey AS varchar)) AS car_id,
  n.n_name AS country, cast(year(o.o_orderdate) AS varchar) AS year, p.p_brand AS manufacturer, p.p_name AS model,
  p.p_type AS body_style, l.l_returnflag AS drivetrain, o.o_orderpriority AS propulsion, l.l_linestatus AS engine_type,
  CASE WHEN l.l_linenumber % 7 <> 0 THEN l.l_quantity * 20 END AS power_hp,
  l.l_extendedprice / 10 AS curb_weight_lb,
  CASE WHEN l.l_linenumber % 5 <> 0 THEN concat(cast(p.p_size * 10 AS varchar), ' lb-ft') END AS torque,
  CASE WHEN l.l_linenumber % 3 <> 0 THEN l.l_quantity / 5 + 1 END AS a_0_60, l.l_quantity / 2 + 7 AS quarter_mile_sec,
  l.l_quantity * 6 AS top_speed_mph, l.l_quantity / 6 AS engine_displacement,
  CASE WHEN l.l_linenumber % 4 = 0 THEN concat(o.o_orderstatus, ', ', p.p_brand) WHEN l.l_linenumber % 4 = 1 THEN o.o_orderstatus END AS sources
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
"""

_CATALOG_TABLES = ("lineitem", "orders", "part", "supplier", "nation")


def table(spark: SparkSession, sf_dir: str, n: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{n}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o, p, s, n = (table(spark, sf_dir, t) for t in _CATALOG_TABLES)  # noqa: E741
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    line, q = F.col("l_linenumber"), F.col("l_quantity")
    return rows.select(
        *KEY, F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("car_id"), F.col("n_name").alias("country"), F.year("o_orderdate").cast("string").alias("year"),
        F.col("p_brand").alias("manufacturer"), F.col("p_name").alias("model"), F.col("p_type").alias("body_style"), F.col("l_returnflag").alias("drivetrain"), F.col("o_orderpriority").alias("propulsion"),
        F.col("l_linestatus").alias("engine_type"), F.when(line % 7 != 0, q * 20).alias("power_hp"), (F.col("l_extendedprice") / 10).alias("curb_weight_lb"),
        F.when(line % 5 != 0, F.concat((F.col("p_size") * 10).cast("string"), F.lit(" lb-ft"))).alias("torque"), F.when(line % 3 != 0, q / 5 + 1).alias("0_60_mph_sec"), (q / 2 + 7).alias("quarter_mile_sec"),
        (q * 6).alias("top_speed_mph"), (q / 6).alias("engine_displacement"),
        F.when(line % 4 == 0, F.concat("o_orderstatus", F.lit(", "), "p_brand")).when(line % 4 == 1, F.col("o_orderstatus")).alias("sources"),
    )


_PREFIX = "(CASE WHEN torque IS NULL THEN NULL WHEN instr(torque, ' ') = 0 THEN 0.0 ELSE coalesce(try_cast(split_part(torque, ' ', 1) AS double), 0.0) END)"
_RATIO = "(CASE WHEN power_hp > 0 THEN curb_weight_lb / power_hp END)"
_C = f"WITH c AS (SELECT *, {_PREFIX} AS torque_lbft, {_RATIO} AS ratio FROM ({CATALOG_SQL})) "
_CARS = f"{_KEY_SQL}, manufacturer, model, year, power_hp, torque"


def _rows(df: DataFrame) -> DataFrame:
    return df.select(*KEY, "manufacturer", "model", "year", "power_hp", "torque")


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return put


def _page(where: str, order: str, limit: int, offset: int = 0) -> str:
    return f"{_C} SELECT {_CARS} FROM c WHERE {where} ORDER BY {order}, {_KEY_SQL} LIMIT {limit} OFFSET {offset}"


@query(_page("country = 'FRANCE' OR country IS NOT NULL AND country = (SELECT min(n_name) FROM nation)", "manufacturer, model", 50).replace("country = 'FRANCE' OR country IS NOT NULL AND ", ""))
def b02_f01_equality_default_order(spark, sf_dir):
    first = table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return _rows(cq.page(catalog(spark, sf_dir), cq.CatalogQuery(country=first), KEY))


@query(_page("power_hp >= 600 AND curb_weight_lb <= 4000", "power_hp DESC NULLS LAST", 50, 50))
def b07_b08_bounds_sorted_page(spark, sf_dir):
    return _rows(cq.page(catalog(spark, sf_dir), cq.CatalogQuery(page=2, powerMin=600, weightMax=4000, sortBy="power_hp", sortOrder="desc"), KEY))


@query(f"{_C} SELECT cast(1 AS bigint) AS page, cast(50 AS bigint) AS page_size, count(*) AS total, cast(ceil(count(*) / 50.0) AS bigint) AS total_pages FROM c WHERE drivetrain = 'R' AND a_0_60 <= 6")
def d01_f06_count_and_pages(spark, sf_dir):
    return cq.pagination(catalog(spark, sf_dir), cq.CatalogQuery(drivetrain="R", accel060Max=6))


@query(_page("cast(year AS int) BETWEEN 1994 AND 1996", "year DESC", 100))
def b03_year_range(spark, sf_dir):
    return _rows(cq.page(catalog(spark, sf_dir), cq.CatalogQuery(yearMin=1994, yearMax=1996, pageSize=100, sortBy="year", sortOrder="desc"), KEY))


@query(_page("torque_lbft >= 300", "torque_lbft NULLS LAST", 100))
def b09_f04_torque(spark, sf_dir):
    return _rows(cq.page(catalog(spark, sf_dir), cq.CatalogQuery(torqueMin=300, pageSize=100, sortBy="torque"), KEY))


@query(_page("ratio <= 8", "ratio NULLS LAST", 100))
def b10_f03_ratio(spark, sf_dir):
    return _rows(cq.page(catalog(spark, sf_dir), cq.CatalogQuery(powerToWeightMax=8, pageSize=100, sortBy="power_to_weight"), KEY))


@query(f"{_C} SELECT count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM c WHERE list_contains(string_split(sources, ', '), 'F')")
def b06_source_membership(spark, sf_dir):
    return cq.filtered(catalog(spark, sf_dir), cq.CatalogQuery(source="F")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


@query("WITH t AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_brand || ' ' || p_name), '[^a-z0-9]+')) AS w FROM part), f AS (SELECT left(lower(min(split_part(p_name, ' ', 1))), 3) AS p FROM part) SELECT DISTINCT p_partkey FROM t, f WHERE starts_with(w, p)")
def b05_search_prefix(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    prefix = part.agg(F.min(F.split_part("p_name", F.lit(" "), F.lit(1)))).first()[0][:3]
    rows = with_derived(part.select("p_partkey", F.col("p_brand").alias("manufacturer"), F.col("p_name").alias("model")))
    return rows.where(cq.matches(prefix)).select("p_partkey")


_FACET_COLUMNS = ("manufacturer", "country", "body_style", "propulsion", "engine_type", "drivetrain")


@query(_C + " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS count FROM c WHERE {c} <> '' GROUP BY {c}" for c in _FACET_COLUMNS))
def d02_facets(spark, sf_dir):
    return facets.facet_counts(catalog(spark, sf_dir), _FACET_COLUMNS)


@query(f"{_C} SELECT v AS value, count(*) AS count FROM (SELECT trim(unnest(string_split(sources, ','))) AS v FROM c) WHERE v <> '' GROUP BY v")
def d03_source_facet(spark, sf_dir):
    return facets.source_counts(catalog(spark, sf_dir))


_SQL_COLUMN = {"0_60_mph_sec": "a_0_60", "torque_prefix": "torque_lbft", "power_to_weight": "ratio"}


def _threshold_sql() -> str:
    cells = []
    for m, c, op, label, vs in facets.THRESHOLDS:
        for v in vs:
            shown = f"{v:.1f}" if m == "displacement" else f"{v:g}"
            cells.append(f"SELECT '{m}' AS metric, '{label.format(shown)}' AS label, cast({v} AS double) AS value, count(*) FILTER (WHERE {_SQL_COLUMN.get(c, c)} {op} {v}) AS count FROM c")
    return _C + " UNION ALL ".join(cells)


@query(_threshold_sql())
def d04_d05_d06_thresholds(spark, sf_dir):
    return facets.threshold_counts(catalog(spark, sf_dir))


@query(f"{_C} SELECT count(*) AS total, min(cast(year AS int)) AS year_min, max(cast(year AS int)) AS year_max FROM c")
def d07_year_range(spark, sf_dir):
    return facets.year_range(catalog(spark, sf_dir))


_PCT = {"power_hp": "power_hp", "curb_weight_lb": "curb_weight_lb", "0_60_mph_sec": "a_0_60", "quarter_mile_sec": "quarter_mile_sec", "top_speed_mph": "top_speed_mph", "torque": "torque_lbft", "power_to_weight": "ratio"}


def _percentile_sql() -> str:
    one = lambda k, c: f"SELECT '{k}' AS \"column\", count(*) AS n, min(v) FILTER (WHERE i = cast(floor(m * cast(0.1 AS double)) AS bigint)) AS p10, min(v) FILTER (WHERE i = cast(floor(m * cast(0.9 AS double)) AS bigint)) AS p90 FROM (SELECT cast({c} AS double) AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS m FROM c WHERE {c} IS NOT NULL)"
    return _C + " UNION ALL ".join(one(k, c) for k, c in _PCT.items())


@query(_percentile_sql())
def e01_e04_percentiles(spark, sf_dir):
    return percentiles.percentiles(catalog(spark, sf_dir), tuple(_PCT))


@query(f"{_C}, t AS (SELECT min(power_hp) FILTER (WHERE i = cast(floor(m * cast(0.1 AS double)) AS bigint)) AS p10, min(power_hp) FILTER (WHERE i = cast(floor(m * cast(0.9 AS double)) AS bigint)) AS p90 FROM (SELECT power_hp, row_number() OVER (ORDER BY power_hp) - 1 AS i, count(*) OVER () AS m FROM c WHERE power_hp IS NOT NULL)) SELECT CASE WHEN power_hp >= p90 THEN 'top10' WHEN power_hp <= p10 THEN 'bottom10' ELSE 'none' END AS status, count(*) AS n FROM c, t GROUP BY 1")
def e05_percentile_status(spark, sf_dir):
    c = catalog(spark, sf_dir)
    rows = percentiles.with_status(c, percentiles.percentiles(c, ("power_hp",)), "power_hp")
    return rows.groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


@query(f"SELECT {_KEY_SQL}, cast(l_quantity AS double) AS mph, cast(cast(l_quantity AS int) * 1000 AS double) AS hp, cast(cast(l_linenumber AS int) * 60 + cast(l_quantity AS int) % 60 AS double) AS seconds, cast(cast(l_quantity AS int) AS double) + 0.5 AS plain, cast(1990 + l_linenumber AS varchar) AS year FROM lineitem")
def h30_h33_parse_numbers(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    s = q.cast("string")
    return table(spark, sf_dir, "lineitem").select(
        *KEY, units.parse_speed(F.concat(s, F.lit(" mph [1]")))["mph"].alias("mph"), units.parse_power(F.concat(s, F.lit(",000 hp")))["hp"].alias("hp"),
        units.parse_time(F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.lpad((q % 60).cast("string"), 2, "0"), F.lit(".0"))).alias("seconds"),
        units.parse_float(F.concat(s, F.lit(".5 lb"))).alias("plain"), text.year_of(F.concat(F.lit("model of "), (1990 + F.col("l_linenumber")).cast("string"))).alias("year"),
    )


@query()
def h01_h02_clean_text_whole(spark, sf_dir):
    """All documents, with what clean_text removes and null texts: SQL can't express its rules, so a test holds it against Python."""
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("t"))


_ID = "substr(sha256(concat(regexp_replace(lower(cast(year(o_orderdate) AS varchar)), '[^a-z0-9]', '', 'g'), regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g'), regexp_replace(lower(o_orderstatus), '[^a-z0-9]', '', 'g'))), 1, 16)"


@query(f"SELECT o_orderkey, {_ID} AS car_id FROM orders")
def h03_car_id(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.car_id(F.year("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("car_id"))


_NONE = Makers({})


@query(f"WITH o AS (SELECT *, {_ID} AS car_id FROM orders) SELECT car_id, min(o_orderkey) AS seq, min_by(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice <> 0) AS power_hp, min_by(o_custkey, o_orderkey) FILTER (WHERE o_custkey % 3 = 0 AND o_custkey <> 0) AS seats FROM o GROUP BY car_id")
def d08_deduplicate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderpriority").alias("manufacturer"), F.col("o_orderstatus").alias("model"), F.col("o_totalprice").alias("power_hp"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).alias("seats"))
    return survivorship.deduplicate(o, _NONE).select("car_id", "seq", "power_hp", "seats")


@query("WITH r AS (SELECT p_brand AS b, p_size AS z, p_partkey AS seq, (p_partkey % 2 = 0) AS existing, CASE WHEN p_partkey % 5 <> 0 THEN cast(1990 + p_size % 4 AS varchar) ELSE '' END AS y, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS v FROM part), k AS (SELECT *, CASE WHEN existing THEN 0 ELSE 1 END * 1000000000 + seq AS o FROM r), f AS (SELECT b, bool_or(existing AND y = '') AS blank, min_by(y, o) AS first_y FROM k GROUP BY b), e AS (SELECT k.*, CASE WHEN y <> '' THEN y WHEN blank OR first_y = '' THEN '' ELSE first_y END AS eff FROM k JOIN f USING (b)) SELECT b AS manufacturer, nullif(coalesce(min_by(y, o) FILTER (WHERE y <> ''), ''), '') AS year, min_by(v, o) FILTER (WHERE v <> 0) AS power_hp, min(o) % 1000000000 AS seq FROM e GROUP BY b, eff")
def c07_d09_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("manufacturer"), F.lit("x").alias("model"), F.lit("C").alias("country"), F.when(F.col("p_partkey") % 5 != 0, (1990 + F.col("p_size") % 4).cast("string")).otherwise("").alias("year"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("power_hp"), F.col("p_partkey").alias("seq"))
    out = survivorship.merge(p.where("seq % 2 = 0"), p.where("seq % 2 <> 0"), _NONE)
    return out.select("manufacturer", "year", "power_hp", "seq")


@query("SELECT o_custkey, string_agg(s, ', ' ORDER BY o) AS sources FROM (SELECT o_custkey, o_orderstatus AS s, min(o_orderkey) AS o FROM orders GROUP BY o_custkey, o_orderstatus) GROUP BY o_custkey")
def g02_source_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(survivorship.merged_sources(F.col("o_orderstatus"), F.col("o_orderkey")).alias("sources"))


@query(f"SELECT {_KEY_SQL}, CASE WHEN q <= a OR (a < 2 AND q > 10) OR (a < 4 AND q > 14) OR (a < 6 AND q > 18) THEN NULL ELSE a END AS a FROM (SELECT *, l_quantity / 5 AS a, l_quantity / 3 + 4 AS q FROM lineitem)")
def ic7_implausible(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*KEY, (F.col("l_quantity") / 5).alias("0_60_mph_sec"), (F.col("l_quantity") / 3 + 4).alias("quarter_mile_sec"))
    return clean.accelerations(rows).select(*KEY, name("0_60_mph_sec").alias("a"))


@query(f"SELECT {_KEY_SQL}, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS from_kmh, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 0 END AS from_mph FROM lineitem")
def ie1_fill_speeds(spark, sf_dir):
    even = F.col("l_linenumber") % 2 == 0
    rows = enrich.speeds(table(spark, sf_dir, "lineitem").select(*KEY, F.when(~even, F.col("l_quantity")).alias("top_speed_mph"), F.when(even, F.col("l_quantity")).alias("top_speed_kmh"), F.col("l_quantity").alias("_q")))
    mph = (F.abs(F.col("top_speed_mph") - F.col("_q") * units.KMH_TO_MPH) < 0.06) & even
    kmh = (F.abs(F.col("top_speed_kmh") - F.col("_q") * units.MPH_TO_KMH) < 0.06) & ~even
    return rows.select(*KEY, mph.cast("int").alias("from_kmh"), kmh.cast("int").alias("from_mph"))


@query()
def h50_propulsion_whole(spark, sf_dir):
    """All parts; a test holds it against Python."""
    return table(spark, sf_dir, "part").select("p_partkey", classify.propulsion(F.col("p_name"), F.col("p_type")).alias("propulsion"))


def _range_rows(spark, sf_dir):
    return catalog(spark, sf_dir).select(*KEY, "year", "manufacturer", "model", "power_hp", "curb_weight_lb", "top_speed_mph", F.col("l_orderkey").alias("row_index"))


_BOUNDS = {"power_hp": (50, 3000), "curb_weight_lb": (1000, 10000), "top_speed_mph": (50, 350)}


@query(_C + "SELECT field, severity, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, CASE WHEN {c} < {lo} THEN CASE WHEN {c} < {lo} * 0.5 THEN 'ERROR' ELSE 'WARNING' END ELSE CASE WHEN {c} > {hi} * 1.5 THEN 'ERROR' ELSE 'WARNING' END END AS severity FROM c WHERE {c} < {lo} OR {c} > {hi}" for c, (lo, hi) in _BOUNDS.items()) + ") GROUP BY ALL")
def iv1_range_issues(spark, sf_dir):
    rows = _range_rows(spark, sf_dir)
    return validate.issues_of(rows, validate.range_issues(set(rows.columns))).groupBy("field", "severity").agg(F.count("*").alias("n"))


@query("SELECT cast(l_orderkey AS varchar) AS year, lower(cast(l_linenumber AS varchar)) AS manufacturer, 'x' AS model, count(*) AS n, list_sort(list(l_partkey)) AS rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def d14_duplicate_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("year"), F.col("l_linenumber").cast("string").alias("manufacturer"), F.lit("x").alias("model"), F.col("l_partkey").alias("row_index"))
    return validate.duplicate_keys(rows, _NONE).select("year", "manufacturer", "model", "n", "rows")


_D10 = ("lang", "source", "text")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS total, count(nullif({c}, '')) AS filled, count(*) - count(nullif({c}, '')) AS empty, count(DISTINCT nullif({c}, '')) AS \"distinct\" FROM documents" for c in _D10))
def d10_completeness(spark, sf_dir):
    return quality_report.completeness(table(spark, sf_dir, "documents"), _D10).drop("fill_rate")


@query("SELECT source AS value, count(*) AS count FROM documents GROUP BY source ORDER BY count DESC, value LIMIT 20")
def d11_f09_distribution(spark, sf_dir):
    return quality_report.distribution(table(spark, sf_dir, "documents"), "source", 20)


@query(_C + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS count, min({c}) AS min, max({c}) AS max FROM c" for c in _BOUNDS))
def d13_numeric_stats(spark, sf_dir):
    return quality_report.numeric_stats(catalog(spark, sf_dir), tuple(_BOUNDS)).select("field", "count", "min", "max")


@query(f"{_C} SELECT count(*) AS n FROM c WHERE (power_hp IS NULL OR power_hp BETWEEN 50 AND 3000) AND (curb_weight_lb IS NULL OR curb_weight_lb BETWEEN 1000 AND 10000) AND (a_0_60 IS NULL OR a_0_60 BETWEEN 1 AND 30) AND (quarter_mile_sec BETWEEN 7 AND 25) AND (top_speed_mph BETWEEN 50 AND 350) AND (engine_displacement BETWEEN 0.5 AND 10)")
def b18_constraints(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.where(validate.constraint(set(c.columns))).agg(F.count("*").alias("n"))


@query(f"{_C} SELECT count(*) AS total, count(DISTINCT manufacturer) AS unique_manufacturer, count(DISTINCT model) AS unique_model, count(DISTINCT year) AS unique_year, count(power_hp) AS power_hp FROM c")
def d16_coverage(spark, sf_dir):
    return quality_report.metric_coverage(catalog(spark, sf_dir)).select("total", "unique_manufacturer", "unique_model", "unique_year", "power_hp")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a filtered, sorted page of the catalog."""
    return b07_b08_bounds_sorted_page(spark, sf_dir)


assert set(_BOUNDS) <= set(NUMERIC)
