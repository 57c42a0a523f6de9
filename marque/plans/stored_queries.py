"""Queries of what the engine stores: the search index, clustered files, deep pages, upserts and deduplication in place.

Each builds its tables in a folder of the shared store that goes when the query has its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marque.functions.columns import name
from marque.operators import catalog_query as cq
from marque.operators import facets, quality_report
from marque.operators.maker_table import MakerTable
from marque.operators.makers import Makers
from marque.operators.page_directory import PageDirectory, order_of
from marque.operators.requests import rows_answer
from marque.operators.search_index import SearchIndex
from marque.operators.store import with_derived, write_clustered
from marque.operators.stored_catalog import StoredCatalog
from marque.plans.driver_queries import _BOUNDS, _C, KEY, catalog, table
from marque.plans.step_queries import query
from marque.schema import column_definitions
from marque.session import cut, scratch

_KEYS = ", ".join(KEY)
_NONE = Makers.of({})


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- Search by the inverted index (A17, B5, C6) ---

#: Texts and their words; the last word is a prefix.
_SEARCHES = {"brand 1": ("brand", "1"), "RED wid": ("red", "wid"), "small ring 7": ("small", "ring", "7"), "Brand#17 bolt 19": ("brand", "17", "bolt", "19"), "no such thing": ("no", "such", "thing")}
_FOUND = "manufacturer, count(*) AS n, min(l_orderkey) AS low, max(l_orderkey) AS high, cast(sum(l_partkey) AS bigint) AS parts"


def _holds(words: tuple[str, ...]) -> str:
    return " AND ".join([f"list_contains(w, '{x}')" for x in words[:-1]] + [f"len(list_filter(w, lambda x: starts_with(x, '{words[-1]}'))) > 0"])


@query(f"{_C}, t AS (SELECT *, regexp_split_to_array(lower(concat_ws(' ', car_id, manufacturer, model)), '[^a-z0-9]+') AS w FROM c) " + " UNION ALL ".join(f"SELECT '{text}' AS search, {_FOUND} FROM t WHERE {_holds(words)} GROUP BY manufacturer" for text, words in _SEARCHES.items()))
def a17_b05_c06_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    cars = catalog(spark, sf_dir).select("l_orderkey", "l_partkey", "car_id", "manufacturer", "model", "year")  # what searches test and count
    cars = cut(cars.withColumn("row", F.monotonically_increasing_id()))  # a number a row, which stays as it is stored
    with scratch(spark) as path:
        index = SearchIndex.build(cars, path, "row", folders=16, unique=True)
        found = F.count("*").alias("n"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"), F.sum("l_partkey").alias("parts")
        return cut(cq.searched(cars, _SEARCHES, index).groupBy("search", "manufacturer").agg(*found))


# --- Clustered files (A16) ---

_LOOKED_UP = "count(*) AS n, min(l_orderkey) AS low, max(l_orderkey) AS high, min(power_hp) AS power_min, max(power_hp) AS power_max"


@query(f"{_C} SELECT 'maker and power' AS lookup, {_LOOKED_UP} FROM c WHERE manufacturer = 'Brand#11' AND power_hp >= 600 UNION ALL SELECT 'years and power', {_LOOKED_UP} FROM c WHERE cast(year AS int) BETWEEN 1994 AND 1995 AND power_hp >= 900 UNION ALL SELECT 'power', {_LOOKED_UP} FROM c WHERE power_hp >= 980 UNION ALL SELECT 'id', {_LOOKED_UP} FROM c WHERE car_id = (SELECT min(car_id) FROM c)")
def a16_clustered_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as path:
        write_clustered(cut(catalog(spark, sf_dir).select("l_orderkey", "car_id", "manufacturer", "model", "year", "power_hp")), path, files=32)  # what the lookups test and count
        cars = spark.read.parquet(path)
        first = cars.agg(F.min("car_id")).first()[0]
        kept = {
            "maker and power": cq.filtered(cars, cq.CatalogQuery(manufacturer="Brand#11", powerMin=600)), "years and power": cq.filtered(cars, cq.CatalogQuery(yearMin=1994, yearMax=1995, powerMin=900)),
            "power": cq.filtered(cars, cq.CatalogQuery(powerMin=980)), "id": cars.where(F.col("car_id") == first),
        }
        p = F.col("power_hp")
        return cut(_union([d.agg(F.count("*").alias("n"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"), F.min(p).alias("power_min"), F.max(p).alias("power_max")).withColumn("lookup", F.lit(n)) for n, d in kept.items()]))


# --- Deep pages (F5, D1) ---

_SIZE = 50
_MIDDLE = f"(n // 2) // {_SIZE}"


@query(f"{_C}, r AS (SELECT *, row_number() OVER (ORDER BY power_hp DESC NULLS LAST, {_KEYS}) - 1 AS place, count(*) OVER () AS n FROM c), p AS (SELECT *, place // {_SIZE} AS page0, (n + {_SIZE - 1}) // {_SIZE} AS total_pages FROM r) " + " UNION ALL ".join(f"SELECT '{label}' AS which, place, {_KEYS}, power_hp, n AS total, total_pages FROM p WHERE page0 = {page}" for label, page in (("first", "0"), ("middle", _MIDDLE), ("after", f"{_MIDDLE} + 1"), ("last", "total_pages - 1"))))
def f05_d01_deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = cq.CatalogQuery(sortBy="power_hp", sortOrder="desc")
    order = order_of(asked, KEY)
    with scratch(spark) as path:
        listing = PageDirectory.build(catalog(spark, sf_dir), asked, path, KEY, ranges=24, columns=(*KEY, "power_hp"))
        about = listing.pagination(1, _SIZE)
        middle, last = about["total"] // 2 // _SIZE + 1, about["totalPages"]
        cursor = PageDirectory.cursor(listing.page(middle, _SIZE).collect()[-1], order)
        pages = {"first": (1, listing.page(1, _SIZE)), "middle": (middle, listing.page(middle, _SIZE)), "after": (middle + 1, listing.after(cursor, _SIZE)), "last": (last, listing.page(last, _SIZE))}
        out = [spark.createDataFrame([(which, (n - 1) * _SIZE + i, *(r[k] for k in KEY), r["power_hp"]) for i, r in enumerate(rows.select(*KEY, "power_hp").collect())], "which string, place long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*KEY, "power_hp").schema)) for which, (n, rows) in pages.items()]
        return _union(out).withColumns({"total": F.lit(about["total"]).cast("long"), "total_pages": F.lit(last).cast("long")})


# --- Upserts and deduplication in place (A24, A25, C7) ---


def _cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of part as cars: names repeat, some with a hyphen, so that unlike names have one car_id; some years and powers are missing."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("seq"), F.col("p_brand").alias("manufacturer"), F.when(k % 7 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.col("p_name")).alias("model"), F.lit("C").alias("country"),
        F.when(k % 5 != 0, (1990 + F.col("p_size") % 4).cast("string")).otherwise("").alias("year"), F.when(k % 3 != 0, F.col("p_retailprice")).alias("power_hp"),
        F.when(k % 3 == 0, "lap").when(k % 3 == 1, "top").otherwise("lap_top").alias("sources"),
    )


_CARS_SQL = "SELECT p_partkey % 4 AS part4, p_partkey AS k, p_brand AS b, CASE WHEN p_partkey % 7 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END AS m, CASE WHEN p_partkey % 5 <> 0 THEN cast(1990 + p_size % 4 AS varchar) ELSE '' END AS y, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS v, CASE p_partkey % 3 WHEN 0 THEN 'lap' WHEN 1 THEN 'top' ELSE 'lap_top' END AS s FROM part"
_ID = "left(sha256(y || regexp_replace(lower(b), '[^a-z0-9]', '', 'g') || regexp_replace(lower(m), '[^a-z0-9]', '', 'g')), 16)"
_FIRST_V = "min_by(v, o) FILTER (WHERE v <> 0)"


def _once(rows: str) -> str:
    """Rows (b, m, y, v, o) deduplicated: the shortest model stays, then the first."""
    by = "(len(m) * 100000000000000 + o)"
    return f"SELECT min_by(b, {by}) AS b, min_by(m, {by}) AS m, min_by(y, {by}) AS y, {_FIRST_V.replace(', o', f', {by}')} AS v, min(o) AS o FROM (SELECT *, {_ID} AS id FROM {rows}) GROUP BY id"


def _merged(rows: str, fresh: int) -> str:
    """Rows merged on effective year, maker and model; those of o from fresh on are new."""
    keyed = f"(SELECT *, lower(m) AS md FROM {rows})"
    facts = f"(SELECT b, md, bool_or(o < {fresh} AND y = '') AS blank, min_by(y, o) AS first_y FROM {keyed} GROUP BY b, md)"
    eff = f"(SELECT k.*, CASE WHEN y <> '' THEN y WHEN blank OR first_y = '' THEN '' ELSE first_y END AS eff FROM {keyed} k JOIN {facts} f USING (b, md))"
    return f"SELECT b, min_by(m, o) AS m, coalesce(min_by(y, o) FILTER (WHERE y <> ''), '') AS y, {_FIRST_V} AS v, min(o) AS o FROM {eff} GROUP BY b, md, eff"


_BATCH = 1_000_000_000


@query(f"""
WITH r AS ({_CARS_SQL}), t0 AS ({_once("(SELECT b, m, y, v, k AS o FROM r WHERE part4 < 2)")}),
  u1 AS (SELECT b, m, y, v, o FROM t0 UNION ALL SELECT b, m, y, v, {_BATCH} + k FROM r WHERE part4 = 2), m1 AS ({_merged("u1", _BATCH)}), t1 AS ({_once("m1")}),
  u2 AS (SELECT b, m, y, v, o FROM t1 UNION ALL SELECT b, m, y, v, {2 * _BATCH} + k FROM r WHERE part4 = 3 AND b LIKE 'Brand#1%'), m2 AS ({_merged("u2", 2 * _BATCH)}), t2 AS ({_once("m2")})
SELECT {_ID} AS car_id, b AS manufacturer, m AS model, nullif(y, '') AS year, v AS power_hp FROM t2
""")
def a25_c07_upsert_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two upserts by key, each of which rewrites the partitions it touches."""
    cars = _cars(spark, sf_dir).drop("sources")
    with scratch(spark) as path:
        stored = StoredCatalog.create(cars.where("seq % 4 < 2"), path, _NONE, buckets=24)
        stored.upsert(cars.where("seq % 4 = 2"))
        stored.upsert(cars.where("seq % 4 = 3 and manufacturer like 'Brand#1%'"))
        return cut(stored.read().select("car_id", "manufacturer", "model", F.nullif("year", F.lit("")).alias("year"), "power_hp"))


@query(f"""
WITH r AS ({_CARS_SQL}), old AS (SELECT b, m, y, v, s, k AS o, 0 AS e FROM r WHERE part4 = 0 QUALIFY row_number() OVER (PARTITION BY b, m ORDER BY k) = 1),
  u AS (SELECT * FROM old UNION ALL SELECT b, m, y, v, s, {_BATCH} + k AS o, 1 AS e FROM r WHERE part4 <> 0),
  told AS (SELECT b, m, list(s ORDER BY o) AS l FROM (SELECT b, m, s, min(o) AS o FROM u WHERE e = 1 GROUP BY b, m, s) GROUP BY b, m),
  g AS (SELECT b, m, min_by(y, o) FILTER (WHERE y <> '') AS y, {_FIRST_V} AS v, coalesce(min(s) FILTER (WHERE e = 0), '') AS s0 FROM u GROUP BY b, m)
SELECT b AS manufacturer, m AS model, y AS year, v AS power_hp, list_reduce(list_concat([s0], coalesce(l, [])), lambda a, x: CASE WHEN contains(a, x) THEN a WHEN a = '' THEN x ELSE a || ',' || x END) AS sources FROM g LEFT JOIN told USING (b, m)
""")
def a25_upsert_scraped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped pages merged by equal names into a stored catalog."""
    cars = _cars(spark, sf_dir)
    with scratch(spark) as path:
        stored = StoredCatalog.create(cars.where("seq % 4 = 0"), path, _NONE, buckets=24, dedupe=False)
        stored.upsert(cars.where("seq % 4 <> 0"), "first")
        return cut(stored.read().select("manufacturer", "model", F.nullif("year", F.lit("")).alias("year"), "power_hp", "sources"))


@query(f"WITH r AS ({_CARS_SQL}), t AS ({_once('(SELECT b, m, y, v, k AS o FROM r)')}) SELECT {_ID} AS car_id, b AS manufacturer, m AS model, nullif(y, '') AS year, v AS power_hp, o AS seq, (SELECT count(*) FROM r) AS n_before, (SELECT count(*) FROM t) AS n_after, (SELECT count(*) FROM t) AS n_dry FROM t")
def a24_dedupe_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deduplication job on a stored catalog, after a dry run."""
    with scratch(spark) as path:
        stored = StoredCatalog.create(_cars(spark, sf_dir).drop("sources"), path, _NONE, buckets=24, dedupe=False)
        dry = stored.dedupe(dry_run=True)
        done = stored.dedupe()
        sizes = {"n_before": done.before, "n_after": done.after, "n_dry": dry.after}
        return cut(stored.read().select("car_id", "manufacturer", "model", F.nullif("year", F.lit("")).alias("year"), "power_hp", F.col("seq").cast("long").alias("seq")).withColumns({k: F.lit(v).cast("long") for k, v in sizes.items()}))


# --- Counts of a changing catalog (D1 to D6) ---

_POWERS = next(vs for m, *_, vs in facets.THRESHOLDS if m == "power")


@query(f"""
WITH r AS ({_CARS_SQL}), t0 AS ({_once("(SELECT b, m, y, v, k AS o FROM r WHERE part4 < 2)")}), u1 AS (SELECT b, m, y, v, o FROM t0 UNION ALL SELECT b, m, y, v, {_BATCH} + k FROM r WHERE part4 >= 2 AND b LIKE 'Brand#2%'), m1 AS ({_merged("u1", _BATCH)}), t1 AS ({_once("m1")}), c AS (SELECT * FROM t1 WHERE y <> '')
SELECT 'facet' AS kind, 'manufacturer' AS name, b AS value, count(*) AS count FROM c GROUP BY b UNION ALL SELECT 'year', 'year', y, count(*) FROM c GROUP BY y UNION ALL SELECT 'facet', 'country', 'C', count(*) FROM c UNION ALL SELECT 'total', 'rows', '', count(*) FROM c
""" + "".join(f" UNION ALL SELECT 'threshold', 'power', '> {v:g} hp', count(*) FILTER (WHERE v > {v}) FROM c" for v in _POWERS))
def d01_d06_meta_by_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the filter panel counts, kept as a table and moved on by what an upsert removed and added."""
    cars = _cars(spark, sf_dir).drop("sources")
    with scratch(spark) as path:
        stored = StoredCatalog.create(cars.where("seq % 4 < 2"), path, _NONE, buckets=24)
        state = cut(facets.counted(stored.read()))
        done = stored.upsert(cars.where("seq % 4 >= 2 and manufacturer like 'Brand#2%'"))
        out = facets.moved(state, done.removed, done.added)
        return cut(out.where("kind <> 'threshold' or name = 'power'"))


# --- Requests, report and definitions of a catalog (A21, A22, A23, H21) ---

_REQUESTS = {
    "?drivetrain=R&powerMin=900&sortBy=power_hp&sortOrder=desc&pageSize=20&page=2": ("drivetrain = 'R' AND power_hp >= 900", "power_hp DESC NULLS LAST", 20, 20),
    "manufacturer=Brand%2311&yearMin=1995&yearMax=": ("manufacturer = 'Brand#11' AND cast(year AS int) >= 1995", "manufacturer, model", 50, 0),
    "weightMax=2000&sortBy=power_to_weight&pageSize=100": ("curb_weight_lb <= 2000", "ratio NULLS LAST", 100, 0),
}
_BAD = ("page=0", "pageSize=101", "sortOrder=up", "yearMin=soon", "powerMin=1e")



def _request_sql(text: str, where: str, order: str, size: int, offset: int) -> str:
    kept = f"(SELECT *, row_number() OVER (ORDER BY {order}, car_id) AS place FROM u WHERE {where})"
    total = f"(SELECT count(*) FROM u WHERE {where})"
    return f"SELECT '{text}' AS request, 200 AS status, place, car_id, power_hp, {total} AS total, cast(ceil({total} / {size}.0) AS bigint) AS pages FROM {kept} WHERE place > {offset} AND place <= {offset + size}"


# One row an id, as a catalog has it: the first by the rows' order.
@query(f"{_C}, u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY car_id ORDER BY {_KEYS}) = 1) " + " UNION ALL ".join([_request_sql(t, *x) for t, x in _REQUESTS.items()] + [f"SELECT '{t}', 400, NULL, NULL, NULL, NULL, NULL" for t in _BAD]))
def a21_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query strings answered from the stored catalog: the rows of each page, and what is refused."""
    rows = catalog(spark, sf_dir)
    columns = [c for c in rows.columns if c not in KEY]
    once = rows.groupBy("car_id").agg(F.min_by(F.struct(*[name(c) for c in columns]), F.struct(*KEY)).alias("r")).select("r.*")
    cars = cut(with_derived(once))
    out = []
    for text in (*_REQUESTS, *_BAD):
        status, body = rows_answer(cars, text)
        about = body.get("pagination", {})
        offset = (about["page"] - 1) * about["pageSize"] if about else 0
        page = [(text, status, offset + i + 1, r["car_id"], r["power_hp"], about["totalCount"], about["totalPages"]) for i, r in enumerate(body.get("data", []))]
        out += page or [(text, status, None, None, None, None, None)]
    return spark.createDataFrame(out, "request string, status int, place long, car_id string, power_hp double, total long, pages long")


def _described(column: str, shown: str, kind: str, low: float | None, high: float | None) -> str:
    outside = "false" if low is None else f"{column} < {low} OR {column} > {high}"
    return f"SELECT '{shown}' AS name, '{chr(34) + shown + chr(34) if shown[0].isdigit() else shown}: {kind}' || CASE WHEN count({column}) < count(*) THEN ' | null;' ELSE ';' END AS definition, count({column}) AS filled, count(*) FILTER (WHERE {outside}) AS outside FROM c"


_LIMITS = _BOUNDS | {"a_0_60": (1, 30), "quarter_mile_sec": (7, 25), "engine_displacement": (0.5, 10)}
_DESCRIBED = [_described(c, "0_60_mph_sec" if c == "a_0_60" else c, "number" if c in _LIMITS else "string", *_LIMITS.get(c, (None, None))) for c in ("car_id", "country", "year", "manufacturer", "model", "body_style", "drivetrain", "propulsion", "engine_type", "power_hp", "curb_weight_lb", "torque", "a_0_60", "quarter_mile_sec", "top_speed_mph", "engine_displacement", "sources")]


@query(f"{_C} " + " UNION ALL ".join(_DESCRIBED))
def a22_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_definitions(catalog(spark, sf_dir))


_FIELD_SQL = " UNION ALL ".join(f"SELECT 'fields' AS section, '{'0_60_mph_sec' if c == 'a_0_60' else c}' AS name, count({c}) AS count FROM c" for c in ("car_id", "country", "year", "manufacturer", "model", "body_style", "drivetrain", "propulsion", "engine_type", "power_hp", "curb_weight_lb", "torque", "a_0_60", "quarter_mile_sec", "top_speed_mph", "engine_displacement", "sources"))


@query(f"""
{_C}, s AS (SELECT trim(unnest(string_split(sources, ','))) AS value FROM c), f AS ({_FIELD_SQL} UNION ALL SELECT 'total', 'records', count(*) FROM c
  UNION ALL (SELECT 'sources', value, count(*) FROM s GROUP BY value ORDER BY count(*) DESC, value LIMIT 20) UNION ALL (SELECT 'manufacturers', manufacturer, count(*) FROM c GROUP BY manufacturer ORDER BY count(*) DESC, manufacturer LIMIT 20)
  UNION ALL (SELECT 'countries', country, count(*) FROM c GROUP BY country ORDER BY count(*) DESC, country LIMIT 20) UNION ALL SELECT 'years', 'first', min(cast(year AS int)) FROM c UNION ALL SELECT 'years', 'last', max(cast(year AS int)) FROM c),
  h AS (SELECT f.*, CASE WHEN section <> 'years' THEN count * 100.0::double / (SELECT count(*) FROM c) END AS share FROM f)
SELECT section, name, count, round(share, 6) AS share, repeat('█', cast(round_even(share / 5, 0) AS int)) || repeat('░', 20 - cast(round_even(share / 5, 0) AS int)) AS bar FROM h
""")
def a23_h21_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality report's figures with their bars."""
    return quality_report.report_table(catalog(spark, sf_dir)).withColumn("share", F.round("share", 6))


# --- Manufacturers as a table (C2-C5, F10) ---

_DICT = """
WITH d AS (SELECT DISTINCT p_brand AS name, 'B' AS country, false AS multi FROM part UNION ALL SELECT DISTINCT p_name, 'N', true FROM part UNION ALL SELECT c_name, c_mktsegment, false FROM customer),
a AS (SELECT p_type AS alias, min(p_brand) AS name FROM part WHERE p_type < 'M' GROUP BY p_type)"""


def _dictionary(spark: SparkSession, sf_dir: str, path: str) -> MakerTable:
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    names = _union([
        part.select(F.col("p_brand").alias("name"), F.lit("B").alias("country"), F.lit(False).alias("multi_word")).distinct(), part.select(F.col("p_name").alias("name"), F.lit("N").alias("country"), F.lit(True).alias("multi_word")).distinct(),
        customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("country"), F.lit(False).alias("multi_word")),
    ])
    return MakerTable.build(names, part.where("p_type < 'M'").groupBy(F.col("p_type").alias("alias")).agg(F.min("p_brand").alias("name")), path)


#: SQL of a vehicle's name and of a make field, by p_partkey; Spark and DuckDB read them alike.
_VEHICLE = """CASE p_partkey % 8 WHEN 0 THEN p_brand || ' ' || p_name WHEN 1 THEN upper(p_name) || ' -' || p_size WHEN 2 THEN p_size || ' ' || p_brand || ' ' || p_type WHEN 3 THEN lower(p_brand) || p_size
  WHEN 4 THEN p_size || ' ' || p_type WHEN 5 THEN p_type || ' ' || p_size || ' ' || p_name WHEN 6 THEN 'Customer#' || lpad(cast(p_partkey AS varchar(20)), 9, '0') || 'x ' || p_size WHEN 7 THEN 'x-' || p_size || ' ' || p_name END"""
_MAKE = "CASE p_partkey % 6 WHEN 0 THEN p_brand WHEN 1 THEN p_name || ' ' || p_size WHEN 2 THEN upper(replace(p_name, ' ', '-')) WHEN 3 THEN p_type WHEN 4 THEN p_brand || ' ' || p_type WHEN 5 THEN p_type || ' ' || p_brand END"


@query(f"""{_DICT}, t AS (SELECT p_partkey, {_VEHICLE} AS t FROM part), w AS (SELECT *, split_part(t, ' ', 1) AS word, substr(t, length(split_part(t, ' ', 1)) + 2) AS rest FROM t),
m AS (SELECT w.*, name, country, multi, 0 AS way FROM w JOIN d ON starts_with(lower(t), lower(name))
  UNION ALL SELECT w.*, name, country, false, 1 FROM w JOIN d ON starts_with(lower(rest) || ' ', lower(name) || ' ') AND regexp_full_match(word, '[a-zA-Z0-9_.-]+')),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY multi DESC, length(name) DESC, name, way) = 1)
SELECT w.p_partkey, CASE WHEN b.name IS NOT NULL THEN b.name WHEN regexp_full_match(w.word, '[0-9]+') AND w.rest != '' THEN '' ELSE coalesce(a.name, w.word) END AS manufacturer,
  CASE b.way WHEN 0 THEN regexp_replace(trim(substr(w.t, length(b.name) + 1)), '^[ /-]+', '') WHEN 1 THEN trim(w.word || ' ' || trim(substr(w.rest, length(b.name) + 1))) ELSE CASE WHEN regexp_full_match(w.word, '[0-9]+') AND w.rest != '' THEN w.t ELSE w.rest END END AS model,
  CASE WHEN b.name IS NOT NULL THEN b.country WHEN a.name IS NOT NULL THEN 'B' ELSE '' END AS country
FROM w LEFT JOIN b USING (p_partkey) LEFT JOIN a ON a.alias = w.word""")
def c03_c04_f10_maker_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as path:
        names = table(spark, sf_dir, "part").select("p_partkey", F.expr(_VEHICLE).alias("t"))
        return cut(_dictionary(spark, sf_dir, path).parse_names(names, "t").select("p_partkey", "parsed.*"))


@query(f"""{_DICT}, t AS (SELECT p_partkey, {_MAKE} AS t FROM part), w AS (SELECT *, split_part(t, ' ', 1) AS word, substr(t, length(split_part(t, ' ', 1)) + 2) AS rest FROM t),
m AS (SELECT p_partkey, name, country, 0 AS way FROM w JOIN d ON multi AND starts_with(lower(t), lower(name)) UNION ALL SELECT p_partkey, name, country, 1 FROM w JOIN d ON multi AND replace(lower(t), ' ', '-') = replace(lower(name), ' ', '-')),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(name) DESC, name, way) = 1)
SELECT w.p_partkey, coalesce(ta.name, td.name, b.name, wa.name, wd.name, w.t) AS manufacturer,
  CASE WHEN ta.name IS NOT NULL OR td.name IS NOT NULL THEN '' WHEN b.way = 0 THEN trim(substr(w.t, length(b.name) + 1)) WHEN b.way = 1 THEN '' WHEN wa.name IS NOT NULL OR wd.name IS NOT NULL THEN w.rest ELSE '' END AS model,
  CASE WHEN ta.name IS NOT NULL THEN 'B' WHEN td.name IS NOT NULL THEN td.country WHEN b.name IS NOT NULL THEN b.country WHEN wa.name IS NOT NULL THEN 'B' ELSE coalesce(wd.country, '') END AS country
FROM w LEFT JOIN b USING (p_partkey) LEFT JOIN a AS ta ON ta.alias = w.t LEFT JOIN d AS td ON td.name = w.t LEFT JOIN a AS wa ON wa.alias = w.word LEFT JOIN d AS wd ON wd.name = w.word""")
def c02_c05_maker_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as path:
        makes = table(spark, sf_dir, "part").select("p_partkey", F.expr(_MAKE).alias("t"))
        return cut(_dictionary(spark, sf_dir, path).split_makes(makes, "t").select("p_partkey", "parsed.*"))
