"""The search index, the stored catalog, deep pages, clustered files and percentiles against plainer ways."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marque.operators import catalog_query as cq
from marque.operators import facets, percentiles
from marque.operators.page_directory import PageDirectory, order_of
from marque.operators.search_index import SearchIndex
from marque.operators.store import interleaved, with_derived, write_catalog, write_clustered
from marque.operators.stored_catalog import StoredCatalog
from marque.operators.survivorship import deduplicate, merge, merge_filling_year, merge_first
from tests.samples import MAKERS

CAR = "car_id string, manufacturer string, model string, year string, power_hp double"


def _cars(spark, n=600, seed=1, kind=CAR):
    rnd = random.Random(seed)
    names = ["911", "Carrera GT", "Élan", "car", "carbon", "M5", "M3 CS", "Škoda-like", "x" * 40, ""]
    return spark.createDataFrame([(f"id-{i}", rnd.choice(["Porsche", "BMW", "Alfa Romeo", "Ford"]), " ".join(rnd.sample(names, 2)), str(1990 + rnd.randrange(30)), rnd.choice([None, 0.0, *range(100, 900, 7)]) and float(rnd.randrange(100, 900))) for i in range(n)], kind)


# --- the search index ---

TEXTS = ["ca", "PORSCHE carrera", "elan", "bmw m", "id-17", "carbon car", "nothing", "  ", "911 9", "skoda like f"]


def test_index_equals_the_scan(spark, tmp_path):
    cars = with_derived(_cars(spark).unionByName(spark.createDataFrame([("id-0", "Lucid", "car", "2001", 1.0), ("id-0", "Ford", "zz", "2001", 1.0)], CAR))).cache()
    index = SearchIndex.build(cars, f"file://{tmp_path}", folders=9, piece=50)
    for t in TEXTS:
        q = cq.CatalogQuery(search=t)
        rows = lambda index, q=q: sorted(map(str, cq.filtered(cars, q, index).drop("search_tokens").collect()))
        assert rows(index) == rows(None), t
        assert cq.pagination(cars, q).first()["total"] == len(rows(None))
    assert cq.run(cars, cq.CatalogQuery(search="porsche 9"), index)[1] == cq.run(cars, cq.CatalogQuery(search="porsche 9"))[1]


def test_index_reads_the_words_files(spark, tmp_path):
    cars = with_derived(_cars(spark))
    index = SearchIndex.build(cars, f"file://{tmp_path}", folders=12, piece=50)
    everything = spark.read.parquet(f"{index.path}/postings")
    assert len(everything.inputFiles()) >= 10
    for t in ("elan", "m5", "id-17", "porsche 9"):
        own = index.files(t)
        assert 0 < len(own) < len(everything.inputFiles())
        sought = [F.col("token") == w for w in ("elan", "m5", "id", "porsche") if w in t] + [F.col("token").startswith({"elan": "elan", "m5": "m5", "id-17": "17", "porsche 9": "9"}[t])]
        needed = everything.where(sought[0] | sought[-1]).select(F.input_file_name()).distinct().collect()
        assert {r[0] for r in needed} <= set(own)
    assert index.files("zzzz") == [] or len(index.files("zzzz")) == 1
    assert index.files("") == []
    # a hot token lies in pieces of bounded size
    assert everything.where("token = 'id'").count() >= 600 // 50
    assert everything.agg(F.max(F.size("ids"))).first()[0] <= 100


def test_empty_index(spark, tmp_path):
    cars = with_derived(_cars(spark).limit(0))
    index = SearchIndex.build(cars, f"file://{tmp_path}")
    assert index.ids("car").count() == 0


# --- the stored catalog ---

STORED = "seq long, manufacturer string, model string, country string, year string, power_hp double, propulsion string, sources string"


def _batch(spark, n, seed):
    rnd = random.Random(seed)
    models = ["911", "911 (992)", "911992", "M5", "m-5", "M 5", "Giulia", "Giulia Quadrifoglio", "porsche 911"]
    pick = lambda *xs: rnd.choice(xs)
    rows = [(i, pick("Porsche", "porsche", "BMW", "Bmw", "Alfa"), rnd.choice(models), pick("", "DE", None), pick("", None, "2001", "2002"), pick(None, 0.0, 300.0, 400.0), pick(None, "ICE", "Petrol"), pick("a", "b", "a, c", None)) for i in range(n)]
    return spark.createDataFrame(rows, STORED)


def _set(df):
    cols = ["car_id", "manufacturer", "model", "country", "year", "power_hp", "propulsion", "sources"]
    return sorted(str(tuple(r[c] or None for c in cols)) for r in df.select(*cols).collect())


def _held(spark, df, stored):
    """df in the stored columns, as literal rows."""
    return spark.createDataFrame(df.select(*stored.read().columns).collect(), stored.read().schema)


@pytest.mark.parametrize(("variant", "merged"), [("key", merge), ("fill_year", merge_filling_year)])
def test_upserts_equal_the_full_merge(spark, tmp_path, variant, merged):
    stored = StoredCatalog.create(_batch(spark, 30, 1), f"file://{tmp_path}", MAKERS, buckets=16)
    expected = _held(spark, deduplicate(_batch(spark, 30, 1), MAKERS), stored)
    for k, (n, seed) in enumerate([(4, 2), (25, 3)]):
        new = _batch(spark, n, seed)
        after = deduplicate(merged(expected, new.withColumn("seq", F.col("seq") + 1000 * (k + 1)), MAKERS), MAKERS)
        before = stored.files()
        done = stored.upsert(new, variant)
        assert _set(stored.read()) == _set(after)
        assert done.after == after.count()
        kept = {f for f, b in before.items() if b not in done.buckets}
        assert kept <= set(stored.files()) and not {f for f, b in before.items() if b in done.buckets} & set(stored.files())
        expected = _held(spark, after, stored)


def test_upsert_of_nothing_and_again(spark, tmp_path):
    stored = StoredCatalog.create(_batch(spark, 30, 1), f"file://{tmp_path}", MAKERS, buckets=8)
    files = stored.files()
    assert stored.upsert(_batch(spark, 5, 1).limit(0)).buckets == ()
    assert stored.files() == files
    stored.upsert(_batch(spark, 9, 5))
    once = _set(stored.read())
    stored.upsert(_batch(spark, 9, 5))
    assert _set(stored.read()) == once
    empty = StoredCatalog.create(_batch(spark, 5, 1).limit(0), f"file://{tmp_path}/empty", MAKERS, buckets=4)
    empty.upsert(_batch(spark, 5, 1))
    assert _set(empty.read()) == _set(deduplicate(merge(_batch(spark, 5, 1).limit(0), _batch(spark, 5, 1), MAKERS), MAKERS))


def test_dedupe_rewrites_repeated_ones_only(spark, tmp_path):
    rows = _batch(spark, 60, 4).unionByName(spark.createDataFrame([(100 + i, "Ford", f"only {i}", None, "2001", 1.0, None, None) for i in range(30)], STORED))
    stored = StoredCatalog.create(rows, f"file://{tmp_path}", MAKERS, buckets=32, dedupe=False)
    files = stored.files()
    dry = stored.dedupe(dry_run=True)
    assert stored.files() == files
    done = stored.dedupe()
    assert (done.before, done.after, done.buckets) == (90, dry.after, dry.buckets) and len(done.buckets) < 32
    assert _set(stored.read()) == _set(deduplicate(rows, MAKERS))
    assert {f for f, b in files.items() if b not in done.buckets} <= set(stored.files())
    assert stored.dedupe().buckets == ()


def test_scraped_pages_merge_by_name(spark):
    """Held against the sequential rule."""
    old, new = [[r.asDict() for r in _batch(spark, n, s).collect()] for n, s in ((40, 6), (60, 7))]
    told = {}
    for r in sorted(old, key=lambda r: r["seq"]):
        told.setdefault((r["manufacturer"], r["model"]), dict(r))
    known = set(told)
    for r in sorted(new, key=lambda r: r["seq"]):
        key = (r["manufacturer"], r["model"])
        if key not in told:
            told[key] = dict(r)
            continue
        have = told[key]
        for c in ("year", "power_hp", "propulsion", *(("country",) if key in known else ())):
            have[c] = have[c] or r[c]
        if r["sources"] and r["sources"] not in (have["sources"] or ""):
            have["sources"] = f"{have['sources']},{r['sources']}" if have["sources"] else r["sources"]
    got = merge_first(_batch(spark, 40, 6), _batch(spark, 60, 7), MAKERS).collect()
    cols = ("year", "power_hp", "propulsion", "sources")
    assert {(r["manufacturer"], r["model"]): tuple(r[c] or None for c in cols) for r in got} == {k: tuple(v[c] or None for c in cols) for k, v in told.items()}
    assert all((r["country"] or None) == (told[r["manufacturer"], r["model"]]["country"] or None) for r in got if (r["manufacturer"], r["model"]) in known)


def test_counts_move_with_the_catalog(spark, tmp_path):
    stored = StoredCatalog.create(_batch(spark, 40, 1), f"file://{tmp_path}", MAKERS, buckets=16)
    state = facets.counted(stored.read()).collect()
    kind = facets.counted(stored.read()).schema
    for seed in (2, 3):
        done = stored.upsert(_batch(spark, 12, seed))
        state = facets.moved(spark.createDataFrame(state, kind), done.removed, done.added).collect()
        fresh = facets.counted(stored.read()).collect()
        assert sorted(map(tuple, state)) == sorted(map(tuple, fresh))
    assert tuple(facets.year_span(spark.createDataFrame(state, kind)).first()) == (2001, 2002)


# --- deep pages ---


@pytest.mark.parametrize(("sort", "order"), [("power_hp", "desc"), ("power_hp", "asc"), (None, "asc"), ("year", "desc")])
def test_pages_equal_offsets(spark, tmp_path, sort, order):
    cars = _cars(spark, 333)
    q = cq.CatalogQuery(sortBy=sort, sortOrder=order, manufacturer="BMW" if sort == "year" else None, pageSize=10)
    listing = PageDirectory.build(cars, q, f"file://{tmp_path}", ranges=7)
    whole = [r["car_id"] for r in cq.filtered(cars, q).orderBy(*cq.ordering(q)).collect()]
    ranges = listing.ranges().collect()
    assert listing.total() == len(whole) and len(ranges) > 4 and max(r["n"] for r in ranges) < len(whole) / 2
    pages = -(-len(whole) // 10)
    assert listing.pagination(2, 10) == {"page": 2, "pageSize": 10, "total": len(whole), "totalPages": pages}
    for p in (1, 2, pages // 2, pages, pages + 1):
        assert [r["car_id"] for r in listing.page(p, 10).collect()] == whole[(p - 1) * 10 : p * 10]
    assert [r["car_id"] for r in listing.page(1, 200).collect()] == whole[:200]
    for at in (0, len(whole) // 2, len(whole) - 3, len(whole) - 1):
        row = cars.where(F.col("car_id") == whole[at]).first().asDict()
        assert [r["car_id"] for r in listing.after(listing.cursor(row, order_of(q)), 10).collect()] == whole[at + 1 : at + 11]
    assert [r["car_id"] for r in listing.after({}, 5).collect()] == whole[:5]


def test_a_page_reads_its_range(spark, tmp_path):
    listing = PageDirectory.build(_cars(spark, 333), cq.CatalogQuery(), f"file://{tmp_path}", ranges=8)
    assert len({f.rpartition("/")[0] for f in listing.page(30, 5).inputFiles()}) <= 2
    empty = PageDirectory.build(_cars(spark, 5).limit(0), cq.CatalogQuery(), f"file://{tmp_path}/none")
    assert empty.page(1, 10).collect() == [] and empty.total() == 0 and empty.after({"manufacturer": "a", "model": "b", "car_id": "c"}, 5).collect() == []


# --- clustered files ---


def _scanned(df) -> int:
    """Rows that the scan gives to the filter, after row groups and pages are skipped."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan()
    while leaf.children().size():
        leaf = leaf.children().apply(0)
    return int(leaf.metrics().apply("numOutputRows").value())


def test_clustered_files_skip_more(spark, tmp_path):
    rnd = random.Random(2)
    cars = spark.createDataFrame([(f"{i:05d}", f"maker {rnd.randrange(40):02d}", f"m{i}", str(1950 + rnd.randrange(70)), rnd.choice([None, float(rnd.randrange(50, 1000))])) for i in range(20_000)], CAR)
    write_catalog(cars, f"file://{tmp_path}/sorted", 32)
    write_clustered(cars, f"file://{tmp_path}/clustered", 32)
    plain, near = (spark.read.parquet(f"file://{tmp_path}/{n}") for n in ("sorted", "clustered"))
    asked = {"power": cq.CatalogQuery(powerMin=950), "years": cq.CatalogQuery(yearMin=1960, yearMax=1962), "both": cq.CatalogQuery(yearMin=2000, powerMin=900), "maker": cq.CatalogQuery(manufacturer="maker 07"), "all": cq.CatalogQuery(manufacturer="maker 07", powerMin=900)}
    seen = {}
    for n, q in asked.items():
        a, b = cq.filtered(plain, q).select("car_id"), cq.filtered(near, q).select("car_id")
        assert sorted(a.collect()) == sorted(b.collect())
        seen[n] = _scanned(a), _scanned(b)
    assert seen["power"][1] * 2 < seen["power"][0] and seen["years"][1] * 2 < seen["years"][0] and seen["both"][1] * 3 < seen["both"][0], seen
    one = near.where("car_id = '00777'").select("model")
    assert [r[0] for r in one.collect()] == ["m777"] and _scanned(one) < 20_000 / 4
    assert near.count() == 20_000 and near.where("power_hp is null").count() == cars.where("power_hp is null").count()


def test_interleaving(spark):
    got = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a int, b int").select("a", "b", interleaved([F.col("a"), F.col("b")], 2).alias("z")).collect()
    assert {(r["a"], r["b"]): r["z"] for r in got} == {(a, b): ((a >> 1) << 3) | ((b >> 1) << 2) | ((a & 1) << 1) | (b & 1) for a in range(4) for b in range(4)}
    write_clustered(_cars(spark, 5).limit(0), f"{spark.conf.get('spark.checkpoint.dir')}/no-cars")


# --- percentiles ---


def _expected(values):
    n = len(values)
    return (n, *((sorted(values)[int(n * p)] for p in (0.1, 0.9)) if n >= 10 else (None, None)))


@pytest.mark.parametrize("sketch", [8, 60, 4096])
def test_percentiles_by_sketches(spark, sketch):
    rnd = random.Random(sketch)
    draw = {"power_hp": lambda: rnd.choice([None, 100.0, 100.0, float(rnd.randrange(10_000))]), "quarter_mile_sec": lambda: rnd.random(), "skidpad_g": lambda: 1.0, "curb_weight_lb": lambda: None}
    rows = [("m", "x", "2001", *(f() for f in draw.values()), float(i) if i < 9 else None, float(i) if i < 10 else None) for i in range(3000)]
    cols = [*draw, "top_speed_mph", "top_speed_kmh"]
    cars = spark.createDataFrame(rows, "manufacturer string, model string, year string, " + ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = {r["column"]: (r["n"], r["p10"], r["p90"]) for r in percentiles.percentiles(cars, sketch=sketch).collect()}
    wanted = {c: [r[3 + i] for r in rows if r[3 + i] is not None] for i, c in enumerate(cols)}
    wanted["power_to_weight"] = []
    assert got == {c: _expected(v) for c, v in wanted.items() if v}
    assert percentiles.percentiles(cars.limit(0)).collect() == []
    odd = cars.where("quarter_mile_sec < 0.1").withColumn("skidpad_g", F.lit(float("nan"))).drop("power_hp", "curb_weight_lb", "top_speed_mph", "top_speed_kmh", "quarter_mile_sec")
    assert [str(r["p10"]) for r in percentiles.percentiles(odd, sketch=sketch).collect()] == ["nan"]
