"""Staging of changed files only, and counters taken while a step's result is written."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from marque.operators import clean, enrich
from marque.operators.quality_report import Watched, step_counts
from marque.plans import catalog_pipeline as cp
from marque.schema import COLUMNS, conform
from marque.session import cut
from marque.sources import changes, readers, registry
from marque.sources.changes import StagedFiles, listed_files, stage_changed
from tests.samples import MAKERS, write_files


def _put(folder, name, rows, time=None):
    p = folder / name
    p.write_text("a,b\n" + "".join(f"{x},{y}\n" for x, y in rows), encoding="utf-8")
    if time is not None:
        os.utime(p, (time, time))
    return p


class Reader:
    """readers.read_csv that remembers which files it was given."""

    def __init__(self, spark):
        self.spark, self.read = spark, []

    def __call__(self, paths):
        self.read += [p.rpartition("/")[2] for p in paths]
        return readers.read_csv(self.spark, [changes.literal_path(p) for p in paths])


def _rows(df):
    return sorted((r.a, r.b, r.source_file.rpartition("/")[2], r.source_row) for r in df.collect())


def test_only_changed_files_are_read(spark, tmp_path):
    src, store = tmp_path / "src", StagedFiles(spark, f"file://{tmp_path}/store")
    src.mkdir()
    with pytest.raises(ValueError):
        store.read()
    for n, rows in {"one.csv": [(1, 2), (1, 2)], "two x,y 3.csv": [(3, 4)], "empty.csv": [], "gone.csv": [(9, 9)]}.items():
        _put(src, n, rows, 1000)
    go = lambda r: store.refresh(listed_files(spark, str(src), "*.csv"), r)
    whole = lambda: _rows(readers.read_csv(spark, str(src / "*.csv")))
    first = Reader(spark)
    c = go(first)
    assert sorted(first.read) == sorted(os.listdir(src)) and len(c.added) == 4 and not (c.changed or c.touched or c.removed or c.unchanged)
    assert _rows(store.read()) == whole()
    idle = Reader(spark)
    c = go(idle)
    assert idle.read == [] and c.unchanged == 4 and not c.parsed and _rows(store.read()) == whole()
    # one file of another content, and one of the same length as before; one only touched; one new; one gone
    _put(src, "one.csv", [(1, 2), (7, 8)], 1001)
    _put(src, "two x,y 3.csv", [(3, 4)], 1002)
    _put(src, "new.csv", [(5, 6)], 1003)
    (src / "gone.csv").unlink()
    second = Reader(spark)
    c = go(second)
    assert sorted(second.read) == ["new.csv", "one.csv"]
    assert [len(x) for x in (c.added, c.changed, c.touched, c.removed)] == [1, 1, 1, 1] and c.unchanged == 1
    assert _rows(store.read()) == whole()
    store.compact()
    assert _rows(store.read()) == whole() and len(os.listdir(tmp_path / "store" / "rows")) == 1
    third = Reader(spark)
    assert not go(third).parsed and third.read == []
    # another parser reads everything again
    fourth = Reader(spark)
    assert len(store.refresh(listed_files(spark, str(src), "*.csv"), fourth, version="2").changed) == 4 and len(fourth.read) == 4
    assert _rows(store.read()) == whole()
    for p in src.iterdir():
        p.unlink()
    (src / "_hidden").write_text("x")
    none = store.refresh(listed_files(spark, str(src), "*.csv"), Reader(spark), version="2")
    assert len(none.removed) == 4 and store.read().count() == 0 and {"a", "b", "source_file"} <= set(store.read().columns)


def test_a_failed_refresh_leaves_the_old_state(spark, tmp_path):
    src, store = tmp_path / "src", StagedFiles(spark, f"file://{tmp_path}/store")
    src.mkdir()
    _put(src, "one.csv", [(1, 2)], 1000)
    go = lambda parse: store.refresh(listed_files(spark, str(src)), parse)
    go(Reader(spark))
    before = _rows(store.read())
    _put(src, "one.csv", [(3, 4)], 1001)
    fails = lambda paths: Reader(spark)(paths).withColumn("a", F.expr("cast(raise_error('stop') AS string)"))
    with pytest.raises(Exception, match="stop"):
        go(fails)
    assert _rows(store.read()) == before
    go(Reader(spark))
    assert [r[:2] for r in _rows(store.read())] == [("3", "4")]


def test_a_large_file_counts_by_size_and_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "HASHED_BYTES", 4)
    src, store = tmp_path / "src", StagedFiles(spark, f"file://{tmp_path}/store")
    src.mkdir()
    _put(src, "one.csv", [(1, 2)], 1000)
    go = lambda: store.refresh(listed_files(spark, str(src)), Reader(spark))
    assert len(go().added) == 1 and go().unchanged == 1
    _put(src, "one.csv", [(1, 2)], 1001)
    assert len(go().changed) == 1


def test_staged_sources_equal_a_full_staging(spark, tmp_path):
    src = write_files(tmp_path / "src")
    (src / "po").mkdir()
    shutil.copy(src / "po.csv", src / "po" / "x.csv")
    specs = [registry.SourceSpec("tg", "top_gear", f"{src}/tg.csv"), registry.SourceSpec("po", "power_output", f"{src}/po", skip_files=("skip.csv",)), registry.SourceSpec("ae", "autoevolution", f"{src}/a"), registry.SourceSpec("off", "kaggle", "none", enabled=False)]
    key = lambda s: (sorted(map(str, s.rows.select("seq", "manufacturer", "model", "year", "power_hp", "sources").collect())), sorted(map(str, s.rejects.collect())))
    at = f"file://{tmp_path}/kept"

    def both(makers=MAKERS):
        got, seen = stage_changed(spark, specs, makers, at)
        assert key(got) == key(registry.stage(spark, specs, makers))
        return {n: (len(c.parsed), len(c.removed), c.unchanged) for n, c in seen.items()}

    assert both() == {"tg": (1, 0, 0), "po": (1, 0, 0), "ae": (2, 0, 0)}
    assert both() == {"tg": (0, 0, 1), "po": (0, 0, 1), "ae": (0, 0, 2)}
    shutil.copy(src / "po.csv", src / "po" / "a.csv")
    shutil.copy(src / "po.csv", src / "po" / "skip.csv")
    (src / "a" / "automobiles.csv").write_text('id,image,brand_id,name\n1,"ALFA ROMEO  Giulia 2017-2020 Photos, engines &amp; full specs",1,http://x\n')
    assert both() == {"tg": (0, 0, 1), "po": (1, 0, 1), "ae": (2, 0, 0)}  # a pair is read together
    (src / "po" / "x.csv").unlink()
    assert both(type(MAKERS)(dict(MAKERS.countries) | {"Zed": "XX"}, MAKERS.aliases, MAKERS.multi_word, MAKERS.country_names)) == {"tg": (1, 0, 0), "po": (1, 1, 0), "ae": (2, 0, 0)}
    one = cp.run(spark, specs, MAKERS, dry_run=True, kept=at, names=["tg", "off"])
    assert [(r.manufacturer, r.model) for r in one.catalog.collect()] == [("Porsche", "Carrera GT")] and one.changes["tg"].parsed and one.counts["sources_normalized"] == 0 and one.counts["engine_placement_inferred"] == 1


def _cars(spark):
    rows = [
        {"manufacturer": "2010Ford", "model": "X coupe", "top_speed_mph": 200.0, "power_kw": 100.0}, {"manufacturer": "FORD", "model": "2001 Van", "body_style": "Coupe", "sources": "Wikipedia - a"}, {"manufacturer": "A", "model": "b 2018-Present", "0_60_mph_sec": 3.0, "quarter_mile_sec": 2.9},
        {"manufacturer": "Porsche", "model": "911", "body_style": "Coupe", "engine_type": "H6", "propulsion": "Petrol"}, {},
    ]
    df = spark.createDataFrame([tuple(str(r[c]) if c in r else None for c in COLUMNS) for r in rows], ", ".join(f"`{c}` string" for c in COLUMNS))
    return conform(df, F.monotonically_increasing_id().alias("seq"))


@pytest.mark.parametrize(("steps", "apply"), [(enrich.COUNTED, enrich.enrich), (clean.COUNTED, clean.clean)])
def test_counters_of_the_write(spark, steps, apply):
    for df in (_cars(spark), cut(_cars(spark).repartition(5))):
        seen = Watched(df, steps)
        out = cut(seen.df)
        assert seen.counts() == {r.step: r.changed for r in step_counts(df, steps).collect()} and any(seen.counts().values())
        assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, apply(df).collect()))
    empty = Watched(_cars(spark).where("false"), steps)
    assert cut(empty.df).count() == 0 and set(empty.counts().values()) == {0}


def test_counters_cost_no_job(spark):
    df = cut(_cars(spark))
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()

    def jobs(group, act):
        sc.setJobGroup(group, group)
        act()
        sc.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    plain = jobs("plain", lambda: cut(enrich.enrich(df)))
    seen = Watched(df, enrich.COUNTED)
    assert jobs("watched", lambda: (cut(seen.df), seen.counts())) == plain
