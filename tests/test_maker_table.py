"""Manufacturers found by the dictionary table, against the expression of the small dictionary and a sequential search."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from marque.operators import maker_table
from marque.operators.maker_table import MakerTable
from marque.operators.makers import Makers, country_of, parse_name, split_make
from marque.session import table_root
from tests.samples import MAKERS

MORE = Makers.of({
    "manufacturers": {**{k: {"country": v} for k, v in MAKERS.countries.items()}, "Mercedes": {"country": "DE"}, "smart": {"country": "DE"}, "Al": {"country": ""}, "De Tomaso": {"country": "IT"}, "bmw": {"country": "XX"}},
    "aliases": {**MAKERS.aliases, "Merc": "Mercedes", "Chevy Co": "Chevrolet", "ford": "Ford"},
    "multi_word_manufacturers": ["Alfa Romeo", "Mercedes-AMG", "Alfa", "Land Speed"],
})


def folder(spark) -> str:
    return f"{table_root(spark)}/makers-{uuid.uuid4().hex}"


def texts() -> list[str | None]:
    rng = random.Random(7)
    words = ["Alfa", "alfa", "ROMEO", "Romeo", "Giulia", "80", "1920", "Napier", "bmw", "BMW", "Bmw", "MGB", "MG", "mercedes", "amg", "Mercedes-AMG", "smart", "Al", "Alto", "De", "Tomaso", "Lucid", "Motors", "Chevy", "Co", "Land", "Speed", "x-1.5", "a/b", "-", "/", "Ford", "ford", "Fordson", "é", "Merc", "[1]", "unknown", "Tesla"]
    out = [rng.choice(["", " ", "  "]) + rng.choice([" ", "  ", "\t"]).join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(1500)]
    return [*out, None, "", "   ", "Porsche 911", "Porsche 911", "Alfa Romeo - / Giulia", "MG " + "x" * 100_000, "y" * 50_000 + " MG"]


@pytest.mark.parametrize(("makers", "broadcast"), [(MAKERS, maker_table.BROADCAST_BYTES), (MORE, maker_table.BROADCAST_BYTES), (MORE, 0), (Makers.of({}), 0)], ids=["plain", "clashing", "shuffled", "empty"])
def test_equals_the_expressions(spark, monkeypatch, makers, broadcast):
    monkeypatch.setattr(maker_table, "BROADCAST_BYTES", broadcast)
    table = MakerTable.of(spark, makers, folder(spark))
    df = spark.createDataFrame([(i, v, "kept") for i, v in enumerate(texts())], "head int, v string, parsed string")
    for by_table, by_expression in ((table.parse_names, parse_name), (table.split_makes, split_make)):
        got = {r["head"]: tuple(r["parsed"]) for r in by_table(df, "v").collect()}
        e = df.select("head", by_expression(F.col("v"), makers).alias("n")).select("head", "n.*", country_of(F.col("n.manufacturer"), makers).alias("country"))
        want = {r["head"]: (r["manufacturer"], r["model"], r["country"]) for r in e.collect()}
        assert len(got) == len(want) == len(texts())
        # country_of normalizes the canonical name once more, so an alias of a canonical name is told apart by name and model alone
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
        assert {v for v in got.values() if v[2] != dict(makers.countries).get(v[0], "")} == set()


def test_columns_and_no_rows(spark):
    table = MakerTable.of(spark, MAKERS, folder(spark))
    df = spark.createDataFrame([("Ford A", 1, 2), ("Ford A", 1, 2)], "`a.b` string, key int, _t int")
    assert [tuple(r[:3]) + tuple(r[3]) for r in table.parse_names(df, "a.b").collect()] == [("Ford A", 1, 2, "Ford", "A", "US")] * 2
    assert table.parse_names(df.limit(0), "a.b").columns == ["a.b", "key", "_t", "parsed"] and table.split_makes(df.limit(0), "a.b").count() == 0


def test_100_000_names(spark):
    rng = random.Random(3)
    syllables = ["ka", "ro", "mi", "te", "lu", "za", "no", "vi"]
    names = {"".join(rng.choices(syllables, k=rng.randint(2, 9))).capitalize() + rng.choice(["", "", " Motor", " Motor Works"]) for _ in range(150_000)}
    names = sorted(names)[:100_000]
    assert len(names) == 100_000
    rows = spark.createDataFrame([(n, n[:2].upper(), n.endswith("Works")) for n in names], "name string, country string, multi_word boolean")
    table = MakerTable.build(rows, spark.createDataFrame([], "alias string, name string"), folder(spark))
    asked = [rng.choice([n + " 12", n.upper() + "x", "80 " + n, "80 " + n + " z", n[:-1] + " q"]) for n in rng.sample(names, 3_000)]
    got = {r["t"]: tuple(r["parsed"])[:2] for r in table.parse_names(spark.createDataFrame([(a,) for a in asked], "t string"), "t").collect()}

    first = {}
    for n in names:  # the least of names equal but for case
        first.setdefault(n.lower(), n)

    def plainly(t: str) -> tuple[str, str]:
        prefixes = [(k, first[t[:k].lower()]) for k in range(len(t), 0, -1) if t[:k].lower() in first]
        spaced = [(k, n) for k, n in prefixes if n.endswith("Works")]
        word, _, rest = t.partition(" ")
        after = [(k, first[rest[:k].lower()]) for k in range(len(rest), 0, -1) if rest[:k].lower() in first and (k == len(rest) or rest[k] == " ")]
        if spaced:
            return spaced[0][1], t[spaced[0][0] :].strip()
        best = min([(-k, n, 0) for k, n in prefixes[:1]] + [(-k, n, 1) for k, n in after[:1]], default=None)
        if best and best[2] == 0:
            return best[1], t[-best[0] :].strip()
        if best:
            return best[1], f"{word} {rest[-best[0] :].strip()}".strip()
        return ("", t) if word.isdigit() and rest else (word, rest)

    assert got == {t: plainly(t) for t in asked}
    plan = table.parse_names(rows, "name")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
