"""Queries over whole tables whose rules SQL can't express, against Python."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from marque.functions import classify
from marque.plans import driver_queries

SF = Path("/root/testdata/sf0.001")
NOISE = re.compile(r"\s*\[[^\]]*\]|\s*\([^)]*citation[^)]*\)|—?N/?[Aa]|\best\.?\b|\bEST\.?\b|\bclaim(?:ed)?\b", re.I)


def clean(t):
    return re.sub(r"\s+", " ", NOISE.sub("", t or "")).strip()


def same(spark, d):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.t for r in driver_queries.QUERIES["h01_h02_clean_text_whole"](spark, str(d)).collect()}
    assert got == {i: clean(t) for i, t in rows.items()}


def test_clean_text_of_what_it_removes(spark, tmp_path):
    texts = ["Fast [1] car (citation needed) (kept)", "N/A", "est. 300 hp, claimed", "Café  [a]\n né", "banana", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, tmp_path)


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
def test_clean_text_of_all_documents(spark):
    same(spark, SF)


def test_propulsion_of_all_parts(spark, tmp_path):
    parts = [(1, "V8 engine", "diesel"), (2, "electric battery", "X"), (3, "hybrid", "tdi"), (4, "plain", "STEEL"), (5, "flat turbo", ""), (6, "bev", "inline")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")

    def of(a, b):
        has = lambda p: re.search(p, f"{a} {b} ".lower()) is not None
        d, e, h = has(classify.DIESEL), has(classify.ELECTRIC), has(classify.HYBRID)
        both = "Electric/Diesel" if d else "Electric/Petrol"
        if e:
            return both if h or has(classify.ENGINE_PARTS) else "Electric"
        return both if h else ("Diesel" if d else "Petrol") if has(classify.COMBUSTION) else ""

    got = {r.p_partkey: r.propulsion for r in driver_queries.QUERIES["h50_propulsion_whole"](spark, str(tmp_path)).collect()}
    assert got == {k: of(a, b) for k, a, b in parts}
