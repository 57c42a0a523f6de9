"""Request text to answer: the rows, the filter panel and the percentiles as JSON, for whatever server stands in front."""

from __future__ import annotations

import json
from urllib.parse import parse_qsl

from pyspark.sql import DataFrame

from marque.operators import facets, percentiles
from marque.operators.catalog_query import CatalogQuery, run
from marque.operators.search_index import SearchIndex


def parameters(text: str) -> dict[str, str]:
    """The parameters of a query string, without its question mark; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for k, v in parse_qsl(text.lstrip("?"), keep_blank_values=True):
        out.setdefault(k, v)
    return out


def rows_answer(catalog: DataFrame, text: str, index: SearchIndex | None = None) -> tuple[int, dict]:
    """(status, body): 200 with a page of rows in the catalog's columns and its pagination, or 400 for parameters that don't parse."""
    try:
        q = CatalogQuery.parse(parameters(text))
    except ValueError as e:
        return 400, {"error": "Invalid query parameters", "details": str(e)}
    rows, about = run(catalog, q, index)
    return 200, {"data": [r.asDict() for r in rows.collect()], "pagination": {"page": about["page"], "pageSize": about["pageSize"], "totalCount": about["total"], "totalPages": about["totalPages"]}}  # a page


def meta_answer(state: DataFrame) -> dict:
    """The filter panel of kept counts (facets.counted): total, values of each facet and source by count, thresholds, years."""
    out: dict = {"total": 0, "facets": {}, "sources": [], "thresholds": {}, "years": None}
    years = []
    for r in state.orderBy("kind", "name", state["count"].desc(), "value").toLocalIterator():
        cell = {"value": r["value"], "count": r["count"]}
        if r["kind"] == "total":
            out["total"] = r["count"]
        elif r["kind"] == "year":
            years.append(int(r["value"]))
        elif r["kind"] == "source":
            out["sources"].append(cell)
        else:
            out["facets" if r["kind"] == "facet" else "thresholds"].setdefault(r["name"], []).append(cell)
    order = {m: [label.format(f"{v:g}" if m != "displacement" else f"{v:.1f}") for v in vs] for m, _, _, label, vs in facets.THRESHOLDS}
    for m, cells in out["thresholds"].items():
        cells.sort(key=lambda c: order[m].index(c["value"]))
    if years:
        out["years"] = {"min": min(years), "max": max(years)}
    return out


def percentiles_answer(catalog: DataFrame) -> dict:
    """The percentiles of each column with enough values, with the side that is better."""
    got = percentiles.percentiles(catalog).where("p10 is not null").collect()  # a row a column
    return {r["column"]: {"p10": r["p10"], "p90": r["p90"], "lowerIsBetter": r["column"] in percentiles.LOWER} for r in sorted(got, key=lambda r: r["column"])}


def as_json(body: dict) -> str:
    """The body as JSON text."""
    return json.dumps(body, ensure_ascii=False, default=str)
