"""The row query: filters, order, page and count over the catalog."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marque.functions.columns import all_of, name
from marque.operators.search_index import SearchIndex
from marque.operators.store import DERIVED, tokens, with_derived
from marque.schema import COLUMNS

MAX_PAGE = 100
# The parameters of equality and bound filters and their columns.
EQUAL = {"manufacturer": "manufacturer", "country": "country", "bodyStyle": "body_style", "propulsion": "propulsion", "engineType": "engine_type", "engineAspiration": "engine_aspiration", "enginePlacement": "engine_placement", "drivetrain": "drivetrain"}
AT_LEAST = {"displacementMin": "engine_displacement", "powerMin": "power_hp", "topSpeedMin": "top_speed_mph", "torqueMin": "torque_prefix"}
AT_MOST = {"weightMax": "curb_weight_lb", "accel060Max": "0_60_mph_sec", "quarterMileMax": "quarter_mile_sec", "powerToWeightMax": "power_to_weight"}
_UNSORTED = {"car_id", "torque", "engine", "nurburgring_date", "nurburgring_driver", "top_gear_episode", "sources"}
SORTABLE = {**{c: c for c in COLUMNS if c not in _UNSORTED}, "power_to_weight": "power_to_weight", "torque": "torque_lbft"}


@dataclass(frozen=True)
class CatalogQuery:
    """Parameters of a row query; absent, empty and zero ones don't filter."""

    page: int = 1
    pageSize: int = 50
    sortBy: str | None = None
    sortOrder: str = "asc"
    search: str | None = None
    manufacturer: str | None = None
    country: str | None = None
    bodyStyle: str | None = None
    propulsion: str | None = None
    engineType: str | None = None
    engineAspiration: str | None = None
    enginePlacement: str | None = None
    drivetrain: str | None = None
    source: str | None = None
    yearMin: int | None = None
    yearMax: int | None = None
    displacementMin: float | None = None
    powerMin: float | None = None
    torqueMin: float | None = None
    topSpeedMin: float | None = None
    weightMax: float | None = None
    accel060Max: float | None = None
    quarterMileMax: float | None = None
    powerToWeightMax: float | None = None

    @classmethod
    def parse(cls, params: Mapping[str, object], strict: bool = True) -> CatalogQuery:
        """From request parameters: text becomes numbers, empty text is absent.

        strict refuses (ValueError) pages below 1, page sizes outside 1 to 100, unknown sort orders and
        what isn't a number; otherwise the page size is clamped.
        """
        out: dict[str, object] = {}
        for f in fields(cls):
            v = params.get(f.name)
            if v is None or v == "":
                continue
            if "str" in str(f.type):
                out[f.name] = str(v)
                continue
            try:
                x = float(v)  # type: ignore[arg-type]
            except (TypeError, ValueError) as e:
                raise ValueError(f"{f.name}: {v!r} isn't a number") from e
            if "int" in str(f.type) and x != int(x):
                raise ValueError(f"{f.name}: {v!r} isn't a whole number")
            out[f.name] = int(x) if "int" in str(f.type) else x
        q = cls(**out)  # type: ignore[arg-type]
        if q.sortOrder not in ("asc", "desc"):
            raise ValueError(f"sortOrder: {q.sortOrder!r}")
        if strict and (q.page < 1 or not 1 <= q.pageSize <= MAX_PAGE):
            raise ValueError("page must be 1 or more and pageSize 1 to 100")
        return q

    @property
    def size(self) -> int:
        return max(1, min(self.pageSize, MAX_PAGE))

    def predicates(self) -> list[Column]:
        """One predicate for each parameter that filters, and the base validity of rows."""
        out = [valid()]
        out += [name(c) == getattr(self, p) for p, c in EQUAL.items() if getattr(self, p)]
        out += [name(c) >= float(getattr(self, p)) for p, c in AT_LEAST.items() if getattr(self, p)]
        out += [name(c) <= float(getattr(self, p)) for p, c in AT_MOST.items() if getattr(self, p)]
        if self.yearMin:
            out.append(F.col("year_int") >= self.yearMin)
        if self.yearMax:
            out.append(F.col("year_int") <= self.yearMax)
        if self.source:
            out.append(F.array_contains("sources_arr", self.source))
        if self.search:
            out.append(matches(self.search))
        return out


def valid() -> Column:
    """Rows that every query keeps: with manufacturer, model and year."""
    return all_of(F.col(c) != "" for c in ("manufacturer", "model", "year"))


def matches(text: str | Column) -> Column:
    """All words of the text occur in the row, the last as a prefix. Text without words matches nothing."""
    def test(words: Column) -> Column:
        last = F.element_at(words, -1)
        head = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
        return (F.size(words) > 0) & F.forall(head, lambda t: F.array_contains("search_tokens", t)) & F.exists("search_tokens", lambda t: t.startswith(last))

    return F.element_at(F.transform(F.array(tokens(F.lit(text))), test), 1)


def prepared(catalog: DataFrame) -> DataFrame:
    """The catalog with its derived columns, unless it was stored with them."""
    return catalog if set(DERIVED) <= set(catalog.columns) else with_derived(catalog)


def filtered(catalog: DataFrame, q: CatalogQuery, index: SearchIndex | None = None) -> DataFrame:
    """The rows that the parameters keep. With an index a search reads the index; rows that may share their id with others are tested, too."""
    if index is None or not q.search:
        return prepared(catalog).where(all_of(q.predicates()))
    tested = replace(q, search=None) if index.about["unique"] else q
    return index.search(prepared(catalog).where(all_of(tested.predicates())), q.search)


def searched(catalog: DataFrame, texts: Iterable[str], index: SearchIndex) -> DataFrame:
    """What ``filtered`` finds by the index for each of several searches without other parameters, with its text (``search``)."""
    found = index.search_each(prepared(catalog).where(valid()), texts)
    return found if index.about["unique"] else found.where(matches(F.col("search")))


def ordering(q: CatalogQuery, tie: tuple[str, ...] = ("car_id",)) -> list[Column]:
    """The order of rows: nulls last either way; a unique key decides ties; unknown columns fall back to the default."""
    keys = [name(c).asc_nulls_last() for c in tie]
    column = SORTABLE.get(q.sortBy or "")
    if column is None:
        return [F.col("manufacturer").asc_nulls_last(), F.col("model").asc_nulls_last(), *keys]
    c = name(column)
    return [c.desc_nulls_last() if q.sortOrder == "desc" else c.asc_nulls_last(), *keys]


def page(catalog: DataFrame, q: CatalogQuery, tie: tuple[str, ...] = ("car_id",), index: SearchIndex | None = None) -> DataFrame:
    """The rows of a page: one top-k, not a sort of the catalog."""
    return filtered(catalog, q, index).orderBy(*ordering(q, tie)).offset((q.page - 1) * q.size).limit(q.size)


def pagination(catalog: DataFrame, q: CatalogQuery) -> DataFrame:
    """One row: page, page_size, total, total_pages."""
    n = F.count("*")
    return filtered(catalog, q).agg(F.lit(q.page).cast("long").alias("page"), F.lit(q.size).cast("long").alias("page_size"), n.alias("total"), F.ceil(n / q.size).cast("long").alias("total_pages"))


def run(catalog: DataFrame, q: CatalogQuery, index: SearchIndex | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The page in the catalog's columns, and its pagination."""
    rows = page(catalog, q, index=index)
    total = filtered(catalog, q, index).count()
    return rows.select(*[name(c) for c in COLUMNS if c in rows.columns]), {"page": q.page, "pageSize": q.size, "total": total, "totalPages": math.ceil(total / q.size)}


def display_ratio(curb: Column, power: Column) -> Column:
    """Weight per power as shown: one decimal; null for a weight that isn't positive or no power."""
    return F.when(curb > 0, F.round(F.try_divide(curb, power), 1))
