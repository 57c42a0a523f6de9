"""Column helpers that the rest is built of."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(column: str) -> Column:
    """A column by its whole name, which may begin with a digit or hold a dot."""
    return F.col(f"`{column}`")


def filled(c: Column) -> Column:
    """Neither null nor blank nor zero: what counts as a value when records are merged."""
    return F.coalesce((c.cast("string") != "") & (F.coalesce(c.try_cast("double"), F.lit(1.0)) != 0), F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, or null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, n))


def let(value: Column, body) -> Column:
    """body(value), the value evaluated once however often the body names it. No Python function may be inside."""
    return F.element_at(F.transform(F.array(value), body), 1)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def first_match(rules: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """CASE WHEN in the order of the rules."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(default) if out is None else out.otherwise(default)
