"""The few functions that no built-in expression gives; each runs only on the rows that need it."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf


@pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def _repaired(x: str) -> str:
    try:
        return x.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return x


@pandas_udf(T.StringType())
def _repair(s: pd.Series) -> pd.Series:
    return s.map(_repaired, na_action="ignore")


@pandas_udf(T.DoubleType())
def _round(x: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else round(float(v), int(k)) for v, k in zip(x, n, strict=True)], dtype="float64")


def unescape_html(c: Column) -> Column:
    """Character references decoded."""
    return F.when(F.contains(c, F.lit("&")), _unescape(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, read anew; other text stays."""
    odd = c.rlike("[Â-ô][\u0080-¿]")
    return F.when(odd, _repair(F.when(odd, c))).otherwise(c)


def python_round(c: Column, digits: int) -> Column:
    """Rounding of the exact binary value, as Python does (2.675 to 2.67)."""
    return _round(c, F.lit(digits))
