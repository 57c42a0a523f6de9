"""Quantiles of several columns by mergeable sketches, in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks' sketches are merged in so many groups first, and then once.
GROUPS = 256


def rank_error(size: int) -> float:
    """The share of values by which the rank of a quantile may be off, in 99 of 100 sketches of this size."""
    return 2.296 / size**0.9021


def quantiles(rows: DataFrame, values: list[Column], asked: list[float], size: int) -> list[tuple[int, list[float] | None]]:
    """(values that aren't null, quantiles) of each column of doubles; no quantiles where all are null or NaN.

    No task reads more sketches than there are groups, or tasks a group, so the last merge doesn't grow with the input.
    """
    none = F.lit(None).cast("double")
    each = [e for i, v in enumerate(values) for e in (F.count(v).alias(f"n{i}"), F.count(F.nanvl(v, none)).alias(f"m{i}"), F.kll_sketch_agg_double(v, F.lit(size)).alias(f"s{i}"))]
    groups = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS))).agg(*each)
    # A sketch holds no NaN, and an empty one can't be asked.
    one = groups.agg(*[e for i in range(len(values)) for e in (F.sum(f"n{i}").alias(f"n{i}"), F.sum(f"m{i}").alias(f"m{i}"), F.kll_merge_agg_double(F.when(F.col(f"m{i}") > 0, F.col(f"s{i}")), F.lit(size)).alias(f"s{i}"))])
    asks = F.array(*map(F.lit, asked))
    found = one.select(*[F.struct(F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("n"), F.when(F.coalesce(F.col(f"m{i}"), F.lit(0)) > 0, F.kll_sketch_get_quantile_double(f"s{i}", asks)).alias("q")).alias(f"c{i}") for i in range(len(values))]).first()
    return [(found[f"c{i}"]["n"], found[f"c{i}"]["q"]) for i in range(len(values))]
