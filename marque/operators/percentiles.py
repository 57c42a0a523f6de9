"""Percentiles by offset: the value at floor(n * p) of the ascending non-null values, from 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marque.functions.columns import name
from marque.operators.catalog_query import prepared, valid
from marque.operators.sketches import quantiles, rank_error
from marque.session import cut

# Which columns are better low or high.
LOWER = ("0_60_mph_sec", "0_100_kmh_sec", "0_100_mph_sec", "0_200_kmh_sec", "quarter_mile_sec", "curb_weight_lb", "braking_70_0_ft", "braking_100_0_ft", "nurburgring_lap_sec", "top_gear_lap_sec", "lightning_lap_sec", "power_to_weight")
HIGHER = ("top_speed_mph", "top_speed_kmh", "quarter_mile_speed_mph", "power_hp", "power_kw", "torque", "skidpad_g")
LEAST = 10  # fewer values have no percentiles
P_LOW, P_HIGH = 0.1, 0.9
#: Size of a quantile sketch: some 90 KB at most.
SKETCH = 4096
#: Values between the bounds of an offset that one task ranks.
FEW = 200_000


def _source(column: str) -> Column:
    return name("torque_lbft" if column == "torque" else column).cast("double")


def _ranked(counts: DataFrame, sought: DataFrame, few: bool = False) -> DataFrame:
    """(column, p, v): the value at each sought place. counts: (column, p, v, k), no value twice; sought: (column, p, before, offset), a row each.

    Unless they are few, values are dealt by ranges; running totals of the ranges tell which of them holds an offset, and only that one is ranked.
    """
    if few:
        reached = F.col("before") + F.sum("k").over(Window.partitionBy("column", "p").orderBy("v"))
        return counts.join(F.broadcast(sought), ["column", "p"]).withColumn("reached", reached).where("reached > offset").groupBy("column", "p").agg(F.min("v").alias("v"))
    ranged = cut(counts.repartitionByRange("column", "p", "v").withColumn("range", F.spark_partition_id()))
    upto = F.sum("k").over(Window.partitionBy("column", "p").orderBy("range"))
    ranges = ranged.groupBy("column", "p", "range").agg(F.sum("k").alias("k")).select("column", "p", "range", (upto - F.col("k")).alias("lower"), upto.alias("upto"))
    at = ranges.join(F.broadcast(sought), ["column", "p"]).withColumn("place", F.col("offset") - F.col("before")).where("lower <= place and place < upto")  # a row each
    within = ranged.join(F.broadcast(at.select("column", "p", "range", "lower", "place")), ["column", "p", "range"])
    reached = F.col("lower") + F.sum("k").over(Window.partitionBy("column", "p", "range").orderBy("v"))
    return within.withColumn("reached", reached).where("reached > place").groupBy("column", "p").agg(F.min("v").alias("v"))


def percentiles(catalog: DataFrame, columns: tuple[str, ...] = LOWER + HIGHER, sketch: int = SKETCH) -> DataFrame:
    """(column, n, p10, p90) of each column with values; null percentiles under ten values.

    The first scan counts each column's values and sketches their quantiles (KLL), merged in two steps, so that no task
    reads more sketches than there are groups or tasks a group. These bound the value at each offset from both sides. The
    second scan counts what lies outside the bounds on the shorter side and the values between, about one in 100 for
    each offset; only those are shuffled and ranked. An offset that the bounds miss, as a sketch errs by more than
    it promises now and then, is sought among all values of its column. sketch: 8 to 65,535; a larger one leaves fewer values between.
    """
    rows = prepared(catalog).where(valid())
    has = set(rows.columns) | {"torque"}
    columns = tuple(c for c in columns if c in has)
    if not columns:
        return rows.sparkSession.createDataFrame([], "column string, n long, p10 double, p90 double")
    off = 2 * rank_error(sketch)
    asked = [min(1.0, max(0.0, p + d)) for p in (P_LOW, P_HIGH) for d in (-off, off)]
    known = {c: {"n": n, "q": q} for c, (n, q) in zip(columns, quantiles(rows, [_source(c) for c in columns], asked, sketch), strict=True) if n}
    spark = rows.sparkSession
    if not known:
        return spark.createDataFrame([], "column string, n long, p10 double, p90 double")
    # Few values need no bounds.
    bounds = {(c, p): (None, None) if k["n"] * off < 2 or k["q"] is None else (k["q"][2 * i], k["q"][2 * i + 1]) for c, k in known.items() for i, p in enumerate((P_LOW, P_HIGH))}

    def cell(c: str, p: float) -> Column:
        """(column, p, the value if between the bounds, else null for one on the shorter side); null for others."""
        v, (low, high) = _source(c), bounds[c, p]
        below, above = (v < low if low is not None else F.lit(False)), (v > high if high is not None else F.lit(False))
        own = lambda x: F.struct(F.lit(c).alias("column"), F.lit(p).alias("p"), x.alias("v"))
        return F.when(v.isNull(), None).when(below if p < 0.5 else above, own(F.lit(None).cast("double"))).when(~(above if p < 0.5 else below), own(v))

    cells = F.array(*[cell(c, p) for c, p in bounds])
    counts = cut(rows.select(F.inline(cells)).where("p is not null").groupBy("column", "p", "v").agg(F.count("*").alias("k")))
    sums = {(r["column"], r["p"]): r for r in counts.groupBy("column", "p").agg(F.sum(F.when(F.col("v").isNull(), F.col("k")).otherwise(0)).alias("outside"), F.sum(F.when(F.col("v").isNotNull(), F.col("k")).otherwise(0)).alias("inside"), F.count("v").alias("values")).collect()}
    sought, missed = [], []
    for c, p in bounds:
        n, offset, own = known[c]["n"], math.floor(known[c]["n"] * p), sums.get((c, p))
        outside, inside = (own["outside"], own["inside"]) if own else (0, 0)
        before = outside if p < 0.5 else n - outside - inside
        if before <= offset < before + inside:
            sought.append((c, p, before, offset))
        else:
            missed.append((c, p, 0, offset))
    kind = "column string, p double, before long, offset long"
    out = _ranked(counts.where("v is not null"), spark.createDataFrame(sought, kind), max((r["values"] for r in sums.values()), default=0) <= FEW)
    if missed:
        whole = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("p"), _source(c).alias("v")) for c, p, *_ in missed])
        out = out.unionByName(_ranked(rows.select(F.inline(whole)).where("v is not null").groupBy("column", "p", "v").agg(F.count("*").alias("k")), spark.createDataFrame(missed, kind)))
    sizes = F.broadcast(spark.createDataFrame([(c, k["n"]) for c, k in known.items()], "column string, n long"))  # a row a column
    at = lambda p: F.min(F.when((F.col("p") == p) & (F.col("n") >= LEAST), F.col("v")))
    return out.join(sizes, "column").groupBy("column").agg(F.first("n").alias("n"), at(P_LOW).alias("p10"), at(P_HIGH).alias("p90"))


def with_status(catalog: DataFrame, thresholds: DataFrame, column: str, out: str = "status") -> DataFrame:
    """catalog with top10, bottom10 or null for a column; the best side is tested first."""
    lower = column in LOWER
    if not lower and column not in HIGHER:
        raise ValueError(f"{column} has no better side")
    t = F.broadcast(thresholds.where(F.col("column") == column).select(F.col("p10").alias("_p10"), F.col("p90").alias("_p90")).limit(1))  # one row
    v = _source(column)
    best, worst = (v <= F.col("_p10"), v >= F.col("_p90")) if lower else (v >= F.col("_p90"), v <= F.col("_p10"))
    return prepared(catalog).join(t, F.lit(True), "left").withColumn(out, F.when(best, "top10").when(worst, "bottom10")).drop("_p10", "_p90")
