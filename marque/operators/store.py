"""Columns derived once at write time, so that queries push plain comparisons to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marque.functions.columns import name
from marque.operators.sketches import quantiles
from marque.session import tidy

#: Letters that fold to plain ones in a search, by Unicode decomposition of the common Latin ones.
_FOLD = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿčćšžđřěůłńśźżășțőű", "aaaaaaceeeeiiiinoooooouuuuyyccszdreulnszzastou")
DERIVED = ("year_int", "torque_prefix", "torque_lbft", "power_to_weight", "sources_arr", "search_tokens")


def fold(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, *_FOLD))


def tokens(c: Column) -> Column:
    """Letters and digits in runs, folded."""
    return F.array_remove(F.split(fold(c), r"[^\p{L}\p{N}]+"), "")


def torque_prefix(c: Column) -> Column:
    """The number before the first space; 0 for text without one or without a number (null stays null)."""
    return F.when(c.isNull(), F.lit(None).cast("double")).when(F.instr(c, " ") == 0, 0.0).otherwise(F.coalesce(F.split_part(c, F.lit(" "), F.lit(1)).try_cast("double"), F.lit(0.0)))


def torque_number(c: Column) -> Column:
    """The number once the unit is removed; 0 for other text."""
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("double")).otherwise(F.coalesce(F.replace(c, F.lit(" lb-ft"), F.lit("")).try_cast("double"), F.lit(0.0)))


def with_derived(df: DataFrame) -> DataFrame:
    """A catalog (or what has some of its columns) with the derived columns."""
    has = set(df.columns)
    col = lambda c, t="string": name(c) if c in has else F.lit(None).cast(t)
    hp, lb = col("power_hp", "double"), col("curb_weight_lb", "double")
    return df.withColumns({
        "year_int": F.coalesce(F.regexp_extract(F.trim(col("year")), r"^[+-]?\d+", 0).try_cast("int"), F.when(col("year").isNotNull(), 0)),
        "torque_prefix": torque_prefix(col("torque")),
        "torque_lbft": torque_number(col("torque")),
        "power_to_weight": F.when(hp > 0, F.try_divide(lb, hp)),
        "sources_arr": F.filter(F.transform(F.split(col("sources"), ","), lambda s: F.trim(s)), lambda s: s != ""),
        "search_tokens": tokens(F.concat_ws(" ", col("car_id"), col("manufacturer"), col("model"))),
    })


def write_catalog(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """The query table: derived columns, range-partitioned and sorted so that row groups prune by manufacturer."""
    out = with_derived(df)
    keys = ("manufacturer", "model", "year", "car_id")
    out = out.repartitionByRange(partitions, *keys) if partitions else out.repartitionByRange(*keys)
    out.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


#: Bits of each column in the interleaved key: 32 steps. Size of the sketches that bound them: some 10 KB.
KEY_BITS, SKETCH = 5, 500
CLUSTERED_BY = ("manufacturer", "year_int", "power_hp")


def _as_number(c: Column, kind: str) -> Column:
    """A number in the order of the values: text by its first six bytes."""
    if kind != "string":
        return c.cast("double")
    return F.conv(F.hex(F.substring(F.rpad(c.cast("binary"), 6, F.unhex(F.lit("00"))), 1, 6)), 16, 10).cast("double")


def interleaved(steps: list[Column], bits: int = KEY_BITS) -> Column:
    """The bits of whole numbers in turn, from the highest: near keys have near numbers in every column."""
    out = F.lit(0)
    for bit in range(bits - 1, -1, -1):
        for s in steps:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(s, bit).bitwiseAND(F.lit(1)))
    return out


def write_clustered(df: DataFrame, path: str, files: int | None = None, by: tuple[str, ...] = CLUSTERED_BY, ids: str | None = "car_id") -> None:
    """The query table clustered by several columns at once, so that a filter on any of them skips files.

    Each column falls into 32 steps of about equally many rows (bounds from one aggregate of mergeable quantile
    sketches; nulls in step 0); rows are dealt by ranges of the interleaved steps and sorted so. ids: a column with a Bloom
    filter in every row group, for lookups of one value. Only df's own columns are dealt and sorted; the others are derived again behind.
    """
    spark, columns = df.sparkSession, df.columns
    out = with_derived(df)
    kinds = dict(out.dtypes)
    steps = 2**KEY_BITS
    asked = [i / steps for i in range(1, steps)]
    with tidy(spark):
        found = quantiles(out, [_as_number(name(c), kinds[c]) for c in by], asked, SKETCH)

    def step(i: int, c: str) -> Column:
        bounds = sorted(set(found[i][1] or []))
        v = _as_number(name(c), kinds[c])
        # How many bounds lie at or below the value: unequal steps where one value is in many rows.
        below = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= v)) if bounds else F.lit(0)
        return F.when(v.isNull(), 0).otherwise(below).cast("int")

    keyed = out.withColumn("_key", interleaved([step(i, c) for i, c in enumerate(by)]))
    keyed = keyed.select("_key", *[name(c) for c in dict.fromkeys([*columns, *by])])
    order = ["_key", *by, *([ids] if ids and ids in kinds else [])]
    dealt = keyed.repartitionByRange(files, *order) if files else keyed.repartitionByRange(*order)
    writer = with_derived(dealt.sortWithinPartitions(*order).select(*[name(c) for c in columns])).write.mode("overwrite").option("compression", "zstd")
    if ids and ids in kinds:
        writer = writer.option(f"parquet.bloom.filter.enabled#{ids}", "true")
    with tidy(spark):
        writer.parquet(path)
