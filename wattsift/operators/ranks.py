"""Distributed ranks: how many rows of a group come before a value, with no group in one task.

1. Equal values of a group are counted, combined before the shuffle.
2. The counted values are dealt into ranges of (group, value), so a large group
   spans many of them, and written; each range adds up its own counts.
3. Each (group, range) sends one sum.  The sums of the ranges before it, a row for
   each range at most, are what a range adds to its own running counts.

Shares, percent ranks, order statistics and quartiles all follow from the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattsift.sources.shared import cut


def value_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, k): the number of rows of each value of each group."""
    return rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("k"))


def running_counts(counts: DataFrame, keys: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """Adds to (keys, value, k), distinct in (keys, value), below and n: the group's rows before the value, and all its rows.

    Nulls, as values and in keys, come first and are values like any other.
    ``ranges`` is their number; by default the session's shuffle partitions,
    fewer where the data are small.
    """
    dealt = counts.repartitionByRange(ranges, *keys, value) if ranges else counts.repartitionByRange(*keys, value)
    placed = cut(dealt.select(*keys, value, "k", F.spark_partition_id().alias("__range")), "ranges")
    own = F.sum("k").over(W.partitionBy("__range", *keys).orderBy(value))
    in_order = W.partitionBy(*keys).orderBy("__range")
    before, every = in_order.rowsBetween(W.unboundedPreceding, -1), in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sums = placed.groupBy(*keys, "__range").agg(F.sum("k").alias("__sum"))
    sums = sums.select(*(F.col(c).alias(f"__{c}") for c in keys), F.col("__range").alias("__at"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"), F.sum("__sum").over(every).alias("n"))
    same = F.col("__range") == F.col("__at")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = placed.withColumn("__own", own).join(sums, same)
    return joined.select(*keys, value, "k", (F.col("__before") + F.col("__own") - F.col("k")).alias("below"), "n")


def at_place(place: Column, value: str | Column = "v") -> Column:
    """Aggregate over counted values: the value at a place from 0, null beyond the ends."""
    value = F.col(value) if isinstance(value, str) else value
    return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("k")), value))


def cells(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, c, v, k): the counted values of several columns, as doubles, nulls among them; c is the column's place in ``columns``."""
    each = F.posexplode(F.array(*(F.col(c).cast("double") for c in columns)))
    return value_counts(rows.select(*keys, each.alias("c", "v")), [*keys, "c"], "v")


def _interpolated(found: DataFrame, shares: dict[str, float], n: str) -> dict[str, Column]:
    at = {s: F.lit(p) * (F.col(n) - 1) for s, p in shares.items()}
    return {s: F.col(f"{s}_low") + (F.col(f"{s}_high") - F.col(f"{s}_low")) * (x - F.floor(x)) for s, x in at.items()}


def _wide(found: DataFrame, keys: list[str], columns: list[str], names) -> DataFrame:
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("c") == i, F.col(s))).alias(f"{c}_{s}") for i, c in enumerate(columns) for s in names))


def order_statistics(rows: DataFrame, keys: list[str], columns: list[str], shares: dict[str, float], ranges: int | None = None) -> DataFrame:
    """For each key: (column_name) as in ``shares``, the value at that share of each column, interpolated as the exact percentile is; nulls don't count."""
    counted = running_counts(cells(rows, keys, columns).filter("v IS NOT NULL"), [*keys, "c"], "v", ranges)
    places = [at_place(f(F.lit(p) * (F.col("n") - 1))).alias(f"{s}_{side}") for s, p in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    found = counted.groupBy(*keys, "c").agg(F.max("n").alias("n"), *places)
    return _wide(found.select(*keys, "c", *(v.alias(s) for s, v in _interpolated(found, shares, "n").items())), keys, columns, shares)


def imputed_statistics(rows: DataFrame, keys: list[str], columns: list[str], shares: dict[str, float], ranges: int | None = None) -> DataFrame:
    """For each key and column: <column>_fill, the median (zero if all are null), and the values at ``shares`` of the column with nulls filled by it.

    One pass: the z filled nulls stand at the place of the first value that is not
    below the median, so those after it move up by z.
    """
    group = [*keys, "c"]
    counts = cut(cells(rows, keys, columns), "cells")
    nulls = counts.groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)).alias("z"), F.sum("k").alias("n_all"))
    counted = cut(running_counts(counts.filter("v IS NOT NULL"), group, "v", ranges), "counted")
    half = F.lit(0.5) * (F.col("n") - 1)
    medians = counted.groupBy(*group).agg(F.max("n").alias("m"), at_place(F.floor(half)).alias("low"), at_place(F.ceil(half)).alias("high"))
    medians = medians.select(*group, (F.col("low") + (F.col("high") - F.col("low")) * (F.lit(0.5) * (F.col("m") - 1) - F.floor(F.lit(0.5) * (F.col("m") - 1)))).alias("fill"))
    fills = cut(nulls.join(medians, group, "left").withColumn("fill", F.coalesce("fill", F.lit(0.0))), "fills")
    filled = fills.filter("z > 0").select(*group, F.col("fill").alias("v"), F.col("z").alias("k"), F.lit(True).alias("own"))
    lower = counted.join(fills.select(*group, "fill", "z"), group)
    shifted = lower.select(*group, "v", "k", F.when(F.col("v") < F.col("fill"), F.col("below")).otherwise(F.col("below") + F.col("z")).alias("below"))
    less = lower.groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col("v") < F.col("fill"), F.col("k"))), F.lit(0)).alias("below"))
    own = filled.join(less, group, "left").select(*group, "v", "k", F.coalesce("below", F.lit(0)).alias("below"))
    every = shifted.unionByName(own).join(fills.select(*group, F.col("n_all").alias("n"), "fill"), group)
    places = [at_place(f(F.lit(p) * (F.col("n") - 1))).alias(f"{s}_{side}") for s, p in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    found = every.groupBy(*group).agg(F.max("n").alias("n"), F.max("fill").alias("fill"), *places)
    return _wide(found.select(*keys, "c", "fill", *(v.alias(s) for s, v in _interpolated(found, shares, "n").items())), keys, columns, ["fill", *shares])
