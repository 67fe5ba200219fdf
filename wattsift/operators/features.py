"""Per-supply features of each billing period, as of that period.

All windows share one partitioning (the supply) and one order (the period), so
one shuffle and one sort serve them all.  Windows count rows, not months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattsift import constants as K
from wattsift.functions.scalar import month_index, ratio


def history_features(rows: DataFrame) -> DataFrame:
    """Adds to (suministro, inicio, kwh, ...) the features of the history up to each row.

    avg/max/min/stddev_consumption, pct_change_prev_period, pct_change_yoy,
    moving_avg_6m/12m, deviation_from_baseline, zero_consumption_streak,
    trend_slope, seasonality_index, zscore_self, is_cold_start.
    """
    by = W.partitionBy("suministro").orderBy("inicio")
    long, short = by.rowsBetween(1 - K.LONG_WINDOW, 0), by.rowsBetween(1 - K.SHORT_WINDOW, 0)
    past = by.rowsBetween(W.unboundedPreceding, 0)
    month = W.partitionBy("suministro", F.month("inicio")).orderBy(F.year("inicio"))
    kwh, n = F.col("kwh"), F.count(F.lit(1)).over(long)
    last = F.lag("kwh").over(by)
    a_year_ago = F.min_by("kwh", "inicio").over(month.rangeBetween(-1, -1))
    earlier = month.rangeBetween(W.unboundedPreceding, -1)
    rows = rows.select(
        "*", F.avg("kwh").over(long).alias("avg_consumption"), F.max("kwh").over(long).alias("max_consumption"), F.min("kwh").over(long).alias("min_consumption"),
        F.when(n >= K.MIN_PERIODS_DEVIATION, F.stddev_samp("kwh").over(long)).alias("stddev_consumption"),
        ratio(kwh - last, last).alias("pct_change_prev_period"), F.avg("kwh").over(short).alias("moving_avg_6m"),
        F.when(n >= K.MIN_PERIODS_SLOPE, F.coalesce(F.regr_slope("kwh", month_index(F.col("inicio"))).over(long), F.lit(0.0))).alias("trend_slope"),
        F.count(F.lit(1)).over(past).alias("__n"), F.avg("kwh").over(past).alias("__avg"), F.stddev_samp("kwh").over(past).alias("__sd"),
        F.row_number().over(by).alias("__k"),
    )
    rows = rows.select("*", F.coalesce(F.max(F.when(kwh != 0, F.col("__k"))).over(past), F.lit(0)).alias("__nonzero"))
    rows = rows.select(
        "*", ratio(kwh - a_year_ago, a_year_ago).alias("pct_change_yoy"),
        F.when(F.count(F.lit(1)).over(earlier) == 0, 1.0).otherwise(ratio(kwh, F.avg("kwh").over(earlier))).alias("seasonality_index"),
    )
    return rows.select(
        "*", F.col("avg_consumption").alias("moving_avg_12m"), ratio(kwh - F.col("avg_consumption"), F.col("stddev_consumption")).alias("deviation_from_baseline"),
        (F.col("__k") - F.col("__nonzero")).cast("long").alias("zero_consumption_streak"),
        F.when(F.col("__n") >= K.MIN_PERIODS_DEVIATION, ratio(kwh - F.col("__avg"), F.col("__sd"))).alias("zscore_self"),
        (F.col("__n") < K.MIN_PERIODS_DEVIATION).alias("is_cold_start"),
    ).drop("__n", "__avg", "__sd", "__k", "__nonzero")


def static_features(rows: DataFrame, supplies: DataFrame) -> DataFrame:
    """Adds supply columns, supply_age_days (null before the supply began) and billed_days."""
    joined = rows.join(supplies, "suministro")
    age = F.when(F.col("fecha_alta") <= F.col("inicio"), F.datediff("inicio", "fecha_alta"))
    return joined.select("*", age.alias("supply_age_days"), F.col("dias").alias("billed_days"), F.col("categoria").alias("categoria_tarifaria"))


def current_period(rows: DataFrame) -> DataFrame:
    """The latest period of each supply within each batch."""
    rank = F.row_number().over(W.partitionBy("suministro", "lote").orderBy(F.desc("inicio"), F.desc("fin")))
    return rows.select("*", rank.alias("__r")).filter("__r = 1").drop("__r")


def without_conflicts(history: DataFrame, conflicted: DataFrame, *key: str) -> DataFrame:
    """History without the periods that a duplicate check marked."""
    keys = list(key or ("periodo",))
    return history.join(conflicted.select(*keys).distinct(), keys, "left_anti")


def streak_of_all(unfiltered: DataFrame) -> DataFrame:
    """(suministro, inicio, zero_consumption_streak) on the whole history: a removed period must not bridge two streaks."""
    return history_features(unfiltered.select("suministro", "inicio", "kwh")).select("suministro", "inicio", "zero_consumption_streak")


def features_summary(vectors: DataFrame) -> DataFrame:
    """For each batch: vectors, cold starts, supplies with conflicts, |z| of 3 or more, IQR outliers, percentiles of 0.99 or more."""
    conflicted = F.col("has_conflicted_periods") if "has_conflicted_periods" in vectors.columns else F.lit(False)
    return vectors.groupBy("lote").agg(
        F.count(F.lit(1)).alias("vectores"), F.count_if("is_cold_start").alias("cold_starts"), F.count_if(conflicted).alias("conflictivos"),
        F.count_if(F.abs("zscore_self") >= K.SUMMARY_Z).alias("z_altos"), F.count_if("iqr_outlier_flag").alias("outliers_iqr"),
        F.count_if(F.col("percentile_peer") >= K.SUMMARY_PERCENTILE).alias("percentiles_altos"),
    )
