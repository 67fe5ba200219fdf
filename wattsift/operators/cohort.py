"""Indicators against a supply's peers in the same batch.

The cohort is (category, locality) if it has ten members, else the category if it
has three.  All indicators depend on the cohort and the kWh alone, so they are
computed for distinct values from distributed ranks, and joined back; no cohort
is in one window or task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift import constants as K
from wattsift.functions.scalar import ratio
from wattsift.operators.ranks import at_place, running_counts, value_counts

_FINE, _COARSE = ["lote", "categoria", "localidad"], ["lote", "categoria"]


def _loo_quartiles(n: str) -> dict[float, tuple]:
    """Positions f, c and the share between them of the quartiles of n - 1 values."""
    out = {}
    for p in (0.25, 0.75):
        at = F.lit(p) * (F.col(n) - 2)
        out[p] = (F.floor(at), F.ceil(at), at - F.floor(at))
    return out


def _statistics(counted: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Median and the order statistics around both quartiles of each cohort."""
    wanted = [("low", F.floor((F.col("n") - 1) / 2)), ("high", F.floor(F.col("n") / 2))]
    for p, (f, c, _) in _loo_quartiles("n").items():
        for name, at in (("f", f), ("f1", f + 1), ("c", c), ("c1", c + 1)):
            wanted.append((f"{tag}_{int(p * 100)}_{name}", at))
    found = counted.groupBy(*keys).agg(*(at_place(at, "kwh").alias(name) for name, at in wanted))
    return found.withColumn(f"{tag}_median", (F.col("low") + F.col("high")) / 2).drop("low", "high")


def _outlier(tag: str):
    """Outside the fences of the quartiles of the cohort without the row itself; which of several equal rows is left out makes no difference."""
    below = F.col(f"{tag}_below")
    quartile = {}
    for p, (f, c, share) in _loo_quartiles(f"{tag}_n").items():
        pick = lambda at, name, p=p: F.when(at < below, F.col(f"{tag}_{int(p * 100)}_{name}")).otherwise(F.col(f"{tag}_{int(p * 100)}_{name}1"))
        low, high = pick(f, "f"), pick(c, "c")
        quartile[p] = low + (high - low) * share
    spread = quartile[0.75] - quartile[0.25]
    return (F.col("kwh") < quartile[0.25] - K.IQR_FENCE * spread) | (F.col("kwh") > quartile[0.75] + K.IQR_FENCE * spread)


def _ranked(counts: DataFrame, keys: list[str], tag: str, ranges: int | None) -> DataFrame:
    """Counted values with the place and the statistics of their cohort, columns marked with ``tag``."""
    counted = running_counts(counts, keys, "kwh", ranges)
    joined = counted.join(_statistics(counted, keys, tag), keys)
    return joined.select(*keys, "kwh", F.col("k").alias(f"{tag}_k"), F.col("below").alias(f"{tag}_below"), F.col("n").alias(f"{tag}_n"), *(c for c in joined.columns if c.startswith(f"{tag}_")))


def cohort_indicators(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """Adds peer_ratio, percentile_peer, iqr_outlier_flag and cohort_size to (suministro, lote, categoria, localidad, kwh, ...).

    The locality is as given; rows without one form a cohort of their own.
    """
    rows = rows.withColumn("localidad", F.coalesce("localidad", F.lit("")))
    counts = value_counts(rows, _FINE, "kwh")
    fine = _ranked(counts, _FINE, "f", ranges)
    coarse = _ranked(fine.groupBy(*_COARSE, "kwh").agg(F.sum("f_k").alias("k")), _COARSE, "c", ranges)
    enough, some = F.col("f_n") >= K.COHORT_MIN, F.col("c_n") >= K.COHORT_FALLBACK_MIN
    share = lambda tag: (F.col(f"{tag}_below") + F.col(f"{tag}_k")) / F.col(f"{tag}_n")
    found = fine.join(coarse, [*_COARSE, "kwh"]).select(
        *_FINE, "kwh", ratio(F.col("kwh"), F.when(enough, F.col("f_median")).otherwise(F.col("c_median"))).alias("peer_ratio"),
        F.when(enough, share("f")).when(some, share("c")).alias("percentile_peer"),
        F.when(enough, _outlier("f")).when(some, _outlier("c")).alias("iqr_outlier_flag"),
        F.when(enough, F.col("f_n")).otherwise(F.col("c_n")).alias("cohort_size"),
    )
    out = rows.join(found, [*_FINE, "kwh"]).select(*rows.columns, "peer_ratio", "percentile_peer", "iqr_outlier_flag", "cohort_size")
    return out.withColumn("localidad", F.nullif("localidad", F.lit("")))
