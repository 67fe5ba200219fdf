"""Overlapping periods, near-duplicate readings, and drift of batches.

Interval joins are equality joins on (supply, bucket of time), so a supply with a
long history is spread over its buckets; a pair is kept in one bucket only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattsift import constants as K

#: Days in a bucket of the interval join.
BUCKET_DAYS = 32


def _bucket(day, days: int):
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / days)


def overlap_pairs(periods: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """(suministro, periodo, otro) for periods of a supply that share a day, in both directions; ends are inclusive."""
    first, last = _bucket(F.col("inicio"), bucket_days), _bucket(F.col("fin"), bucket_days)
    spread = periods.filter("fin >= inicio").select("suministro", "periodo", "inicio", "fin", F.explode(F.sequence(first, last)).alias("cubo"))
    a = spread.select("suministro", "cubo", F.col("periodo"), F.col("inicio").alias("a0"), F.col("fin").alias("a1"))
    b = spread.select("suministro", "cubo", F.col("periodo").alias("otro"), F.col("inicio").alias("b0"), F.col("fin").alias("b1"))
    both = a.join(b, ["suministro", "cubo"]).filter("a0 <= b1 AND b0 <= a1 AND periodo <> otro")
    once = F.col("cubo") == _bucket(F.greatest("a0", "b0"), bucket_days)  # the bucket where the shared days begin
    return both.filter(once).select("suministro", "periodo", "otro")


def conflicted_periods(consumption: DataFrame) -> DataFrame:
    """(suministro, inicio, lote) of the billed periods that share a day with another of their supply.

    A sweep instead of pairs: in the order of their beginnings, a period is marked
    if one before it ends no earlier than it begins, or the next one begins no later
    than it ends.  Rows of one (inicio, lote) are one period, as long as the longest.
    """
    periods = consumption.filter("fin >= inicio").groupBy("suministro", "inicio", "lote").agg(F.max("fin").alias("fin"))
    by = W.partitionBy("suministro").orderBy("inicio", "fin", "lote")
    last_end = F.max("fin").over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = periods.select("suministro", "inicio", "lote", (F.coalesce(last_end >= F.col("inicio"), F.lit(False)) | F.coalesce(F.lead("inicio").over(by) <= F.col("fin"), F.lit(False))).alias("__hit"))
    return marked.filter("__hit").drop("__hit")


def near_duplicate_readings(readings: DataFrame, days: int = K.NEAR_DUPLICATE_DAYS) -> DataFrame:
    """(suministro, lectura, anterior, dias_entre): a reading and an earlier one of equal value at most ``days`` days before.

    Of two on one day the one with the greater id counts as later.
    """
    keys = ["suministro", "tipo", "valor", "cubo"]
    cube = _bucket(F.col("fecha"), days + 1)
    later = readings.select("suministro", "tipo", "valor", "lectura", F.col("fecha").alias("f1"), F.explode(F.array(cube, cube - 1)).alias("cubo"))
    earlier = readings.select("suministro", "tipo", "valor", F.col("lectura").alias("anterior"), F.col("fecha").alias("f0"), cube.alias("cubo"))
    gap = F.datediff("f1", "f0")
    pairs = later.join(earlier, keys).filter((gap <= days) & ((gap > 0) | (gap == 0) & (F.col("lectura") > F.col("anterior"))))
    return pairs.select("suministro", "lectura", "anterior", gap.alias("dias_entre"))


def related_batches(rows: DataFrame, batch: str) -> DataFrame:
    """Other batches that share a supply with the given one."""
    own = rows.filter(F.col("lote") == batch).select("suministro").distinct()
    return rows.filter(F.col("lote") != batch).join(own, "suministro", "left_semi").select("lote").distinct()


def drift(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """Batches whose active rows differ from a declared number that is not zero: lote, declarados, activos, diferencia."""
    active = rows.groupBy("lote").agg(F.count(F.lit(1)).alias("activos"))
    out = batches.select("lote", "declarados").filter("declarados <> 0").join(active, "lote", "left").withColumn("activos", F.coalesce("activos", F.lit(0)))
    return out.withColumn("diferencia", F.col("activos") - F.col("declarados")).filter("diferencia <> 0")
