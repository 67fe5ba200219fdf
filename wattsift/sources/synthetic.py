"""Synthetic billing data with planted anomalies, as column expressions over ``spark.range``.

Noise is a function of (seed, supply, month), so any partitioning gives the same
rows.  The planted anomalies are in the result, as ground truth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALES = {"small": (100, 24), "medium": (1000, 36), "large": (5000, 36)}
# Fixed values: (category, share, baseline kWh, seasonal amplitude, noise, growth a year).
PROFILES = (("Residencial", 0.70, 280.0, 0.35, 0.12, 0.02), ("Comercial", 0.22, 1400.0, 0.20, 0.10, 0.03), ("Industrial", 0.08, 9000.0, 0.08, 0.06, 0.04))
LOCALITIES = ("Norte", "Sur", "Este", "Oeste")
KINDS = ("sudden_drop", "sudden_drop_leve", "zero_consumption_streak", "gradual_decline", "spike", "spike_leve")
ANOMALY_SHARE, COLD_START_SHARE = 0.05, 0.15


def unit(seed: int, *parts) -> Column:
    """A number from 0 to 1 that depends on the parts only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / float(1 << 53)


def gaussian(seed: int, *parts) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2 * F.log(F.greatest(unit(seed, F.lit("u"), *parts), F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * unit(seed, F.lit("v"), *parts))


def season(month: Column, amplitude: Column) -> Column:
    return 1 + amplitude * F.cos(2 * 3.141592653589793 * (month - 1) / 12)


def growth(months: Column, rate: Column) -> Column:
    return 1 + rate * months / 12


def lognormal(z: Column, sigma: Column) -> Column:
    """Mean one."""
    return F.exp(z * sigma - sigma * sigma / 2)


def supplies(spark: SparkSession, n: int, months: int, seed: int = 42, anomaly_share: float = ANOMALY_SHARE) -> DataFrame:
    """A row for each supply with its profile, first month and planted anomaly (one of each kind at least)."""
    s, pick = F.col("suministro"), unit(seed, F.lit("cat"), F.col("suministro"))
    profile, below = None, 0.0
    for name, share, base, amplitude, sigma, rate in PROFILES:
        below += share
        value = F.struct(F.lit(name).alias("categoria"), F.lit(base).alias("base"), F.lit(amplitude).alias("amplitud"), F.lit(sigma).alias("sigma"), F.lit(rate).alias("crecimiento"))
        profile = F.when(pick < below, value) if profile is None else (profile.when(pick < below, value) if name != PROFILES[-1][0] else profile.otherwise(value))
    kinds = F.array(*map(F.lit, KINDS))
    drawn = unit(seed, F.lit("anom"), s) < anomaly_share
    kind = F.when(s < len(KINDS), F.element_at(kinds, (s + 1).cast("int"))).when(drawn, F.element_at(kinds, F.floor(unit(seed, F.lit("kind"), s) * len(KINDS)).cast("int") + 1))
    first = F.when(unit(seed, F.lit("cold"), s) < COLD_START_SHARE, F.floor(unit(seed, F.lit("first"), s) * (months // 3))).otherwise(0)
    rows = spark.range(n).withColumnRenamed("id", "suministro").select("suministro", F.format_string("S-%05d", s).alias("numero"), profile.alias("p"), F.element_at(F.array(*map(F.lit, LOCALITIES)), F.floor(unit(seed, F.lit("loc"), s) * len(LOCALITIES)).cast("int") + 1).alias("localidad"), first.cast("int").alias("primer_mes"), kind.alias("anomalia"))
    room = F.greatest(F.lit(months) - F.col("primer_mes") - 8, F.lit(1))
    return rows.select("suministro", "numero", "p.*", "localidad", "primer_mes", "anomalia", F.when(F.col("anomalia").isNotNull(), F.col("primer_mes") + 4 + F.floor(unit(seed, F.lit("start"), s) * room)).cast("int").alias("mes_anomalia"))


def planted(kind: Column, since: Column, normal: Column, before: Column, draw: Column) -> Column:
    """kWh under an anomaly that began ``since`` months ago; ``before`` is the last normal month, ``draw`` from 0 to 1."""
    length = 3 + F.floor(draw * 4)
    return (
        F.when(kind.isNull() | (since < 0), normal)
        .when(kind == "sudden_drop", before * (0.40 - 0.20 * draw))
        .when(kind == "sudden_drop_leve", before * (0.70 - 0.20 * draw))
        .when(kind == "zero_consumption_streak", F.when(since < length, 0.0).otherwise(normal))
        .when(kind == "gradual_decline", before * F.pow(F.lit(0.95), F.least(since + 1, F.lit(12))))
        .when(kind == "spike", F.when(since == 0, before * (3 + 2 * draw)).otherwise(normal))
        .when(kind == "spike_leve", F.when(since == 0, before * (1.8 + 0.8 * draw)).otherwise(normal))
        .otherwise(normal)
    )


def consumption(supply_rows: DataFrame, months: int, seed: int = 42, start: str = "2022-01-01") -> DataFrame:
    """(suministro, inicio, fin, dias, kwh, lote, anomala): monthly consumption with the anomalies planted."""
    rows = supply_rows.select("*", F.explode(F.sequence(F.col("primer_mes"), F.lit(months - 1))).alias("mes"))

    def normal(m: Column) -> Column:
        month = m % 12 + 1
        return F.col("base") * season(month, F.col("amplitud")) * growth(m, F.col("crecimiento")) * lognormal(gaussian(seed, F.col("suministro"), m.cast("int")), F.col("sigma"))

    since = F.col("mes") - F.col("mes_anomalia")
    kwh = planted(F.col("anomalia"), since, normal(F.col("mes")), normal(F.col("mes_anomalia") - 1), unit(seed, F.lit("draw"), F.col("suministro")))
    day = F.add_months(F.lit(start).cast("date"), F.col("mes"))
    return rows.select("suministro", day.alias("inicio"), F.last_day(day).alias("fin"), F.dayofmonth(F.last_day(day)).alias("dias"), F.round(kwh, 3).alias("kwh"), F.date_format(day, "'LOTE-'yyyy-MM").alias("lote"), (since >= 0).alias("anomala"))
