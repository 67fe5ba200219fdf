"""Unbilled energy (IEE), batch-wide scales, and the composed risk index (IRE)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift import constants as K
from wattsift.functions.scalar import clamp, criticality, half_up, json_value, level, ratio, risk_class
from wattsift.operators.ranks import running_counts, value_counts


def with_iee(vectors: DataFrame) -> DataFrame:
    """Adds iee: expected less billed kWh, zero if negative, null at a cold start."""
    return vectors.withColumn("iee", F.when(~F.col("is_cold_start"), F.greatest(F.lit(0.0), F.col("moving_avg_12m") - F.col("kwh"))))


def batch_scales(vectors: DataFrame) -> DataFrame:
    """Adds iee_norm and avg_norm (0 to 100 within the batch) from per-batch extremes joined back."""
    positive = F.when(F.col("iee") > 0, F.col("iee"))
    ends = vectors.groupBy("lote").agg(F.min(positive).alias("__i0"), F.max(positive).alias("__i1"), F.min("avg_consumption").alias("__a0"), F.max("avg_consumption").alias("__a1"))
    scaled = lambda x, a, b: (x - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0.0)) * 100
    iee = F.when(F.coalesce("iee", F.lit(0.0)) <= 0, 0.0).when(F.col("__i0") == F.col("__i1"), 100.0).otherwise(scaled(F.col("iee"), "__i0", "__i1"))
    avg = F.when(F.col("__a0") == F.col("__a1"), 50.0).otherwise(scaled(F.col("avg_consumption"), "__a0", "__a1"))
    return vectors.join(F.broadcast(ends), "lote").withColumns({"iee_norm": iee, "avg_norm": avg}).drop("__i0", "__i1", "__a0", "__a1")


def exposure_percentile(vectors: DataFrame, ranges: int | None = None) -> DataFrame:
    """Adds avg_percentil: percent rank of mean consumption within the batch, 50 for a single supply."""
    counted = running_counts(value_counts(vectors, ["lote"], "avg_consumption"), ["lote"], "avg_consumption", ranges).drop("k")
    out = vectors.join(counted, ["lote", "avg_consumption"])
    share = F.when(F.col("n") == 1, 50.0).otherwise(F.col("below") / F.nullif(F.col("n") - 1, F.lit(0)) * 100)
    return out.withColumn("avg_percentil", share).drop("below", "n")


def inverted_min_max(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Adds (max - x) / (max - min) within the batch, 0.5 if all are equal."""
    ends = rows.groupBy("lote").agg(F.min(column).alias("__0"), F.max(column).alias("__1"))
    value = F.when(F.col("__0") == F.col("__1"), 0.5).otherwise(ratio(F.col("__1") - F.col(column), F.col("__1") - F.col("__0")))
    return rows.join(F.broadcast(ends), "lote").withColumn(out, value).drop("__0", "__1")


def factor_values() -> dict[str, Column]:
    """Value from 0 to 100 of each factor; null if it cannot be computed."""
    c = F.col
    f5, f6 = c("pct_change_prev_period"), c("pct_change_yoy")
    larger = F.when(f6.isNull() | (F.abs(f5) >= F.abs(f6)), f5).otherwise(f6)
    return {
        "score_ia": c("ml_score"),
        "historial_consumos": F.when(c("deviation_from_baseline").isNotNull(), F.least(F.abs("deviation_from_baseline"), F.lit(K.HISTORY_CAP)) * K.HISTORY_SCALE),
        "persistencia_anomalias": F.least(c("prior_anomaly_count") * K.PRIOR_POINTS + c("zero_consumption_streak") * K.STREAK_POINTS, F.lit(K.PERSISTENCE_CAP)),
        "variacion_porcentual": F.when(larger.isNotNull(), F.least(F.abs(larger), F.lit(K.VARIATION_CAP)) * K.VARIATION_SCALE),
        "impacto_economico": c("iee_norm"),
        "inspecciones_anteriores": F.lit(None).cast("double"),
        "consumo_promedio": c("avg_norm"),
        "categoria_tarifaria": criticality(c("categoria")),
    }


def factor_reasons() -> dict[str, Column]:
    # The sentences that explain each factor.
    c, text = F.col, F.format_string
    f5, f6 = c("pct_change_prev_period"), c("pct_change_yoy")
    first = f6.isNull() | (F.abs(f5) >= F.abs(f6))
    return {
        "score_ia": text("Score del modelo de IA: %.1f/100 (aproximación por atribución de features)", c("ml_score")),
        "historial_consumos": text("Desviación de %+.2f desvíos estándar respecto de la línea base histórica", c("deviation_from_baseline")),
        "persistencia_anomalias": text("%d anomalía(s) previa(s) registrada(s) y racha actual de %d período(s) consecutivos en cero consumo", c("prior_anomaly_count"), c("zero_consumption_streak")),
        "variacion_porcentual": text("Variación de %+.0f%% respecto de %s", F.bround(F.when(first, f5).otherwise(f6) * 100, 0), F.when(first, "el período anterior").otherwise("el mismo período del año anterior")),
        "impacto_economico": F.concat(F.lit("Impacto económico estimado: "), F.when(c("iee").isNotNull(), text("%.1f kWh no facturados", c("iee"))).otherwise("sin estimar (cold-start)")),
        "inspecciones_anteriores": F.lit(None).cast("string"),
        "consumo_promedio": text("Consumo promedio de %.1f kWh (percentil %.0f respecto del lote)", c("avg_consumption"), F.bround(c("avg_percentil"), 0)),
        "categoria_tarifaria": text("Categoría tarifaria %s (criticidad %.0f/100)", c("categoria"), criticality(c("categoria"))),
    }


def with_ire(vectors: DataFrame, reasons: bool = False) -> DataFrame:
    """Adds ire_crudo, ire, nivel, clasificacion and factores (those that contribute, in a fixed order)."""
    values, texts = factor_values(), factor_reasons()
    points = {k: K.EFFECTIVE_WEIGHTS[k] * v for k, v in values.items()}
    raw = sum((F.coalesce(p, F.lit(0.0)) for p in points.values()), F.lit(0.0))
    shape = "struct<factor:string,contribution:double,reason:string>"
    entries = F.array(*(F.struct(F.lit(k).alias("factor"), p.alias("contribution"), (texts[k] if reasons else F.lit(None).cast("string")).alias("reason")).cast(shape) for k, p in points.items()))
    out = vectors.withColumns({"ire_crudo": raw, "factores": F.filter(entries, lambda e: e["contribution"] > 0)})
    out = out.withColumn("ire", clamp(half_up(F.col("ire_crudo")), 0, 100).cast("int"))
    return out.withColumns({"nivel": level(F.col("ire")), "clasificacion": risk_class(F.col("ire"))})


def index_rows(scored: DataFrame) -> DataFrame:
    """(suministro, lote, valor, nivel): the index as it is stored."""
    return scored.select("suministro", "lote", F.col("ire").alias("valor"), "nivel")


def impact_rows(scored: DataFrame) -> DataFrame:
    """(suministro, lote, valor, moneda): the estimates as they are stored; a cold start has none."""
    return scored.filter(F.col("iee").isNotNull()).select("suministro", "lote", F.round("iee", 2).alias("valor"), F.lit(K.IMPACT_UNIT).alias("moneda"))


def factor_rows(scored: DataFrame) -> DataFrame:
    """A row for each contributing factor.

    The outer form, as Spark would put a filter on the array's size below the plain
    one and make the array anew for it.
    """
    each = scored.select("suministro", "lote", F.posexplode_outer("factores").alias("orden", "f")).filter("orden IS NOT NULL")
    return each.select("suministro", "lote", "orden", "f.factor", "f.contribution", "f.reason")


def factors_json(scored: DataFrame) -> DataFrame:
    """(suministro, lote, observaciones): the factors as JSON, contributions with four decimals."""
    rounded = F.transform("factores", lambda f: F.struct(f["factor"].alias("factor"), F.bround(f["contribution"], 4).alias("contribution"), f["reason"].alias("reason")))
    return scored.select("suministro", "lote", F.to_json(rounded).alias("observaciones"))


def read_factors(rows: DataFrame, column: str = "observaciones") -> DataFrame:
    """Adds factores from JSON, entry by entry.

    Text that is no JSON or no list gives none; an entry that is no object, lacks one
    of the three keys, or whose contribution is no number is passed over alone; a
    null reason stays.
    """
    entries = F.try_variant_get(json_value(F.col(column)), "$", "array<variant>")
    keys = lambda e: F.json_object_keys(F.to_json(e))
    whole = F.filter(entries, lambda e: F.coalesce(F.size(F.array_intersect(keys(e), F.array(*map(F.lit, ("factor", "contribution", "reason"))))) == 3, F.lit(False)))
    value = lambda e, k, t: F.try_variant_get(e, f"$.{k}", t)
    parsed = F.transform(whole, lambda e: F.struct(value(e, "factor", "string").alias("factor"), value(e, "contribution", "double").alias("contribution"), value(e, "reason", "string").alias("reason")))
    good = F.filter(parsed, lambda f: f["contribution"].isNotNull())
    return rows.withColumn("factores", F.coalesce(good, F.array().cast("array<struct<factor:string,contribution:double,reason:string>>")))
