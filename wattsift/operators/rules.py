"""Rules R1 to R6 on feature vectors; a null never fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift import constants as K


def _percent(x: Column, sign: str = "") -> Column:
    return F.format_string(f"%{sign}.0f%%", F.bround(x * 100, 0))


def rule_conditions() -> dict[str, Column]:
    c = F.col
    return {
        "R1": (c("zero_consumption_streak") >= K.R1_STREAK) & (c("estado") == K.ACTIVE),
        "R2": c("pct_change_prev_period") <= K.R2_DROP,
        "R3": c("pct_change_prev_period") >= K.R3_RISE,
        "R4": (c("percentile_peer") <= K.R4_PERCENTILE) & (c("peer_ratio") <= K.R4_RATIO),
        "R5": (c("percentile_peer") >= K.R5_PERCENTILE) & (c("peer_ratio") >= K.R5_RATIO),
        "R6": F.abs("deviation_from_baseline") >= K.R6_DEVIATION,
    }


def rule_texts() -> dict[str, Column]:
    # The sentences that describe each rule's hit.
    c, text = F.col, F.format_string
    return {
        "R1": text("R1: racha de %d períodos consecutivos con consumo cero (umbral %d), suministro en estado %s", c("zero_consumption_streak"), F.lit(K.R1_STREAK), c("estado")),
        "R2": F.concat(F.lit("R2: caída de "), _percent(c("pct_change_prev_period")), F.lit(" respecto del período anterior, umbral -60%")),
        "R3": F.concat(F.lit("R3: incremento de "), _percent(c("pct_change_prev_period"), "+"), F.lit(" respecto del período anterior, umbral +200%")),
        "R4": F.concat(F.lit("R4: percentil "), _percent(c("percentile_peer")), text(" de su cohorte (umbral 5%%) y peer_ratio %.2f respecto de la mediana (umbral 0.40)", c("peer_ratio"))),
        "R5": F.concat(F.lit("R5: percentil "), _percent(c("percentile_peer")), text(" de su cohorte (umbral 95%%) y peer_ratio %.2f respecto de la mediana (umbral 2.50)", c("peer_ratio"))),
        "R6": text("R6: desviación de %+.2f desvíos estándar respecto de su línea base, umbral ±3.0", c("deviation_from_baseline")),
    }


def rule_hits(vectors: DataFrame) -> DataFrame:
    """A row for each rule that fires: suministro, lote, regla, tipo, severidad, descripcion.

    Only the rules' names are spread; a hit is described afterwards, where its text is read.
    """
    fired = F.filter(F.array(*(F.when(cond, F.lit(r)) for r, cond in rule_conditions().items())), lambda r: r.isNotNull())
    hits = vectors.drop("regla").select("*", F.explode_outer(fired).alias("regla")).filter("regla IS NOT NULL")
    of_rule = lambda values: F.coalesce(*(F.when(F.col("regla") == r, v) for r, v in values.items()))
    fixed = lambda i: of_rule({r: F.lit(k[i]) for r, k in K.RULES.items()})
    return hits.select("suministro", "lote", "regla", fixed(0).alias("tipo"), fixed(1).alias("severidad"), of_rule(rule_texts()).alias("descripcion"))


def with_hit_count(vectors: DataFrame) -> DataFrame:
    """Adds n_reglas, the number of rules that fire, without leaving the row."""
    return vectors.withColumn("n_reglas", sum((F.coalesce(c, F.lit(False)).cast("int") for c in rule_conditions().values()), F.lit(0)))


def rules_summary(vectors: DataFrame) -> DataFrame:
    """For each batch: hits of each rule (zero if none) and supplies with any."""
    fires = {r: F.coalesce(c, F.lit(False)) for r, c in rule_conditions().items()}
    return vectors.groupBy("lote").agg(*(F.count_if(c).alias(r.lower()) for r, c in fires.items()), F.count_if(sum((c.cast("int") for c in fires.values()), F.lit(0)) > 0).alias("con_hits"))


def anomaly_count(clasificacion: Column) -> Column:
    """All anomalies of a row with n_reglas: the rules' hits, or the model's own where it is critical and no rule fires."""
    return F.col("n_reglas") + F.when((clasificacion == K.CLASSES[-1][1]) & (F.col("n_reglas") == 0), 1).otherwise(0)


def prior_anomalies(vectors: DataFrame, ml: DataFrame | None = None) -> DataFrame:
    """Adds prior_anomaly_count: anomalies of the supply in earlier batches, of the rules and, with ``ml`` (suministro, lote, clasificacion_ml), of the model."""
    from pyspark.sql import Window as W

    before = W.partitionBy("suministro").orderBy("inicio").rowsBetween(W.unboundedPreceding, -1)
    rows = with_hit_count(vectors)
    if ml is not None:
        rows = rows.join(ml.select("suministro", "lote", F.col("clasificacion_ml").alias("__class")), ["suministro", "lote"], "left").withColumn("n_reglas", anomaly_count(F.coalesce("__class", F.lit("")))).drop("__class")
    return rows.withColumn("prior_anomaly_count", F.coalesce(F.sum("n_reglas").over(before), F.lit(0))).drop("n_reglas")
