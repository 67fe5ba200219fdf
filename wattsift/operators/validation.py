"""Integrity checks V1 to V7, exclusions, and the completeness gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattsift import constants as K


def validation_rows(rows: DataFrame, readings: DataFrame, deleted_categories: DataFrame | None = None) -> DataFrame:
    """Consumption with its reading (if any), the previous period and whether its category is deleted.

    The previous period comes from the whole history; batches are filtered afterwards.
    """
    by = W.partitionBy("suministro").orderBy("inicio", "fin")
    out = rows.select("*", F.lag("inicio").over(by).alias("prev_inicio"), F.lag("fin").over(by).alias("prev_fin"))
    out = out.join(readings, ["suministro", "inicio"], "left")
    if deleted_categories is None:
        return out.withColumn("categoria_eliminada", F.lit(False))
    marked = deleted_categories.select("categoria", F.lit(True).alias("categoria_eliminada"))
    return out.join(marked, "categoria", "left").withColumn("categoria_eliminada", F.coalesce("categoria_eliminada", F.lit(False)))


def check_conditions() -> list[tuple[str, Column]]:
    """(check, condition) in order; V7 has two conditions, and a row can fail both."""
    c = F.col
    delta = F.abs(c("kwh").cast("decimal(12,3)") - (c("lectura_actual").cast("decimal(12,3)") - c("lectura_anterior").cast("decimal(12,3)")))
    return [
        ("V1", c("lectura_dias").isNull()),
        ("V2", delta > F.lit(K.V2_TOLERANCE_KWH).cast("decimal(12,3)")),
        ("V3", c("lectura_dias").isNotNull() & (c("lectura_dias") != c("dias"))),
        ("V4", c("inicio") > F.date_add("prev_fin", K.V4_CONTIGUITY_DAYS)),
        ("V5", c("inicio") <= c("prev_fin")),
        ("V6", c("categoria_eliminada")),
        ("V7", c("kwh") < 0),
        ("V7", c("dias") <= 0),
    ]


def findings(rows: DataFrame) -> DataFrame:
    """A row for each failed check: suministro, lote, inicio, chequeo."""
    failed = F.filter(F.array(*(F.when(c, F.lit(v)) for v, c in check_conditions())), lambda v: v.isNotNull())
    # outer: Spark would put a filter on the array's size below the plain form and make the array anew for it
    return rows.select("suministro", "lote", "inicio", F.explode_outer(failed).alias("chequeo")).filter("chequeo IS NOT NULL")


def exclusions(found: DataFrame) -> DataFrame:
    """Supplies that a check excludes from a batch, with the checks in order; informative checks exclude none."""
    return found.filter(~F.col("chequeo").isin(*K.INFORMATIVE_CHECKS)).groupBy("lote", "suministro").agg(F.array_sort(F.collect_set("chequeo")).alias("motivos"))


def validation_report(rows: DataFrame, found: DataFrame) -> DataFrame:
    """For each batch: supplies, excluded ones, valid share (one for none), and whether it meets the threshold."""
    total = rows.groupBy("lote").agg(F.countDistinct("suministro").alias("suministros"))
    gone = exclusions(found).groupBy("lote").agg(F.count(F.lit(1)).alias("excluidos"))
    out = total.join(gone, "lote", "left").select("lote", "suministros", F.coalesce("excluidos", F.lit(0)).alias("excluidos"))
    share = F.coalesce(1 - F.col("excluidos") / F.nullif("suministros", F.lit(0)), F.lit(1.0))
    return out.withColumn("fraccion_valida", share).withColumn("cumple", (F.col("suministros") - F.col("excluidos")) * 100 >= F.col("suministros") * int(K.VALID_FRACTION * 100))


def completeness(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """For each batch: declared and active rows, whether complete, and why not."""
    active = rows.groupBy("lote").agg(F.count(F.lit(1)).alias("activos"))
    out = batches.select("lote", "declarados").join(active, "lote", "left").withColumn("activos", F.coalesce("activos", F.lit(0)))
    reason = F.when(F.col("declarados") <= 0, "sin registros declarados").when(F.col("activos") != F.col("declarados"), F.format_string("declarados %d, activos %d", "declarados", "activos"))
    return out.withColumns({"completo": reason.isNull(), "motivo": reason})
