"""Wide CSV of meters, one column for each two-month period, and its mapping to entities."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.functions.scalar import bimester_code, bimester_end, bimester_start, clean_neighbourhood, client_key, optional_number, optional_text

_PERIOD = re.compile(r"^C_P(\d{4})B([1-6])$")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon, ISO-8859-1, one header row, all text; short rows have nulls at the end."""
    return spark.read.options(sep=";", encoding="ISO-8859-1", header=True, mode="PERMISSIVE").csv(path)


def period_columns(names: list[str]) -> list[tuple[str, int, int]]:
    """(column, year, bimester) of the consumption columns."""
    return [(n, int(m[1]), int(m[2])) for n in names if (m := _PERIOD.match(n))]


def meters(wide: DataFrame) -> DataFrame:
    """Cleaned columns of each meter, found by name."""
    c = lambda n: F.col(f"`{n}`") if n in wide.columns else F.lit(None).cast("string")
    return wide.select(
        optional_text(c("SUMINISTRO")).alias("numero"), optional_text(c("MEDIDOR")).alias("medidor"), optional_text(c("TITULAR")).alias("titular"), optional_text(c("CUIT")).alias("cuit"),
        optional_text(c("LOCALIDAD_RUTA")).alias("localidad"), clean_neighbourhood(c("BARRIO_RUTA")).alias("barrio"), optional_number(c("DMCLATITUD")).alias("latitud"), optional_number(c("DMCLONGITUD")).alias("longitud"),
        *(c(n).alias(n) for n, _, _ in period_columns(wide.columns)),
    )


def consumption(meter_rows: DataFrame) -> DataFrame:
    """(numero, lote, inicio, fin, dias, kwh): a row for each filled cell; blank is absent, zero is zero."""
    periods = period_columns(meter_rows.columns)
    cells = F.explode(F.array(*(F.struct(F.lit(y).alias("anio"), F.lit(b).alias("bimestre"), optional_number(F.col(n)).alias("kwh")) for n, y, b in periods)))
    rows = meter_rows.select("numero", cells.alias("c")).select("numero", "c.*").filter("kwh IS NOT NULL")
    start, end = bimester_start(F.col("anio"), F.col("bimestre")), bimester_end(F.col("anio"), F.col("bimestre"))
    return rows.select("numero", bimester_code(F.col("anio"), F.col("bimestre")).alias("lote"), start.alias("inicio"), end.alias("fin"), (F.datediff(end, start) + 1).alias("dias"), "kwh")


def entities(meter_rows: DataFrame, ordered_by: str = "numero") -> dict[str, DataFrame]:
    """clientes (first seen of each key), suministros (those with consumption, from their earliest period), lotes with counts, consumos."""
    used = consumption(meter_rows)
    key = client_key(F.col("cuit"), F.col("numero"))
    clients = meter_rows.filter("numero IS NOT NULL").withColumn("numero_cliente", key).groupBy("numero_cliente").agg(F.min_by(F.struct("titular", "localidad", "barrio"), ordered_by).alias("c")).select("numero_cliente", "c.*")
    begin = used.groupBy("numero").agg(F.min("inicio").alias("fecha_alta"))
    supplies = meter_rows.select("numero", key.alias("numero_cliente"), "medidor", "localidad", "barrio", "latitud", "longitud").join(begin, "numero")
    batches = used.groupBy("lote").agg(F.count(F.lit(1)).alias("cantidad_registros"))
    return {"clientes": clients, "suministros": supplies, "lotes": batches, "consumos": used}
