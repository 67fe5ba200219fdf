"""JSON import payloads: arrays of records or one record a line, with structural rejects.

Each record is judged alone: unknown fields, wrong shapes and broken JSON reject
that record and leave the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of each entity; all may be missing at this boundary.
FIELDS = {
    "clientes": "numero_cliente nombre estado documento localidad barrio direccion".split(),
    "suministros": "numero_suministro numero_cliente categoria_tarifaria localidad barrio estado fecha_alta medidor latitud longitud".split(),
    "lecturas": "numero_suministro fecha_lectura lectura_anterior lectura_actual dias_facturados".split(),
    "lotes": "codigo_lote nombre cantidad_registros".split(),
    "consumos": "numero_suministro codigo_lote fecha_inicio fecha_fin dias_facturados kwh consumo_promedio_diario fecha_lectura".split(),
}
#: Fields in which "absent" and "null" mean different things.
THREE_STATE = {"lotes": ("nombre", "cantidad_registros"), "consumos": ("consumo_promedio_diario", "fecha_lectura")}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(posicion, registro) from files with one JSON record a line."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("posicion"), F.col("value").alias("registro"))


def from_array(rows: DataFrame, column: str) -> DataFrame:
    """(posicion, registro) from a column that holds JSON arrays of records."""
    return rows.select(F.posexplode(F.from_json(column, "array<string>")).alias("p", "registro")).select(F.col("p").cast("long").alias("posicion"), "registro")


def parse(records: DataFrame, entity: str) -> DataFrame:
    """(posicion, a column for each field, <field>_present for three-state ones, motivo); motivo says why a record is rejected."""
    fields = FIELDS[entity]
    shape = "struct<" + ",".join(f"{f}:string" for f in fields) + ">"
    keys = F.json_object_keys("registro")
    unknown = F.array_except(keys, F.array(*map(F.lit, fields)))
    broken = F.when(keys.isNull(), "registro ilegible").when(F.size(unknown) > 0, F.concat(F.lit("campos desconocidos: "), F.array_join(F.array_sort(unknown), ", ")))
    parsed = records.select("posicion", F.from_json("registro", shape).alias("r"), keys.alias("k"), broken.alias("motivo"))
    present = [F.coalesce(F.array_contains("k", f), F.lit(False)).alias(f"{f}_present") for f in THREE_STATE.get(entity, ())]
    return parsed.select("posicion", *(F.col(f"r.{f}").alias(f) for f in fields), *present, "motivo")


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected)"""
    return parsed.filter("motivo IS NULL").drop("motivo"), parsed.filter("motivo IS NOT NULL")
