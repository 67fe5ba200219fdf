"""Imports as set-based merges.

Records of one key count in input order: the first valid one meets the stored
row, each later one meets the one before it.  A window over (key, position) with
the stored row at the front gives every outcome at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattsift.functions.scalar import daily_mean, iso_date, positive_integer_reason
from wattsift.operators import constraints
from wattsift.sources.shared import cut

OUTCOMES = ("created", "updated", "unchanged", "restored", "rejected")


def reasons(*each: Column) -> Column:
    """Array of the reasons that are not null."""
    return F.filter(F.array(*each), lambda r: r.isNotNull())


def blank(x: Column, field: str) -> Column:
    return F.when(F.coalesce(constraints.stripped(x), F.lit("")) == "", f"{field}: vacío")


def merge_outcomes(stored: DataFrame, incoming: DataFrame, keys: str | list[str], compare: list[str], three_state: tuple[str, ...] = ()) -> DataFrame:
    """Adds outcome to the incoming records (keys, compared columns, posicion, motivos).

    ``stored`` has the keys, the compared columns and eliminado.  Records with
    reasons are rejected and take no part in the order of their key.  Of a
    ``three_state`` column, <column>_present says whether a record has it: absent
    keeps the value before it (of the stored row or an earlier record), null clears it.
    """
    keys = [keys] if isinstance(keys, str) else keys
    marks = [f"{c}_present" for c in three_state]
    valid = incoming.filter(F.size("motivos") == 0).select(*keys, "posicion", *compare, F.lit(False).alias("eliminado"), *marks)
    front = stored.select(*keys, F.lit(-1).cast("long").alias("posicion"), *compare, "eliminado", *(F.lit(True).alias(m) for m in marks))
    by = W.partitionBy(*keys).orderBy("posicion")
    so_far = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = lambda c: F.last(F.when(F.col(f"{c}_present"), F.struct(F.col(c).alias("v"))), ignorenulls=True).over(so_far)["v"]
    both = front.unionByName(valid)
    both = both.withColumns({c: carried(c) for c in three_state}) if three_state else both
    before = lambda c: F.lag(c).over(by)
    same = F.lit(True)
    for c in compare:
        same = same & F.col(c).eqNullSafe(before(c))
    outcome = F.when(before("eliminado").isNull(), "created").when(before("eliminado"), "restored").when(same, "unchanged").otherwise("updated")
    judged = both.select(*keys, "posicion", *compare, outcome.alias("outcome")).filter("posicion >= 0")
    rejected = incoming.filter(F.size("motivos") > 0).select(*keys, "posicion", *compare, F.lit("rejected").alias("outcome"))
    return judged.unionByName(rejected)


def import_counts(outcomes: DataFrame) -> DataFrame:
    """One row with the number of each outcome."""
    return outcomes.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


def merged(stored: DataFrame, outcomes: DataFrame, keys: str | list[str], compare: list[str]) -> DataFrame:
    """The stored table after the import: the last valid record of each key wins."""
    keys = [keys] if isinstance(keys, str) else keys
    last = outcomes.filter("outcome <> 'rejected'").groupBy(*keys).agg(F.max_by(F.struct(*compare), "posicion").alias("n"))
    both = stored.join(last, keys, "full_outer")
    return both.select(*keys, *(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in compare), (F.col("n").isNull() & F.coalesce("eliminado", F.lit(False))).alias("eliminado"))


def keep_when_absent(value: Column, present: Column, stored: Column) -> Column:
    """Absent keeps the stored value; an explicit null clears it."""
    return F.when(present, value).otherwise(stored)


def look_up(records: DataFrame, directory: DataFrame, keys: str | list[str], found: str, reason: str, needed: Column | None = None) -> DataFrame:
    """Adds the directory's id as ``found`` and, where there is none though ``needed``, ``reason`` as motivo unless one is set already."""
    keys = [keys] if isinstance(keys, str) else keys
    ids = directory.select(*keys, F.col("id").alias(found))
    motive = F.col("motivo") if "motivo" in records.columns else F.lit(None).cast("string")
    missing = F.col(found).isNull() if needed is None else F.col(found).isNull() & needed
    return records.join(ids, keys, "left").withColumn("motivo", F.coalesce(motive, F.when(missing, reason)))


def _trimmed(records: DataFrame, *names: str) -> DataFrame:
    return records.withColumns({n: constraints.stripped(F.col(n)) for n in names})


def _judged(records: DataFrame, rules: tuple[constraints.Rule, ...], *more: Column) -> DataFrame:
    """motivos: what a lookup found missing, else all reasons of the record itself; values in their stored form.

    Records with JSON fields are dealt to the tasks by position before they are parsed, as a file's row group is one
    task however many records it has.  They are written as judged, since the valid and the rejected ones are two
    branches and a filter on motivos would parse and measure them again for each place that looks at them.
    """
    forms = constraints.json_forms(rules)
    formed = records.repartition("posicion").withColumns(forms) if forms else records
    each = reasons(*constraints.all_reasons(rules, formed=True), *more)
    judged = formed.withColumn("motivos", F.when(F.col("motivo").isNotNull(), F.array("motivo")).otherwise(each)).drop("motivo")
    judged = judged.withColumns(constraints.stored_forms(rules, formed=True)).drop(*forms)
    return cut(judged, "judged") if forms else judged


def _as_json(rows: DataFrame, column: str) -> DataFrame:
    """A structured column as JSON text; text stays."""
    return rows if rows.schema[column].dataType == T.StringType() else rows.withColumn(column, F.to_json(column))


def import_clients(stored: DataFrame, records: DataFrame) -> DataFrame:
    """Outcomes of clients (numero_cliente, nombre, estado, documento, localidad, barrio, direccion as JSON text or struct, posicion).

    An omitted estado becomes Activo; addresses are compared by content.
    """
    known = _as_json(records, "direccion").withColumn("motivo", F.lit(None).cast("string"))
    held = _as_json(stored.repartition("numero_cliente"), "direccion").withColumn("direccion", F.coalesce(constraints.json_text(F.col("direccion")), "direccion"))
    return merge_outcomes(held, _judged(known, constraints.CLIENT), "numero_cliente", [r.field for r in constraints.CLIENT[1:]])


def import_supplies(stored: DataFrame, records: DataFrame, clients: DataFrame, categories: DataFrame) -> DataFrame:
    """Outcomes of supplies; ``clients`` is (numero_cliente, id), ``categories`` (categoria_tarifaria, id).

    An omitted estado becomes Activo, any other text up to its limit stays; numbers
    that can't be read reject their record alone, and places are compared as numbers.
    """
    c = F.col
    known = _trimmed(records, "numero_cliente", "categoria_tarifaria")
    known = known.withColumn("motivo", blank(c("numero_cliente"), "numero_cliente"))
    known = look_up(known, clients, "numero_cliente", "cliente", "cliente inexistente")
    known = known.withColumn("motivo", F.coalesce("motivo", blank(c("categoria_tarifaria"), "categoria_tarifaria")))
    known = look_up(known, categories, "categoria_tarifaria", "categoria", "categoria tarifaria inexistente")
    place = lambda rows: rows.withColumns({x: c(x).try_cast("double") for x in ("latitud", "longitud")})
    judged = place(_judged(known, constraints.SUPPLY))
    return merge_outcomes(place(stored), judged, "numero_suministro", ["cliente", "categoria", "estado", "fecha_alta", "localidad", "barrio", "medidor", "latitud", "longitud"])


def import_readings(stored: DataFrame, records: DataFrame, supplies: DataFrame) -> DataFrame:
    """Outcomes of readings by (suministro, fecha_lectura); ``supplies`` is (numero_suministro, id)."""
    known = _trimmed(records, "numero_suministro").withColumn("motivo", blank(F.col("numero_suministro"), "numero_suministro"))
    known = look_up(known, supplies, "numero_suministro", "suministro", "suministro inexistente")
    judged = _judged(known, constraints.READING)
    return merge_outcomes(stored, judged, ["suministro", "fecha_lectura"], ["lectura_anterior", "lectura_actual", "dias_facturados"])


def import_batches(stored: DataFrame, records: DataFrame) -> DataFrame:
    """Outcomes of batches; nombre and cantidad_registros may be absent, and an explicit null number is refused.  The state is never touched."""
    c = F.col
    known = _trimmed(records, "codigo_lote").withColumn("motivo", F.when(c("cantidad_registros_present") & c("cantidad_registros").isNull(), "cantidad_registros: null explícito"))
    judged = _judged(known, (), blank(c("codigo_lote"), "codigo_lote"), F.when(c("cantidad_registros_present"), positive_integer_reason(c("cantidad_registros"), "cantidad_registros", 0)))
    out = merge_outcomes(stored, judged, "codigo_lote", ["nombre", "cantidad_registros"], ("nombre", "cantidad_registros"))
    return out.withColumn("cantidad_registros", F.when(c("outcome") != "rejected", F.coalesce("cantidad_registros", F.lit("0"))).otherwise(c("cantidad_registros")))


def import_consumption(stored: DataFrame, records: DataFrame, supplies: DataFrame, batches: DataFrame, readings: DataFrame) -> DataFrame:
    """Outcomes of billed periods by (suministro, fecha_inicio, fecha_fin).

    ``supplies`` is (numero_suministro, id), ``batches`` (codigo_lote, id) and
    ``readings`` (suministro, fecha_lectura, id).  An absent fecha_lectura keeps the
    stored reading, null clears it; an absent daily mean is computed from the record.
    """
    c = F.col
    known = _trimmed(records, "numero_suministro", "codigo_lote", "fecha_lectura").withColumn("motivo", blank(F.col("numero_suministro"), "numero_suministro"))
    known = look_up(known, supplies, "numero_suministro", "suministro", "suministro inexistente")
    known = known.withColumn("motivo", F.coalesce("motivo", blank(c("codigo_lote"), "codigo_lote")))
    known = look_up(known, batches, "codigo_lote", "lote", "lote inexistente")
    known = known.withColumn("motivo", F.coalesce("motivo", F.when(c("fecha_lectura").isNotNull() & iso_date(c("fecha_lectura")).isNull(), "fecha_lectura: inválida")))
    known = look_up(known, readings, ["suministro", "fecha_lectura"], "lectura", "lectura inexistente", c("fecha_lectura").isNotNull())
    begin, end = (iso_date(constraints.stripped(c(x))) for x in ("fecha_inicio", "fecha_fin"))
    judged = _judged(known, constraints.BILL, F.when(end < begin, "fecha_fin: anterior a fecha_inicio"))
    mean = daily_mean(c("kwh").try_cast("double"), c("dias_facturados").try_cast("int")).cast("string")
    judged = judged.withColumn("consumo_promedio_diario", F.when(c("consumo_promedio_diario_present"), c("consumo_promedio_diario")).otherwise(F.when(F.size("motivos") == 0, mean)))
    judged = judged.withColumn("lectura_present", c("fecha_lectura_present"))
    return merge_outcomes(stored, judged, ["suministro", "fecha_inicio", "fecha_fin"], ["lote", "lectura", "dias_facturados", "kwh", "consumo_promedio_diario"], ("lectura",))


def latest_deleted(rows: DataFrame, key: str, deleted_at: str, row_id: str) -> DataFrame:
    """The most recently deleted row of each key, ties by the greater id."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(deleted_at), F.desc(row_id)))
    return rows.filter(F.col(deleted_at).isNotNull()).withColumn("__r", rank).filter("__r = 1").drop("__r")
