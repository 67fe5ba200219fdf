"""The billing domain as views over the benchmark's star schema.

Supplies are suppliers, tariff categories are regions, localities are nations;
a billing period is a supplier's month of line items, a batch ("lote") is a
month.  ``SQL`` holds the same views as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Region key to tariff category.
CATEGORIES = ("Residencial", "Comercial", "Industrial", "Alumbrado Público", "Grandes Demandas")
#: Category that the views mark as deleted.
DELETED_CATEGORY = "Grandes Demandas"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suministro, numero, estado, fecha_alta, categoria, localidad, barrio, latitud, longitud."""
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("n_regionkey") + 1)
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.alias("suministro"), F.col("s_name").alias("numero"), F.when(F.col("s_acctbal") < 0, "Baja").otherwise("Activo").alias("estado"),
        F.date_add(F.lit("1994-01-01").cast("date"), (key * 37 % 2000).cast("int")).alias("fecha_alta"), category.alias("categoria"), F.col("n_name").alias("localidad"),
        F.when(key % 4 != 3, F.concat(F.lit("Barrio "), (key % 4).cast("string"))).alias("barrio"),
        F.when(key % 11 != 0, -34.0 - (key % 1000) / 1000.0).alias("latitud"), F.when(key % 11 != 0, -58.0 - (key % 777) / 1000.0).alias("longitud"),
    )


def consumption(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """suministro, inicio, fin, dias, kwh, lote: a row for each supply and month; ``sparse`` bills returned items only, so months are zero."""
    billed = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0) if sparse else F.col("l_quantity")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("suministro"), month.alias("inicio")).agg(F.sum(billed).alias("kwh"))
    return rows.select("suministro", "inicio", F.last_day("inicio").alias("fin"), F.dayofmonth(F.last_day("inicio")).alias("dias"), "kwh", F.date_format("inicio", "'LOTE-'yyyy-MM").alias("lote"))


def billed_with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``consumption`` with planted faults by key: periods that run into the next month, negative kWh, and a second batch for corrected bills."""
    code = F.col("suministro") + F.year("inicio") * 12 + F.month("inicio")
    fin = F.when(code % 23 == 0, F.date_add("fin", 9)).otherwise(F.col("fin"))
    kwh = F.when(code % 29 == 0, -F.col("kwh")).otherwise(F.col("kwh"))
    lote = F.when(code % 31 == 0, F.concat(F.lit("AJUSTE-"), F.year("inicio").cast("string"))).otherwise(F.col("lote"))
    return consumption(spark, sf_dir).select("suministro", "inicio", fin.alias("fin"), "dias", kwh.alias("kwh"), lote.alias("lote"))


def insert_missing_categories(stored: DataFrame) -> DataFrame:
    """The stored category names (nombre) and those of ``CATEGORIES`` that are missing."""
    seed = stored.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "nombre string")
    return stored.select("nombre").unionByName(seed.join(stored.select("nombre"), "nombre", "left_anti"))


def readings(consumption_rows: DataFrame) -> DataFrame:
    """The meter readings behind consumption rows, with planted faults by key: missing, off by one, wrong days."""
    from pyspark.sql import Window as W

    month = F.year("inicio") * 12 + F.month("inicio")
    code = F.col("suministro") + month
    counter = F.sum("kwh").over(W.partitionBy("suministro").orderBy("inicio").rowsBetween(W.unboundedPreceding, 0))
    return consumption_rows.select("suministro", "inicio", (counter - F.col("kwh")).alias("lectura_anterior"), (counter + F.when(code % 17 == 0, 1.0).otherwise(0.0)).alias("lectura_actual"), (F.col("dias") + F.when(code % 19 == 0, 1).otherwise(0)).alias("lectura_dias")).filter(code % 13 != 0)


def contract_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods that overlap: periodo, suministro, inicio, fin from orders, up to 59 days each."""
    start = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("periodo"), F.col("o_custkey").alias("suministro"), start.alias("inicio"), F.date_add(start, (F.col("o_orderkey") % 60).cast("int")).alias("fin"))


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that may repeat: lectura, suministro, tipo, fecha, valor from events."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("lectura"), F.col("user_id").alias("suministro"), F.col("event_type").alias("tipo"), F.col("ts").cast("date").alias("fecha"), F.floor(F.col("value")).alias("valor"))


_SUPPLIES = """
sumin AS (
  SELECT s_suppkey AS suministro, s_name AS numero, CASE WHEN s_acctbal < 0 THEN 'Baja' ELSE 'Activo' END AS estado,
         DATE '1994-01-01' + CAST(s_suppkey * 37 % 2000 AS INTEGER) AS fecha_alta,
         CASE n_regionkey WHEN 0 THEN 'Residencial' WHEN 1 THEN 'Comercial' WHEN 2 THEN 'Industrial' WHEN 3 THEN 'Alumbrado Público' ELSE 'Grandes Demandas' END AS categoria,
         n_name AS localidad, CASE WHEN s_suppkey % 4 <> 3 THEN 'Barrio ' || CAST(s_suppkey % 4 AS VARCHAR) END AS barrio,
         CASE WHEN s_suppkey % 11 <> 0 THEN CAST(-34 AS DOUBLE) - (s_suppkey % 1000) / CAST(1000 AS DOUBLE) END AS latitud,
         CASE WHEN s_suppkey % 11 <> 0 THEN CAST(-58 AS DOUBLE) - (s_suppkey % 777) / CAST(1000 AS DOUBLE) END AS longitud
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

_CONSUMPTION = """
cons AS (
  SELECT suministro, inicio, last_day(inicio) AS fin, CAST(day(last_day(inicio)) AS INTEGER) AS dias, kwh, strftime(inicio, 'LOTE-%Y-%m') AS lote
  FROM (SELECT l_suppkey AS suministro, CAST(date_trunc('month', l_shipdate) AS DATE) AS inicio, sum({billed}) AS kwh FROM lineitem GROUP BY 1, 2))"""

#: Common table expressions by name; "cons" exists twice.
SQL = {
    "sumin": _SUPPLIES,
    "dense": _CONSUMPTION.format(billed="l_quantity"),
    "sparse": _CONSUMPTION.format(billed="CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END"),
    "faulty": _CONSUMPTION.format(billed="l_quantity").replace("cons AS", "plain AS") + """,
cons AS (
  SELECT suministro, inicio, CASE WHEN code % 23 = 0 THEN fin + 9 ELSE fin END AS fin, dias, CASE WHEN code % 29 = 0 THEN -kwh ELSE kwh END AS kwh,
         CASE WHEN code % 31 = 0 THEN 'AJUSTE-' || year(inicio) ELSE lote END AS lote
  FROM (SELECT *, suministro + year(inicio) * 12 + month(inicio) AS code FROM plain))""",
    "lect": """
lect AS (
  SELECT suministro, inicio, c - kwh AS lectura_anterior, c + CASE WHEN code % 17 = 0 THEN 1.0 ELSE 0.0 END AS lectura_actual,
         dias + CASE WHEN code % 19 = 0 THEN 1 ELSE 0 END AS lectura_dias
  FROM (SELECT *, suministro + year(inicio) * 12 + month(inicio) AS code, sum(kwh) OVER (PARTITION BY suministro ORDER BY inicio ROWS UNBOUNDED PRECEDING) AS c FROM cons)
  WHERE code % 13 <> 0)""",
    "peri": """
peri AS (
  SELECT o_orderkey AS periodo, o_custkey AS suministro, CAST(o_orderdate AS DATE) AS inicio, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS fin FROM orders)""",
    "evlec": """
evlec AS (
  SELECT event_id AS lectura, user_id AS suministro, event_type AS tipo, CAST(ts AS DATE) AS fecha, CAST(floor(value) AS BIGINT) AS valor FROM events)""",
}
