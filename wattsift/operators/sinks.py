"""Mutations as table rewrites: upserts, replaced batches, soft deletes, the model registry, publication."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattsift.sources.shared import cut


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Old rows with new ones in the place of equal keys; old rows without a new one stay.

    Of several new rows of a key the last by ``order`` stays, without it any one.
    """
    columns = [c for c in old.columns if c not in keys]
    one = F.max_by(F.struct(*columns), order) if order else F.any_value(F.struct(*columns))
    last = new.groupBy(*keys).agg(one.alias("n")).select(*keys, *(F.col(f"n.{c}").alias(c) for c in columns))
    return old.join(last.select(*keys), keys, "left_anti").select(*old.columns).unionByName(last.select(*old.columns))


def numbered(rows: DataFrame, column: str, first: int = 1) -> DataFrame:
    """Adds dense numbers from ``first``: each task numbers its own rows, and the counts of the tasks before are added.

    The rows are written first, so that numbers stay what they are if a task runs again.
    """
    placed = cut(rows.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__place")), "numbered")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    offsets = sizes.select("__part", "__first", before.alias("__before"))
    out = placed.join(F.broadcast(offsets), "__part")
    return out.select(*rows.columns, (F.col("__before") + F.col("__place") - F.col("__first") + first).alias(column))


def upsert_with_ids(stored: DataFrame, new: DataFrame, keys: list[str], row_id: str = "id") -> DataFrame:
    """The stored table, whose rows have ids, with ``new`` by key: rows met again keep their id and take the new values, others get the next ids.

    Stored rows that are not given again stay.  ``new`` has each key once.
    """
    columns = [c for c in stored.columns if c not in (*keys, row_id)]
    known = stored.select(*keys, row_id)
    found = new.select(*keys, *columns).join(known, keys, "left")
    again, fresh = found.filter(F.col(row_id).isNotNull()), found.filter(F.col(row_id).isNull()).drop(row_id)
    last = stored.agg(F.coalesce(F.max(row_id), F.lit(0))).first()[0]
    untouched = stored.join(new.select(*keys), keys, "left_anti")
    return untouched.select(*stored.columns).unionByName(again.select(*stored.columns)).unionByName(numbered(fresh, row_id, last + 1).select(*stored.columns))


def backfill(vectors: DataFrame, results: DataFrame, keys: list[str], column: str, row_id: str = "id") -> DataFrame:
    """Vectors with the id of their result; those without one keep what they have."""
    ids = results.select(*keys, F.col(row_id).alias("__id"))
    return vectors.join(ids, keys, "left").withColumn(column, F.coalesce("__id", column)).drop("__id")


def replace_batch(old: DataFrame, new: DataFrame, batches: DataFrame, now) -> DataFrame:
    """Active rows of the given batches are marked deleted, then the new rows are added, even if there are none."""
    marked = old.join(batches.select("lote", F.lit(True).alias("__hit")), "lote", "left")
    gone = marked.withColumn("deleted_at", F.when(F.col("__hit") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).drop("__hit")
    return gone.select(*old.columns).unionByName(new.withColumn("deleted_at", F.lit(None).cast(old.schema["deleted_at"].dataType)).select(*old.columns))


def soft_delete(rows: DataFrame, condition, now) -> DataFrame:
    return rows.withColumn("deleted_at", F.when(condition & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at")))


def register_models(fits: DataFrame) -> DataFrame:
    """(nombre, version, orden) to the registry: of each name the latest version is Activo, the others Obsoleto."""
    latest = fits.groupBy("nombre").agg(F.max_by("version", "orden").alias("__last"))
    once = fits.groupBy("nombre", "version").agg(F.max("orden").alias("orden"))
    return once.join(latest, "nombre").select("nombre", "version", "orden", F.when(F.col("version") == F.col("__last"), "Activo").otherwise("Obsoleto").alias("estado"))


def write_batches(rows: DataFrame, path: str, *partitions: str) -> None:
    """Overwrite only the partitions that ``rows`` holds; running it again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def publish(spark: SparkSession, path: str, batches: str | list[str], tables: dict[str, DataFrame]) -> str:
    """Write the tables of one or more batches as a new run, then make all of them visible at once by rows of ``publicaciones``.

    Nothing is replaced: readers of the run before keep their files, a run that
    fails half way is never seen, and a table without rows replaces one with rows.
    In a run of several batches a row belongs to the batch in its column lote.
    """
    batches = [batches] if isinstance(batches, str) else batches
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{name}/corrida={run}")
    spark.createDataFrame([(b, run, len(batches)) for b in batches], "lote string, corrida string, lotes int").coalesce(1).write.mode("append").parquet(f"{path}/publicaciones")
    return run


def published(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table's rows of each batch's latest run; none before the first publication."""
    try:
        runs = spark.read.parquet(f"{path}/publicaciones")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    latest = runs.groupBy("lote").agg(F.max_by(F.struct("corrida", "lotes"), "corrida").alias("r")).select(F.col("lote").alias("__lote"), F.col("r.corrida").alias("__corrida"), F.col("r.lotes").alias("__lotes"))
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}")
    of_latest = (rows["corrida"] == latest["__corrida"]) & ((latest["__lotes"] == 1) | (rows["lote"] == latest["__lote"]))
    return rows.join(latest, of_latest, "left_semi").drop("corrida")


def published_by_key(spark: SparkSession, path: str, name: str, keys: list[str]) -> DataFrame | None:
    """A table's rows of all published runs, of each key the latest: a row that a later run of its batch doesn't give again stays."""
    try:
        runs = spark.read.parquet(f"{path}/publicaciones")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    shown = runs.select(F.col("lote").alias("__lote"), F.col("corrida").alias("__corrida"), F.col("lotes").alias("__lotes"))
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}")
    seen = rows.join(shown, (rows["corrida"] == shown["__corrida"]) & ((shown["__lotes"] == 1) | (rows["lote"] == shown["__lote"])), "left_semi")
    values = [c for c in rows.columns if c not in (*keys, "corrida")]
    return seen.groupBy(*keys).agg(F.max_by(F.struct(*values), "corrida").alias("v")).select(*keys, *(F.col(f"v.{c}").alias(c) for c in values))


def upsert_rejecting(old: DataFrame, new: DataFrame, key: str, unique: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(table, rejected): ``upsert`` by ``key``, but of rows with different keys and equal ``unique`` columns only the first stays.

    Stored rows come before new ones, these in their order; a rejected record leaves the others alone.
    """
    incoming = new.select(*old.columns, F.col(order).cast("long").alias("__at"))
    stored = old.join(new.select(key).distinct(), key, "left_anti").withColumn("__at", F.lit(-1).cast("long"))
    both = stored.select(*incoming.columns).unionByName(incoming)
    first = F.min_by(key, "__at").over(W.partitionBy(*unique))
    judged = both.withColumn("__ok", first == F.col(key))
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc("__at")))
    good = judged.filter("__ok").withColumn("__r", last).filter("__r = 1").select(*old.columns)
    return good, judged.filter("NOT __ok").select(*old.columns)


def feature_vectors(vectors: DataFrame, version: str = "v1") -> DataFrame:
    """(suministro, lote, version, features as JSON) for the vector store."""
    names = [c for c in vectors.columns if c not in ("suministro", "lote")]
    return vectors.select("suministro", "lote", F.lit(version).alias("version"), F.to_json(F.struct(*names)).alias("features"))


def manifest(content: dict) -> str:
    """Deterministic JSON text."""
    return json.dumps(content, sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n"
