"""Processing batches: state, gate, validation, duplicates, features to scores, report, and publication.

Checks, features, cohorts and rules of all batches are one plan.  Only the memory
of earlier anomalies makes batches depend on each other, and only those that
share a supply.  So batches are put in levels: those of one level share no supply
and run as one plan, after all earlier batches they share one with.  A level's
results are written before the next begins, which also cuts the lineage.  The
memory is a running count by supply, so a level costs what its own rows cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattsift import constants as K
from wattsift.operators import cohort, duplicates, features, forest, ranking, report, rules, scoring, sinks, validation
from wattsift.sources.shared import cut

PENDING, RUNNING, DONE, FAILED = "Pendiente", "Procesando", "Procesado", "Error"
#: Allowed changes of a batch's state.
TRANSITIONS = {(PENDING, RUNNING), (FAILED, RUNNING), (RUNNING, DONE), (RUNNING, FAILED)}


class UnknownBatch(LookupError):
    """No such batch."""


class BatchConflict(RuntimeError):
    """The batch is running, done, or changed meanwhile."""


class IncompleteBatch(ValueError):
    """Declared and active rows differ."""


def change_state(current: str, to: str) -> str:
    if (current, to) not in TRANSITIONS:
        raise BatchConflict(f"{current} -> {to}")
    return to


def vectors(consumption: DataFrame, supplies: DataFrame, whole: bool = False) -> DataFrame:
    """Feature vectors with cohort indicators, one for each supply and batch, of rows that need no cleaning.

    Where the ``whole`` vectors are wanted, features are written first, as cohorts read
    them for their values and again for the rows; else a query computes only the columns it reads.
    """
    rows = features.static_features(features.history_features(consumption), supplies).withColumn("has_conflicted_periods", F.lit(False))
    rows = features.current_period(rows)
    return cohort.cohort_indicators(cut(rows, "features") if whole else rows)


def check(consumption: DataFrame, supplies: DataFrame, readings: DataFrame, deleted_categories: DataFrame | None = None) -> DataFrame:
    """Consumption as the integrity checks want it."""
    return validation.validation_rows(consumption.join(supplies.select("suministro", "categoria"), "suministro"), readings, deleted_categories)


def cleaned_vectors(consumption: DataFrame, supplies: DataFrame, excluded: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Vectors of the supplies that validation left in each batch, from the history without conflicted periods.

    The zero streak is that of the whole history: a removed period must not
    bridge two streaks.  Excluded supplies are no peers in a cohort either.
    """
    history = features.without_conflicts(consumption, conflicts, "suministro", "inicio", "lote")
    streaks = features.streak_of_all(consumption).groupBy("suministro", "inicio").agg(F.min("zero_consumption_streak").alias("zero_consumption_streak"))
    rows = features.history_features(history).drop("zero_consumption_streak").join(streaks, ["suministro", "inicio"])
    marked = conflicts.select("suministro", F.lit(True).alias("has_conflicted_periods")).distinct()
    rows = rows.join(marked, "suministro", "left").withColumn("has_conflicted_periods", F.coalesce("has_conflicted_periods", F.lit(False)))
    rows = features.current_period(features.static_features(rows, supplies))
    rows = rows.join(excluded.select("lote", "suministro").distinct(), ["lote", "suministro"], "left_anti")
    return cohort.cohort_indicators(cut(rows, "features"))  # cohorts read it for their values and again for the rows


def scored(vector_rows: DataFrame, ml: DataFrame | None = None, reasons: bool = False) -> DataFrame:
    """IEE, scales and IRE; without ``ml`` the model's score counts as zero.

    Where the vectors have no prior_anomaly_count, it is counted here: the rules'
    hits and, with ``ml``, the model's own anomalies in earlier batches.
    """
    rows = vector_rows if "prior_anomaly_count" in vector_rows.columns else rules.prior_anomalies(vector_rows, ml)
    rows = rules.with_hit_count(rows)
    if ml is None:
        rows = rows.withColumn("ml_score", F.lit(0.0)).withColumn("clasificacion_ml", F.lit("Normal"))
    else:
        rows = rows.join(ml.select("suministro", "lote", "ml_score", "clasificacion_ml", *(c for c in ml.columns if c == "alcance")), ["suministro", "lote"])
        rows = cut(rows, "modelled") if reasons else rows  # scales and percentiles read the rows again, and would compute the model's scores for it
    rows = rows.withColumn("n_anomalias", rules.anomaly_count(F.col("clasificacion_ml")))
    rows = scoring.batch_scales(scoring.with_iee(rows))
    return scoring.with_ire(scoring.exposure_percentile(rows) if reasons else rows, reasons)


def anomalies(scored_rows: DataFrame) -> DataFrame:
    """Rule hits, and the model's own anomaly where it is critical and no rule fired."""
    tipo, severidad = K.ML_ANOMALY
    own = scored_rows.filter((F.col("clasificacion_ml") == K.CLASSES[-1][1]) & (F.col("n_reglas") == 0))
    text = F.format_string("Patrón irregular según el modelo de IA (score %.1f/100)", "ml_score")
    return rules.rule_hits(scored_rows).unionByName(own.select("suministro", "lote", F.lit("ML").alias("regla"), F.lit(tipo).alias("tipo"), F.lit(severidad).alias("severidad"), text.alias("descripcion")))


def _section(name: str, rows: DataFrame) -> DataFrame:
    """(lote, seccion, clave, valor) from a row of numbers for each batch."""
    keys = [c for c in rows.columns if c != "lote"]
    numbers = rows.select("lote", *((F.col(c).cast("int") if t == "boolean" else F.col(c)).cast("double").alias(c) for c, t in rows.dtypes if c != "lote"))
    return numbers.unpivot("lote", keys, "clave", "valor").select("lote", F.lit(name).alias("seccion"), "clave", "valor").filter("valor IS NOT NULL")


def run_report(batches: DataFrame, consumption: DataFrame, checked: DataFrame, conflicts: DataFrame, scored_rows: DataFrame, found: DataFrame) -> DataFrame:
    """The sections of a run's report for each batch, as (lote, seccion, clave, valor).

    Completeness, validation, duplicates, features, rules, model, index and
    unbilled energy; ``scored_rows`` and ``found`` are the results and anomalies.
    """
    gate = validation.completeness(batches, consumption).drop("motivo")
    report = validation.validation_report(checked, validation.findings(checked))
    repeated = conflicts.groupBy("lote").agg(F.count(F.lit(1)).alias("periodos"), F.countDistinct("suministro").alias("suministros"))
    levels = ranking.ranking_summary(scored_rows).select("lote", "total", *(f"nivel_{i}" for i in range(len(K.LEVELS))), "con_anomalias")
    scores = scored_rows.groupBy("lote").agg(F.count(F.lit(1)).alias("evaluados")).join(ranking.score_distribution(scored_rows, "ml_score"), "lote")
    parts = {
        "completitud": [gate], "validacion": [report], "duplicidades": [repeated, duplicates.drift(batches, consumption).select("lote", "diferencia")],
        "features": [features.features_summary(scored_rows)], "reglas": [rules.rules_summary(scored_rows)], "ml": [scores],
        "ire": [levels, ranking.score_distribution(scored_rows, "ire"), ranking.anomalies_by_type(found)], "iee": [ranking.iee_report(scored_rows)],
    }
    out = None
    for name, tables in parts.items():
        for t in tables:
            out = _section(name, t) if out is None else out.unionByName(_section(name, t))
    return out


_ANOMALIES = "suministro bigint, lote string, regla string, tipo string, severidad string, descripcion string"


def _counts(found: DataFrame) -> DataFrame:
    return found.groupBy("suministro").agg(F.count(F.lit(1)).alias("n"))


def levels(rows: DataFrame, names: list[str]) -> list[list[str]]:
    """The batches in levels, each in the order given: those of one share no supply of (suministro, lote), and each comes after all earlier ones it shares one with.

    A supply links each of its batches to the next one only, which is enough; what
    reaches the driver are distinct pairs of the named batches.
    """
    place = rows.sparkSession.createDataFrame(list(enumerate(names)), "lugar int, lote string")
    own = rows.join(F.broadcast(place), "lote").select("suministro", "lugar").distinct()
    before = F.lag("lugar").over(W.partitionBy("suministro").orderBy("lugar"))
    links = own.select(before.alias("a"), F.col("lugar").alias("b")).filter("a IS NOT NULL").distinct().collect()
    at = [0] * len(names)
    for a, b in sorted((r["a"], r["b"]) for r in links):  # all links into a come before those out of it
        at[b] = max(at[b], at[a] + 1)
    return [[n for n, k in zip(names, at) if k == level] for level in range(max(at, default=-1) + 1)]


def _started(names: list[str], states: dict[str, str]) -> dict[str, str]:
    """The states with all named batches running; nothing has started if one of them can't."""
    for n in names:
        if n not in states:
            raise UnknownBatch(n)
    return {n: change_state(states[n], RUNNING) for n in names}


def process_batches(vector_rows: DataFrame, batches: list[str], path: str, states: dict[str, str], valid: dict[str, bool] | None = None, trees: int = K.TREES, gate: DataFrame | None = None, recount: DataFrame | None = None, more=None) -> dict[str, str]:
    """Score the batches level by level, with all anomalies so far as memory, and publish results and anomalies under ``path``.

    ``states`` are the batches' current states; the result has the new ones.  A
    batch below the valid share is scored all the same and ends as failed.  With
    ``gate`` (``validation.completeness``) an incomplete batch is refused; with
    ``recount`` too (active rows counted again, after the rows were read), one
    whose number has changed; then none of the batches starts.  A level's tables
    become visible together, batch by batch; a retry sees its own earlier anomalies
    and replaces them, also by none.  ``more(names, results)`` gives further tables to publish with them.
    """
    spark = vector_rows.sparkSession
    running = _started(batches, states)
    for batch in batches:
        if gate is not None:
            require_complete(gate, batch)
            if recount is not None:
                require_unchanged(gate, recount, batch)
    out = states | running
    published = sinks.published(spark, path, "anomalias")
    published = spark.createDataFrame([], _ANOMALIES) if published is None else published.select("suministro", "lote", "regla", "tipo", "severidad", "descripcion")
    memory = cut(_counts(published), "memory")
    for names in levels(vector_rows, batches):
        of_level = lambda df, names=names: df.filter(F.col("lote").isin(names))
        prior = memory.withColumnRenamed("n", "prior_anomaly_count")
        rows = of_level(vector_rows).drop("prior_anomaly_count").join(prior, "suministro", "left").withColumn("prior_anomaly_count", F.coalesce("prior_anomaly_count", F.lit(0)))
        rows = cut(rows, "level")
        result = cut(scored(rows, forest.ml_scores(rows, trees), reasons=True), "scored")
        found = cut(anomalies(result), "anomalies")
        kept = result.select("suministro", "lote", "numero", "localidad", "barrio", "categoria", "latitud", "longitud", "ml_score", "iee", "ire", "nivel", "clasificacion", "n_anomalias", F.to_json("factores").alias("observaciones"))
        stored = sinks.feature_vectors(rows).withColumn("resultado", F.concat_ws("|", "lote", F.col("suministro").cast("string")))
        sinks.publish(spark, path, names, {"resultados": kept, "anomalias": found, "vectores": stored, "ire": scoring.index_rows(result), "impactos": scoring.impact_rows(result)} | (more(names, result) if more else {}))
        earlier = _counts(of_level(published)).select("suministro", (-F.col("n")).alias("n"))
        memory = cut(memory.unionByName(earlier).unionByName(_counts(found)).groupBy("suministro").agg(F.sum("n").alias("n")).filter("n > 0"), "memory")
        out |= {n: change_state(RUNNING, DONE if (valid or {}).get(n, True) else FAILED) for n in names}
    return out


def process(consumption: DataFrame, supplies: DataFrame, readings: DataFrame, batches: DataFrame, names: list[str], path: str, deleted_categories: DataFrame | None = None, trees: int = K.TREES) -> dict[str, str]:
    """All stages from raw tables to published runs, for the named batches in their order; returns their new states.

    ``consumption`` is (suministro, inicio, fin, dias, kwh, lote) of all batches,
    ``batches`` (lote, declarados, estado).  In turn: every batch is known, may
    start, and is complete; the whole history of its supplies is read once and
    written, and its rows are as many as the gate counted; checks, exclusions and
    conflicted periods; vectors; then model, index, anomalies and report, level by
    level.  Published with each batch: resultados, ire, impactos, anomalias, vectores, hallazgos,
    exclusiones, conflictos and informes (``report.run_documents``).  If anything is
    refused, nothing has changed.  A batch of which too few supplies are valid ends
    as failed and can be processed again.
    """
    named = lambda df: df.filter(F.col("lote").isin(names))
    states = {r["lote"]: r["estado"] for r in named(batches.select("lote", "estado")).collect()}
    _started(names, states)
    gate = {r["lote"]: r for r in validation.completeness(named(batches), named(consumption)).collect()}
    for n in names:
        if not gate[n]["completo"]:
            raise IncompleteBatch(gate[n]["motivo"])
    own = named(consumption).select("suministro").distinct()
    rows = cut(consumption.join(own, "suministro", "left_semi"), "history")
    counted = {r["lote"]: r["activos"] for r in named(rows).groupBy("lote").agg(F.count(F.lit(1)).alias("activos")).collect()}
    for n in names:
        if counted.get(n, 0) != gate[n]["activos"]:
            raise BatchConflict(f"{n} has changed")
    checked = cut(named(check(rows, supplies, readings, deleted_categories)), "checked")
    found = cut(validation.findings(checked), "findings")
    conflicts = cut(duplicates.conflicted_periods(rows), "conflicts")
    excluded = cut(validation.exclusions(found), "excluded")
    valid = {r["lote"]: r["cumple"] for r in validation.validation_report(checked, found).select("lote", "cumple").collect()}
    vector_rows = cut(named(cleaned_vectors(rows, supplies, excluded, conflicts)), "vectors")
    drifts = cut(report.related_drift(batches, consumption, names), "drifts")
    near = duplicates.near_duplicate_readings(readings.select("suministro", F.lit("").alias("tipo"), F.col("lectura_actual").alias("valor"), F.col("inicio").alias("lectura"), F.col("inicio").alias("fecha")))

    def more(level: list[str], result: DataFrame) -> dict[str, DataFrame]:
        of_level = lambda df: df.filter(F.col("lote").isin(level))
        documents = report.run_documents(of_level(drifts), of_level(checked), of_level(conflicts), result, near)
        return {"hallazgos": of_level(found), "exclusiones": of_level(excluded), "conflictos": of_level(conflicts), "informes": documents}

    out = process_batches(vector_rows, names, path, states, valid, trees, more=more)
    return {n: out[n] for n in names}


def require_complete(gate: DataFrame, batch: str) -> None:
    row = gate.filter(F.col("lote") == batch).first()
    if row is None:
        raise UnknownBatch(batch)
    if not row["completo"]:
        raise IncompleteBatch(row["motivo"])


def require_unchanged(gate: DataFrame, recount: DataFrame, batch: str) -> None:
    """``recount`` has (lote, activos) of the rows that were read."""
    counted = recount.filter(F.col("lote") == batch).first()
    if (counted["activos"] if counted else 0) != gate.filter(F.col("lote") == batch).first()["activos"]:
        raise BatchConflict(f"{batch} has changed")
