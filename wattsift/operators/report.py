"""The report of processed batches: one document of eight parts for each batch.

Everything in a document is bounded: counts, distributions, the models, and the
greatest few of each list.  The greatest few are kept by each task before the
shuffle (``top_of``), so a batch of any size sends a handful of rows.  The lists
that grow with a batch (findings, exclusions, conflicted periods, anomalies) are
tables of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattsift import constants as K
from wattsift.functions.scalar import model_name, model_version
from wattsift.operators import duplicates, ranking, rules, validation
from wattsift.operators.ranks import order_statistics

TOP_SCORES, TOP_FACTORS, TOP_IMPACT = 10, 3, 5


def top_of(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their place (puesto), from 1.

    A rank that is filtered by a bound below the session's
    ``spark.sql.optimizer.windowGroupLimitThreshold`` is limited in each task before
    the shuffle, and again after it.
    """
    return rows.withColumn("puesto", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("puesto") <= n)


def _list(rows: DataFrame, name: str, shape: str, *fields: Column) -> DataFrame:
    """(lote, name): the rows of each batch as an array in the order of puesto."""
    entries = rows.groupBy("lote").agg(F.array_sort(F.collect_list(F.struct("puesto", F.struct(*fields).alias("e")))).alias("all"))
    return entries.select("lote", F.transform("all", lambda x: x["e"]).cast(f"array<{shape}>").alias(name))


def top_ml(scored: DataFrame, n: int = TOP_SCORES) -> DataFrame:
    """(lote, puesto, suministro, numero, ml_score, clasificacion_ml) of the n greatest scores of each batch, ties by number."""
    return top_of(scored.select("lote", "suministro", "numero", "ml_score", "clasificacion_ml"), "lote", [F.desc("ml_score"), F.asc("numero"), F.asc("suministro")], n)


def top_ire(scored: DataFrame, n: int = TOP_SCORES, factors: int = TOP_FACTORS) -> DataFrame:
    """(lote, puesto, suministro, numero, ire, nivel, clasificacion, principales) of the n greatest indices of each batch, with the factors that contribute most."""
    best = top_of(scored.select("lote", "suministro", "numero", "ire", "nivel", "clasificacion", "factores"), "lote", [F.desc("ire"), F.asc("numero"), F.asc("suministro")], n)
    return ranking.top_factors(best, factors).drop("factores")


def top_iee(scored: DataFrame, n: int = TOP_IMPACT) -> DataFrame:
    """(lote, puesto, suministro, numero, iee) of the n greatest estimates of each batch; zero is none."""
    return top_of(scored.filter("iee > 0").select("lote", "suministro", "numero", "iee"), "lote", [F.desc("iee"), F.asc("numero"), F.asc("suministro")], n)


def related_drift(batches: DataFrame, rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(lote, relacionado, declarados, activos, diferencia): for each batch the others that share a supply with it and have drifted.

    Only the supplies of drifted batches are joined, each pair of batches once per supply before it is made distinct.
    """
    drifted = duplicates.drift(batches, rows)
    of = rows if names is None else rows.filter(F.col("lote").isin(names))
    held = rows.join(drifted.select("lote"), "lote", "left_semi").select("suministro", F.col("lote").alias("relacionado")).distinct()
    pairs = of.select("suministro", "lote").distinct().join(held, "suministro").filter("lote <> relacionado").select("lote", "relacionado").distinct()
    return pairs.join(drifted.withColumnRenamed("lote", "relacionado"), "relacionado").select("lote", "relacionado", "declarados", "activos", "diferencia")


def models(scored: DataFrame) -> DataFrame:
    """(lote, alcance, modelo, version, suministros): the models that scored a batch, and how many supplies each."""
    counts = scored.groupBy("lote", "alcance").agg(F.count(F.lit(1)).alias("suministros"))
    return counts.select("lote", "alcance", model_name(F.col("alcance")).alias("modelo"), model_version(F.col("lote")).alias("version"), "suministros")


def _counts(**columns: Column) -> Column:
    """A map from names to counts."""
    return F.create_map(*(x for name, c in columns.items() for x in (F.lit(name), c)))


def _of_results(scored: DataFrame) -> DataFrame:
    """One aggregate of all that is counted or added in a batch's results."""
    fires = {r: F.coalesce(c, F.lit(False)) for r, c in rules.rule_conditions().items()}
    any_rule = sum((c.cast("int") for c in fires.values()), F.lit(0)) > 0
    own = (F.col("clasificacion_ml") == K.CLASSES[-1][1]) & ~any_rule
    return scored.groupBy("lote").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_cold_start").alias("cold"), F.count_if("has_conflicted_periods").alias("conflicted"), F.count_if(F.abs("zscore_self") >= K.SUMMARY_Z).alias("z"),
        F.count_if("iqr_outlier_flag").alias("iqr"), F.count_if(F.col("percentile_peer") >= K.SUMMARY_PERCENTILE).alias("pct"), F.count_if(any_rule).alias("with_hits"), F.count_if(own).alias("own"),
        *(F.count_if(c).alias(f"hits_{r}") for r, c in fires.items()), *(F.count_if(F.col("nivel") == name).alias(f"level_{i}") for i, (_, name) in enumerate(K.LEVELS)),
        F.coalesce(F.sum("iee"), F.lit(0.0)).alias("kwh"), F.count_if(F.col("iee") > 0).alias("with_iee"),
    )


def run_documents(drifts: DataFrame, checked: DataFrame, conflicts: DataFrame, scored: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(lote, informe, duplicidades, features, reglas, ml, ire, iee), a row for each batch that was checked.

    ``drifts`` are as from ``related_drift``, ``scored`` the results with the vectors' columns and the model's alcance,
    ml_score and clasificacion_ml; ``near`` are repeated readings (suministro, ...).
    Lists are empty and distributions null for a batch without results.
    """
    found = validation.findings(checked)
    report = validation.validation_report(checked, found)
    hits = found.groupBy("lote").agg(F.count(F.lit(1)).alias("hallazgos"))
    doubled = conflicts.groupBy("lote").agg(F.count(F.lit(1)).alias("periodos"), F.countDistinct("suministro").alias("conflictivos"))
    drifts = _list(drifts.withColumn("puesto", F.col("relacionado")), "drift", "struct<lote:string,cantidad_registros:bigint,consumos_activos:bigint,diferencia:bigint>", F.col("relacionado"), F.col("declarados"), F.col("activos"), F.col("diferencia"))
    totals = _of_results(scored)
    spread = order_statistics(scored, ["lote"], ["ml_score", "ire"], {"min": 0.0, "p50": 0.5, "p95": 0.95, "max": 1.0})
    person = "suministro:bigint,numero:string"
    lists = [
        _list(models(scored).withColumn("puesto", F.col("alcance")), "modelos", "struct<scope:string,modelo:string,version:string,suministros_entrenados:bigint>", F.col("alcance"), F.col("modelo"), F.col("version"), F.col("suministros")),
        _list(top_ml(scored), "top_ml", f"struct<{person},ml_score:double,clasificacion:string>", F.col("suministro"), F.col("numero"), F.col("ml_score"), F.col("clasificacion_ml")),
        _list(top_ire(scored), "top_ire", f"struct<{person},ire:int,nivel:string,clasificacion:string,top_factores:array<struct<contribution:double,factor:string>>>", F.col("suministro"), F.col("numero"), F.col("ire"), F.col("nivel"), F.col("clasificacion"), F.col("principales")),
        _list(top_iee(scored), "top_iee", f"struct<{person},iee_kwh:double>", F.col("suministro"), F.col("numero"), F.col("iee")),
    ]
    out = report.join(hits, "lote", "left").join(doubled, "lote", "left").join(drifts, "lote", "left").join(totals, "lote", "left").join(spread, "lote", "left")
    for one in lists:
        out = out.join(one, "lote", "left")
    if near is None:
        out = out.withColumn("near", F.lit(0).cast("long"))
    else:
        repeats = checked.select("lote", "suministro").distinct().join(near.groupBy("suministro").agg(F.count(F.lit(1)).alias("k")), "suministro").groupBy("lote").agg(F.sum("k").alias("near"))
        out = out.join(repeats, "lote", "left")
    number = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    empty = lambda name: F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType))
    spread_of = lambda c: F.when(F.col(f"{c}_min").isNotNull(), F.struct(*(F.col(f"{c}_{s}").alias(t) for s, t in (("min", "minimo"), ("p50", "p50"), ("p95", "p95"), ("max", "maximo")))))
    types = {t: number(f"hits_{r}") for r, (t, _) in K.RULES.items()} | {K.ML_ANOMALY[0]: number("own")}
    part = lambda name, **fields: F.struct(*(c.alias(k) for k, c in fields.items())).alias(name)
    return out.select(
        "lote", part("informe", total_suministros=F.col("suministros"), suministros_excluidos=F.col("excluidos"), fraccion_valida=F.col("fraccion_valida"), umbral_cumplido=F.col("cumple"), hallazgos=number("hallazgos")),
        part("duplicidades", periodos_conflictivos=number("periodos"), suministros_conflictivos=number("conflictivos"), lecturas_near_duplicate=number("near"), drift_lotes=empty("drift")),
        part("features", suministros_con_vector=number("n"), cold_starts=number("cold"), con_periodos_conflictivos=number("conflicted"), indicadores=F.struct(number("z").alias("zscore_extremos"), number("iqr").alias("iqr_outliers"), number("pct").alias("percentile_extremos"))),
        part("reglas", suministros_evaluados=number("n"), suministros_con_hits=number("with_hits"), hits_por_regla=_counts(**{r: number(f"hits_{r}") for r in K.RULES})),
        part("ml", modelos=empty("modelos"), suministros_scored=number("n"), distribucion=spread_of("ml_score"), top_10=empty("top_ml")),
        part("ire", suministros_evaluados=number("n"), distribucion=spread_of("ire"), conteo_por_nivel=_counts(**{name: number(f"level_{i}") for i, (_, name) in enumerate(K.LEVELS)}), top_10=empty("top_ire"), anomalias_por_tipo=_counts(**types)),
        part("iee", total_kwh_estimado=F.coalesce("kwh", F.lit(0.0)), suministros_con_iee=number("with_iee"), top_5=empty("top_iee")),
    )


def flat(documents: DataFrame) -> DataFrame:
    """(lote, seccion, campo, valor): every value of the documents as a row, numbers with six decimals, list entries numbered from 1."""
    from pyspark.sql import types as T

    def leaves(x: Column, kind: T.DataType, path: Column) -> Column:
        text = lambda c, t: F.round(c.cast("double"), 6).cast("decimal(38,6)").cast("string") if isinstance(t, (T.NumericType, T.BooleanType)) else c
        one = lambda p, v: F.struct(p.alias("campo"), v.alias("valor"))
        joined = lambda p, name: F.concat(p, F.when(p == "", "").otherwise("."), name)
        if isinstance(kind, T.StructType):
            parts = [leaves(x[f.name], f.dataType, joined(path, F.lit(f.name))) for f in kind.fields]
            return F.concat(*parts)
        if isinstance(kind, T.ArrayType):
            return F.flatten(F.transform(F.coalesce(x, F.array().cast(kind)), lambda e, i: leaves(e, kind.elementType, joined(path, (i + 1).cast("string")))))
        if isinstance(kind, T.MapType):
            return F.transform(F.map_entries(x), lambda e: one(joined(path, e["key"]), text(e["value"], kind.valueType)))
        return F.array(one(path, text(x, kind)))

    out = None
    for name in documents.columns[1:]:
        rows = documents.select("lote", F.lit(name).alias("seccion"), F.explode(leaves(F.col(name), documents.schema[name].dataType, F.lit(""))).alias("x")).select("lote", "seccion", "x.campo", "x.valor").filter("valor IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out
