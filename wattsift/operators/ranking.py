"""Reading results: ranking, summaries, neighbourhoods, reports and list pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift import constants as K
from wattsift.functions.scalar import circle_radius, clamp, level
from wattsift.operators.ranks import order_statistics

# Fixed value: shown for rows without a locality.
NO_LOCALITY = "Sin localidad"


def page(rows: DataFrame, order: list, limit: int = K.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """One page of sorted rows; limit from 1 to 200, offset from 0."""
    if not 1 <= limit <= K.PAGE_MAX or offset < 0:
        raise ValueError(f"limit must be from 1 to {K.PAGE_MAX} and offset not negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def ranked(results: DataFrame, level_is: str | None = None, class_is: str | None = None) -> DataFrame:
    if level_is is not None:
        results = results.filter(F.col("nivel") == level_is)
    return results if class_is is None else results.filter(F.col("clasificacion") == class_is)


def ranking_page(results: DataFrame, limit: int = K.PAGE_DEFAULT, offset: int = 0, level_is: str | None = None, class_is: str | None = None) -> DataFrame:
    """Results by falling risk index, then supply number."""
    return page(ranked(results, level_is, class_is), [F.desc("ire"), F.asc("numero"), F.asc("lote")], limit, offset)


def ranking_summary(results: DataFrame) -> DataFrame:
    """For each batch: total, numbers by level and class, supplies with anomalies, sum of IEE; filters never apply here."""
    named = lambda prefix, col, bands: [F.count_if(F.col(col) == name).alias(f"{prefix}_{i}") for i, (_, name) in enumerate(bands)]
    return results.groupBy("lote").agg(
        F.count(F.lit(1)).alias("total"), *named("nivel", "nivel", K.LEVELS), *named("clase", "clasificacion", K.CLASSES),
        F.count_if(F.col("n_anomalias") > 0).alias("con_anomalias"), F.coalesce(F.sum("iee"), F.lit(0.0)).alias("suma_iee"),
    )


def neighbourhood_risk(results: DataFrame) -> DataFrame:
    """By (locality, neighbourhood), nulls included: meters, rounded mean and greatest index, meters with anomalies, mean place, level of the greatest."""
    out = results.groupBy("localidad", "barrio").agg(
        F.count(F.lit(1)).alias("total_medidores"), F.floor(F.avg("ire") + 0.5).cast("int").alias("ire_promedio"), F.max("ire").alias("ire_maximo"),
        F.count_if(F.col("n_anomalias") > 0).alias("con_anomalias"), F.avg("latitud").alias("latitud"), F.avg("longitud").alias("longitud"),
    )
    return out.withColumns({"nivel": level(F.col("ire_maximo")), "radio": circle_radius(F.col("total_medidores"))})


def in_risk_order(neighbourhoods: DataFrame) -> DataFrame:
    """By falling greatest index, then locality and neighbourhood."""
    return neighbourhoods.orderBy(F.desc("ire_maximo"), "localidad", "barrio")


def of_locality(neighbourhoods: DataFrame, locality: str) -> DataFrame:
    """The neighbourhoods of one locality as shown: rows without one are under their own label."""
    return neighbourhoods.filter(F.coalesce("localidad", F.lit(NO_LOCALITY)) == locality)


def localities_seen(rows: DataFrame, order: str) -> DataFrame:
    """Localities in the order in which they first come, by ``order``."""
    return rows.groupBy(F.coalesce("localidad", F.lit(NO_LOCALITY)).alias("localidad")).agg(F.min(order).alias("primero")).orderBy("primero", "localidad")


def labelled_factors(scored: DataFrame) -> DataFrame:
    """factores with the factors' names for readers; a factor without one keeps its key."""
    names = F.create_map(*(F.lit(x) for pair in K.FACTOR_LABELS.items() for x in pair))
    return scored.withColumn("factores", F.transform("factores", lambda f: f.withField("factor", F.coalesce(F.try_element_at(names, f["factor"]), f["factor"]))))


def localities(results: DataFrame) -> DataFrame:
    """Localities in the order of their greatest index."""
    return results.groupBy(F.coalesce("localidad", F.lit(NO_LOCALITY)).alias("localidad")).agg(F.max("ire").alias("ire_maximo")).orderBy(F.desc("ire_maximo"), "localidad")


def heat_points(results: DataFrame) -> DataFrame:
    """(suministro, lote, lat, lon, peso) of results with a place; weight from 0 to 1."""
    placed = results.filter(F.col("latitud").isNotNull() & F.col("longitud").isNotNull())
    return placed.select("suministro", "lote", F.col("latitud").alias("lat"), F.col("longitud").alias("lon"), (clamp(F.col("ire").cast("double")) / 100).alias("peso"))


def score_distribution(rows: DataFrame, column: str) -> DataFrame:
    """For each batch: least, median, 95th percentile and greatest."""
    values = rows.select("lote", F.col(column).cast("double").alias("x"))
    found = order_statistics(values, ["lote"], ["x"], {"min": 0.0, "p50": 0.5, "p95": 0.95, "max": 1.0})
    return found.select("lote", F.col("x_min").alias("minimo"), F.col("x_p50").alias("p50"), F.col("x_p95").alias("p95"), F.col("x_max").alias("maximo"))


def top(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n greatest by falling value, ties by supply number and batch; nulls never count."""
    return rows.filter(F.col(column).isNotNull()).orderBy(F.desc(column), "numero", "lote").limit(n)


def top_factors(scored: DataFrame, n: int = 3) -> DataFrame:
    """Adds the n factors that contribute most."""
    largest = F.slice(F.reverse(F.array_sort(F.transform("factores", lambda f: F.struct(F.round(f["contribution"], 6).alias("contribution"), f["factor"].alias("factor"))))), 1, n)
    return scored.withColumn("principales", largest)


def iee_report(scored: DataFrame) -> DataFrame:
    """For each batch: total kWh and supplies above zero."""
    return scored.groupBy("lote").agg(F.coalesce(F.sum("iee"), F.lit(0.0)).alias("total_kwh"), F.count_if(F.col("iee") > 0).alias("con_iee"))


def anomalies_by_type(hits: DataFrame) -> DataFrame:
    """For each batch: anomalies of each type, zero if none."""
    types = [t for t, _ in K.RULES.values()] + [K.ML_ANOMALY[0]]
    return hits.groupBy("lote").agg(*(F.count_if(F.col("tipo") == t).alias(f"tipo_{i}") for i, t in enumerate(types)))


def with_anomaly_lists(results: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Adds anomalias, a list in the order of detection (the rules', then the model's), aggregated by (suministro, lote) before the join; empty if none."""
    shape = "array<struct<tipo:string,severidad:string,descripcion:string>>"
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, K.RULES)), F.col("regla")), F.lit(0)), F.lit(len(K.RULES) + 1))
    each = F.collect_list(F.struct(place.alias("orden"), F.struct("tipo", "severidad", "descripcion").alias("a")))
    lists = anomalies.groupBy("suministro", "lote").agg(F.transform(F.array_sort(each), lambda x: x["a"]).cast(shape).alias("anomalias"))
    return results.join(lists, ["suministro", "lote"], "left").withColumn("anomalias", F.coalesce("anomalias", F.array().cast(shape)))


def active(rows: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    """Rows that are not marked as deleted."""
    return rows.filter(F.col(deleted_at).isNull()).drop(deleted_at)


def with_impact(results: DataFrame, impacts: DataFrame) -> DataFrame:
    """Adds iee from stored estimates (suministro, lote, valor, moneda): those in kWh only, null without one."""
    own = impacts.filter(F.col("moneda") == K.IMPACT_UNIT).select("suministro", "lote", F.col("valor").alias("iee"))
    return results.drop("iee").join(own, ["suministro", "lote"], "left")
