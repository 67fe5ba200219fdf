"""From raw tables to published runs: refusals, retries, levels of batches, and the report's documents."""

import json
from datetime import date as D

import pytest
from pyspark.sql import functions as F

from wattsift import constants as K
from wattsift.operators import process, report, sinks

CONSUMPTION = "suministro long, inicio date, fin date, dias int, kwh double, lote string"
READINGS = "suministro long, inicio date, lectura_anterior double, lectura_actual double, lectura_dias int"
LAST = {1: 31, 2: 29, 3: 31, 4: 30, 5: 31}


def month(s, m, kwh, lote=None, first=1, last=None):
    last = last or LAST[m]
    return (s, D(2024, m, first), D(2024, m, last), last - first + 1, float(kwh), lote or f"L{m}")


def tables(spark, rows, declared=None, states=None):
    consumption = spark.createDataFrame(rows, CONSUMPTION)
    ids = sorted({r[0] for r in rows})
    supplies = spark.createDataFrame([(i, f"S{i:03}", "Activo", D(2020, 1, 1), "Residencial", "Norte" if i % 2 else "Sur", None, None, None) for i in ids], "suministro long, numero string, estado string, fecha_alta date, categoria string, localidad string, barrio string, latitud double, longitud double")
    readings = spark.createDataFrame([(s, a, 0.0, kwh, days) for s, a, _, days, kwh, _ in rows], READINGS)
    lotes = {}
    for r in rows:
        lotes[r[5]] = lotes.get(r[5], 0) + 1
    lotes |= declared or {}
    batches = spark.createDataFrame([(n, k, (states or {}).get(n, process.PENDING)) for n, k in sorted(lotes.items())], "lote string, declarados long, estado string")
    return consumption, supplies, readings, batches


def run(spark, given, names, path, **more):
    return process.process(*given, names, path, trees=10, **more)


def test_refusals_change_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    given = tables(spark, [month(i, m, 10 + i) for i in range(4) for m in (1, 2)], declared={"L2": 5}, states={"L1": process.DONE})
    with pytest.raises(process.IncompleteBatch, match="declarados 5, activos 4"):
        run(spark, given, ["L2"], path)
    with pytest.raises(process.UnknownBatch):
        run(spark, given, ["L2", "?"], path)
    with pytest.raises(process.BatchConflict):
        run(spark, given, ["L1"], path)
    assert sinks.published(spark, path, "resultados") is None


def test_a_batch_that_changes_meanwhile(spark, tmp_path, monkeypatch):
    """A row that comes between the gate and the reading refuses the batch; corrected, it is processed."""
    path, rows = str(tmp_path / "out"), [month(1, 1, 5)]
    given, extra = tables(spark, rows), spark.createDataFrame([month(1, 2, 7, "L1")], CONSUMPTION)
    cut = process.cut
    monkeypatch.setattr(process, "cut", lambda df, name: cut(df.unionByName(extra) if name == "history" else df, name))
    with pytest.raises(process.BatchConflict):
        run(spark, given, ["L1"], path)
    monkeypatch.undo()
    assert sinks.published(spark, path, "resultados") is None
    assert run(spark, tables(spark, [*rows, month(1, 2, 7, "L1")]), ["L1"], path) == {"L1": process.DONE}


def test_below_the_valid_share(spark, tmp_path):
    """The only supply overlaps an earlier period of another batch: it is excluded, the batch fails, and a retry ends alike."""
    path = str(tmp_path / "out")
    rows = [month(1, 1, 100, "P"), (1, D(2024, 1, 15), D(2024, 2, 15), 31, 100.0, "O")]
    for state in (process.PENDING, process.FAILED):
        assert run(spark, tables(spark, rows, states={"O": state}), ["O"], path) == {"O": process.FAILED}
        document = sinks.published(spark, path, "informes").first()
        assert (document.informe.suministros_excluidos, document.informe.umbral_cumplido) == (1, False)
        assert document.ml.top_10 == [] and document.ire.distribucion is None and document.iee.total_kwh_estimado == 0
        assert {r.chequeo for r in sinks.published(spark, path, "hallazgos").collect()} >= {"V5"}
        assert sinks.published(spark, path, "resultados").count() == 0
        assert sinks.published(spark, path, "conflictos").count() == 1


def two_regions():
    """Two regions of supplies with batches of their own, three months each, and one month billed together."""
    rows = []
    for i in range(24):
        region = "A" if i < 12 else "B"
        for m in (1, 2, 3):
            rows.append(month(i, m, 0 if i == 3 else 50 + i * m if (i, m) != (5, 3) else 900, f"{region}{m}"))
        rows.append(month(i, 4, 60 + i, "X"))
    return rows


NAMES = ["A1", "B1", "A2", "B2", "A3", "B3", "X"]


def test_levels(spark):
    rows = spark.createDataFrame([(r[0], r[5]) for r in two_regions()], "suministro long, lote string")
    assert process.levels(rows, NAMES) == [["A1", "B1"], ["A2", "B2"], ["A3", "B3"], ["X"]]
    assert process.levels(rows, ["X", "A1", "B3"]) == [["X"], ["A1", "B3"]]
    assert process.levels(rows, ["A3", "A1", "none"]) == [["A3", "none"], ["A1"]]
    assert process.levels(rows, []) == []


def rounded(x):
    if isinstance(x, dict):
        return {k: rounded(v) for k, v in x.items()}
    return [rounded(v) for v in x] if isinstance(x, list) else round(x, 6) if isinstance(x, float) else x


def rows_of(spark, path, name):
    """A published table's rows as text; sums may differ in their last digits."""
    return sorted(json.dumps(rounded(r.asDict(recursive=True)), default=str, sort_keys=True) for r in sinks.published(spark, path, name).collect())


def test_levels_give_what_batches_in_turn_give(spark, tmp_path, monkeypatch):
    given, published = tables(spark, two_regions()), []
    publish = sinks.publish
    monkeypatch.setattr(sinks, "publish", lambda s, p, names, t: published.append(names) or publish(s, p, names, t))
    together, alone = str(tmp_path / "together"), str(tmp_path / "alone")
    assert set(run(spark, given, NAMES, together).values()) == {process.DONE}
    assert published == [["A1", "B1"], ["A2", "B2"], ["A3", "B3"], ["X"]]
    for n in NAMES:
        assert run(spark, given, [n], alone) == {n: process.DONE}
    for name in ("resultados", "ire", "impactos", "anomalias", "vectores", "hallazgos", "exclusiones", "conflictos", "informes"):
        assert rows_of(spark, together, name) == rows_of(spark, alone, name), name
    assert sinks.published(spark, together, "anomalias").count() > 3
    prior = {json.loads(r.features)["prior_anomaly_count"] for r in sinks.published(spark, together, "vectores").filter("lote = 'X'").collect()}
    assert max(prior) > 0
    documents = {r.lote: r for r in sinks.published(spark, together, "informes").collect()}
    results = {n: sinks.published(spark, together, "resultados").filter(F.col("lote") == n).collect() for n in NAMES}
    for n, doc in documents.items():
        best = sorted(results[n], key=lambda r: (-r.ire, r.numero))[:10]
        assert [(x.numero, x.ire) for x in doc.ire.top_10] == [(r.numero, r.ire) for r in best]
        best = sorted(results[n], key=lambda r: (-r.ml_score, r.numero))[:10]
        assert [x.numero for x in doc.ml.top_10] == [r.numero for r in best] and doc.ml.distribucion.maximo == best[0].ml_score
        best = sorted((r for r in results[n] if r.iee), key=lambda r: (-r.iee, r.numero))[:5]
        assert [x.numero for x in doc.iee.top_5] == [r.numero for r in best]
        assert sum(doc.ire.conteo_por_nivel.values()) == doc.ml.suministros_scored == len(results[n]) == doc.ml.modelos[0].suministros_entrenados
        assert sum(doc.ire.anomalias_por_tipo.values()) == sinks.published(spark, together, "anomalias").filter(F.col("lote") == n).count()
        assert all(len(x.top_factores) <= 3 for x in doc.ire.top_10)


def test_categories_with_models_of_their_own(spark):
    """A category of a thousand supplies has its own model, the others share one; scores are on one scale within the batch."""
    from wattsift.operators import forest

    n = K.MODEL_MIN_PER_CATEGORY
    rows = spark.range(n + 60).select(F.col("id").alias("suministro"), F.lit("L").alias("lote"), F.when(F.col("id") < n, "Residencial").when(F.col("id") % 2 == 0, "Comercial").otherwise("Industrial").alias("categoria"))
    own = {"avg_consumption": F.when(F.col("suministro").isin(7, n + 5), 9e5).otherwise(F.col("suministro") % 11).cast("double"), "max_consumption": (F.col("suministro") % 7).cast("double")}
    rows = rows.select("*", *(own.get(c, F.lit(False) if c in forest.FLAGS else F.lit(None).cast("double")).alias(c) for c in forest.COLUMNS))
    scores = forest.ml_scores(rows, trees=30).cache()
    assert {r.alcance: r["count"] for r in scores.groupBy("alcance").count().collect()} == {"Residencial": n, "global": 60}
    best = {r.suministro for r in scores.orderBy(F.desc("ml_score")).limit(2).collect()}
    assert best == {7, n + 5}
    ends = scores.agg(F.min("ml_score"), F.max("ml_score")).first()
    assert (round(ends[0], 9), round(ends[1], 9)) == (0, 100)


def test_the_greatest_few_are_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.when(F.col("id") >= 0, "L").alias("lote"), F.col("id").alias("suministro"), F.col("id").cast("string").alias("numero"), (F.col("id") % 97).cast("double").alias("iee")).repartition(8)
    best = report.top_iee(rows)
    assert [(r.suministro, r.iee) for r in best.orderBy("puesto").collect()] == sorted(((i, float(i % 97)) for i in range(1000)), key=lambda x: (-x[1], str(x[0])))[:5]
    steps = [x for x in best._jdf.queryExecution().executedPlan().toString().splitlines() if "WindowGroupLimit" in x or "hashpartitioning(lote" in x]
    assert "Final" in steps[0] and "Exchange" in steps[1] and "Partial" in steps[2]


def test_the_models_own_anomaly(spark):
    """Critical by the model and no rule fires: one anomaly, counted and remembered; with a rule's hit there is none."""
    vectors = spark.createDataFrame([(1, "A", D(2024, 1, 1), 0.0), (1, "B", D(2024, 2, 1), 0.0), (2, "A", D(2024, 1, 1), 5.0)], "suministro long, lote string, inicio date, pct_change_prev_period double")
    blank = {c: "double" for c in ("peer_ratio", "percentile_peer", "deviation_from_baseline", "avg_consumption", "moving_avg_12m", "pct_change_yoy")} | {"zero_consumption_streak": "long", "kwh": "double"}
    vectors = vectors.withColumns({c: F.lit(0).cast(t) if c in ("kwh", "avg_consumption", "moving_avg_12m", "zero_consumption_streak") else F.lit(None).cast(t) for c, t in blank.items()} | {"is_cold_start": F.lit(False), "estado": F.lit("Activo"), "categoria": F.lit("Residencial")})
    ml = spark.createDataFrame([(1, "A", 95.0, "Crítico"), (1, "B", 1.0, "Normal"), (2, "A", 95.0, "Crítico")], "suministro long, lote string, ml_score double, clasificacion_ml string")
    scored = process.scored(vectors, ml).cache()
    assert {(r.suministro, r.lote): (r.prior_anomaly_count, r.n_anomalias) for r in scored.collect()} == {(1, "A"): (0, 1), (1, "B"): (1, 0), (2, "A"): (0, 1)}
    found = {(r.suministro, r.lote, r.regla, r.tipo) for r in process.anomalies(scored).collect()}
    assert found == {(1, "A", "ML", K.ML_ANOMALY[0]), (2, "A", "R3", K.RULES["R3"][0])}
