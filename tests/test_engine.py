"""Checks, duplicates, scores, the forest, imports, sinks, sources and whole batches."""

import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattsift import constants as K
from wattsift.functions import scalar
from wattsift.operators import duplicates, forest, imports, process, ranking, ranks, scoring, sinks, validation
from wattsift.sources import json_import, synthetic, tables, wide_csv

D = date


def check_row(spark, **change):
    base = {"suministro": 1, "lote": "L", "inicio": D(2024, 1, 1), "dias": 31, "kwh": 100.0, "lectura_anterior": 100.0, "lectura_actual": 200.0, "lectura_dias": 31, "prev_fin": None, "categoria_eliminada": False} | change
    schema = "suministro long, lote string, inicio date, dias int, kwh double, lectura_anterior double, lectura_actual double, lectura_dias int, prev_fin date, categoria_eliminada boolean"
    return [r.chequeo for r in validation.findings(spark.createDataFrame([tuple(base[c.split()[0]] for c in schema.split(", "))], schema)).collect()]


@pytest.mark.parametrize(("change", "expected"), [
    ({}, []), ({"lectura_dias": None, "lectura_actual": None, "lectura_anterior": None}, ["V1"]), ({"lectura_actual": 200.5}, []), ({"lectura_actual": 200.501}, ["V2"]), ({"lectura_dias": 30}, ["V3"]),
    ({"prev_fin": D(2023, 12, 31)}, []), ({"prev_fin": D(2023, 12, 30)}, ["V4"]), ({"prev_fin": D(2024, 1, 1)}, ["V5"]), ({"categoria_eliminada": True}, ["V6"]),
    ({"kwh": -1.0, "lectura_actual": 99.0}, ["V7"]), ({"kwh": -1.0, "lectura_actual": 99.0, "dias": 0, "lectura_dias": 0}, ["V7", "V7"]),
])
def test_checks(spark, change, expected):
    assert check_row(spark, **change) == expected


def test_valid_share(spark):
    rows = spark.createDataFrame([("L", i) for i in range(20)], "lote string, suministro long")
    found = spark.createDataFrame([(1, "L", "V2"), (2, "L", "V1")], "suministro long, lote string, chequeo string")
    r = validation.validation_report(rows, found).first()
    assert (r.excluidos, r.fraccion_valida, r.cumple) == (1, 0.95, True)


def periods(spark, rows):
    return spark.createDataFrame([(i, 1, a, b) for i, (a, b) in enumerate(rows)], "periodo long, suministro long, inicio date, fin date")


def test_overlaps(spark):
    year = periods(spark, [(D(2024, 1, 1), D(2024, 12, 31)), (D(2024, 3, 1), D(2024, 3, 31)), (D(2024, 6, 1), D(2024, 6, 30))])
    assert {(r.periodo, r.otro) for r in duplicates.overlap_pairs(year).collect()} == {(0, 1), (1, 0), (0, 2), (2, 0)}
    three = periods(spark, [(D(2024, 1, 1), D(2024, 2, 28)), (D(2024, 1, 15), D(2024, 3, 15)), (D(2024, 2, 1), D(2024, 3, 31))])
    assert duplicates.overlap_pairs(three).count() == 6


def test_near_duplicates(spark):
    rows = spark.createDataFrame([(1, 1, "t", D(2024, 1, 1), 5), (2, 1, "t", D(2024, 1, 2), 6), (3, 1, "t", D(2024, 1, 4), 5), (4, 1, "t", D(2024, 1, 8), 5)], "lectura long, suministro long, tipo string, fecha date, valor long")
    assert [(r.lectura, r.anterior, r.dias_entre) for r in duplicates.near_duplicate_readings(rows).collect()] == [(3, 1, 3)]


def test_drift(spark):
    batches = spark.createDataFrame([("A", 3), ("B", 0), ("C", 2)], "lote string, declarados long")
    rows = spark.createDataFrame([("A",), ("A",), ("B",), ("C",), ("C",)], "lote string")
    assert [(r.lote, r.diferencia) for r in duplicates.drift(batches, rows).collect()] == [("A", -1)]
    gate = {r.lote: (r.completo, r.motivo) for r in validation.completeness(batches, rows).collect()}
    assert gate["C"] == (True, None) and not gate["A"][0] and not gate["B"][0]
    with pytest.raises(process.IncompleteBatch):
        process.require_complete(validation.completeness(batches, rows), "A")


def scored_row(spark, **change):
    base = {"suministro": 1, "lote": "L", "categoria": "Industrial", "ml_score": 80.0, "deviation_from_baseline": 4.0, "zero_consumption_streak": 2, "prior_anomaly_count": 1, "pct_change_prev_period": 0.5, "pct_change_yoy": -0.1, "iee": 60.0, "iee_norm": 60.0, "avg_norm": 70.0, "avg_consumption": 100.0, "avg_percentil": 62.5} | change
    kinds = {"suministro": "long", "lote": "string", "categoria": "string", "zero_consumption_streak": "long", "prior_anomaly_count": "long"}
    schema = ", ".join(f"{k} {kinds.get(k, 'double')}" for k in base)
    return scoring.with_ire(spark.createDataFrame([tuple(base.values())], schema), reasons=True).first()


def test_index(spark):
    r = scored_row(spark)
    assert abs(r.ire_crudo - 5675 / 92) < 1e-9 and (r.ire, r.clasificacion, r.nivel, len(r.factores)) == (62, "Alto Riesgo", "Alto", 7)
    assert "percentil 62" in next(f.reason for f in r.factores if f.factor == "consumo_promedio")
    hidden = scored_row(spark, deviation_from_baseline=None, pct_change_prev_period=None, pct_change_yoy=None)
    assert {f.factor for f in r.factores} - {f.factor for f in hidden.factores} == {"historial_consumos", "variacion_porcentual"}


def test_scales(spark):
    rows = spark.createDataFrame([(i, "L", v, a) for i, (v, a) in enumerate([(0.0, 100.0), (50.0, 150.0), (150.0, 200.0), (None, 150.0)])], "suministro long, lote string, iee double, avg_consumption double")
    out = {r.suministro: (r.iee_norm, r.avg_norm) for r in scoring.batch_scales(rows).collect()}
    assert out == {0: (0.0, 0.0), 1: (0.0, 50.0), 2: (100.0, 100.0), 3: (0.0, 50.0)}
    tied = spark.createDataFrame([(0, "L", 5.0, 1.0), (1, "L", 5.0, 1.0)], "suministro long, lote string, iee double, avg_consumption double")
    assert {(r.iee_norm, r.avg_norm) for r in scoring.batch_scales(tied).collect()} == {(100.0, 50.0)}
    ranks = spark.createDataFrame([(i, "L", float(v)) for i, v in enumerate([100, 110, 120, 9000])], "suministro long, lote string, avg_consumption double")
    assert [round(r.avg_percentil, 2) for r in scoring.exposure_percentile(ranks).orderBy("suministro").collect()] == [0.0, 33.33, 66.67, 100.0]
    scores = spark.createDataFrame([("L", -0.5), ("L", -0.1), ("L", 0.3), ("M", 1.0), ("M", 1.0)], "lote string, x double")
    assert sorted(r.s for r in scoring.inverted_min_max(scores, "x", "s").collect()) == [0.0, 0.5, 0.5, 0.5, 1.0]


def test_bands(spark):
    rows = spark.createDataFrame([(v,) for v in (20, 21, 40, 41, 60, 61, 70, 71, 80, 81)], "v int").select(scalar.level(F.col("v")).alias("n"), scalar.risk_class(F.col("v")).alias("c")).collect()
    assert [r.n for r in rows] == ["Muy Bajo", "Bajo", "Bajo", "Medio", "Medio", "Alto", "Alto", "Alto", "Alto", "Crítico"]
    assert [r.c for r in rows] == ["Normal", "Atención", "Atención", "Alto Riesgo", "Alto Riesgo", "Alto Riesgo", "Alto Riesgo", "Crítico", "Crítico", "Crítico"]
    assert {k: round(v, 3) for k, v in K.normalised({"a": 0.5, "b": 0.3, "c": 0.2}, ("c",)).items()} == {"a": 0.625, "b": 0.375, "c": 0.0}


def test_factors_survive_json(spark):
    df = spark.createDataFrame([(1, '[{"factor":"a","contribution":1.5,"reason":"r"},{"reason":"x"}]'), (2, "broken"), (3, None)], "id long, observaciones string")
    out = {r.id: [f.factor for f in r.factores] for r in scoring.read_factors(df).collect()}
    assert out == {1: ["a"], 2: [], 3: []}


def test_forest_finds_the_outlier():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(size=(30, 4)), [[50.0] * 4]])
    first, again = (forest.score_samples(forest.fit_forest(rows, 100), rows) for _ in range(2))
    assert first.argmin() == 30 and (first == again).all() and ((-1 <= first) & (first <= 0)).all()
    assert len(forest.score_samples(forest.fit_forest(np.ones((5, 2)), 10), np.ones((5, 2)))) == 5
    assert forest.average_path(np.array([1, 2]))[1] == 1.0


def test_imputation(spark):
    df = spark.createDataFrame([(i, "L", "global", v) for i, v in enumerate([10.0, None, 30.0])], "suministro long, lote string, alcance string, kwh double")
    full = df.select("suministro", "lote", "alcance", *(F.col("kwh").alias(c) if c == "avg_consumption" else F.lit(None).cast("double").alias(c) for c in forest.COLUMNS))
    out = {r.suministro: (r.avg_consumption, r.peer_ratio) for r in forest.imputed(full).collect()}
    assert out == {0: (10.0, 0.0), 1: (20.0, 0.0), 2: (30.0, 0.0)}


def test_forest_does_not_depend_on_partitions(spark):
    own = {"avg_consumption": (F.col("id") % 7).cast("double"), "max_consumption": F.when(F.col("id") == 5, 1e6).otherwise(1.0)}
    rows = spark.range(60).select(F.col("id").alias("suministro"), F.lit("L").alias("lote"), F.lit("C").alias("categoria"), *(own.get(c, F.lit(False) if c in forest.FLAGS else F.lit(None).cast("double")).alias(c) for c in forest.COLUMNS))
    run = lambda df: {r.suministro: round(r.ml_score, 9) for r in forest.ml_scores(df, trees=20).collect()}
    assert run(rows.repartition(1)) == run(rows.repartition(5))


def test_merge(spark):
    stored = spark.createDataFrame([("a", "x", False), ("b", "x", True), ("c", "x", False)], "k string, v string, eliminado boolean")
    incoming = spark.createDataFrame([("a", "x", 0, []), ("a", "y", 1, []), ("a", "y", 2, []), ("b", "x", 3, []), ("d", "z", 4, []), ("d", "z", 5, []), ("c", "w", 6, ["no"])], "k string, v string, posicion long, motivos array<string>")
    out = imports.merge_outcomes(stored, incoming, "k", ["v"])
    assert {r.posicion: r.outcome for r in out.collect()} == {0: "unchanged", 1: "updated", 2: "unchanged", 3: "restored", 4: "created", 5: "unchanged", 6: "rejected"}
    assert imports.import_counts(out).first().asDict() == {"created": 1, "updated": 1, "unchanged": 3, "restored": 1, "rejected": 1}
    assert {r.k: (r.v, r.eliminado) for r in imports.merged(stored, out, "k", ["v"]).collect()} == {"a": ("y", False), "b": ("x", False), "c": ("x", False), "d": ("z", False)}


def test_batches_are_overwritten_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_batches(spark.createDataFrame([(1, "A"), (2, "B")], "v long, lote string"), path, "lote")
    for _ in range(2):
        sinks.write_batches(spark.createDataFrame([(9, "A")], "v long, lote string"), path, "lote")
    assert sorted((r.v, r.lote) for r in spark.read.parquet(path).collect()) == [(2, "B"), (9, "A")]
    assert json.loads(sinks.manifest({"b": 1, "a": [2]})) == {"a": [2], "b": 1} and sinks.manifest({}).endswith("\n")


def test_pages_are_checked(spark):
    with pytest.raises(ValueError):
        ranking.page(spark.range(3), [F.col("id")], 201)
    assert [r.id for r in ranking.page(spark.range(5), [F.desc("id")], 2, 1).collect()] == [3, 2]


def test_json_records_fail_alone(spark):
    lines = ['{"codigo_lote":"A","cantidad_registros":3}', '{"codigo_lote":"B","nombre":null}', '{"otro":1}', "not json"]
    out = json_import.parse(spark.createDataFrame(list(enumerate(lines)), "posicion long, registro string"), "lotes").orderBy("posicion").collect()
    assert [r.motivo for r in out] == [None, None, "campos desconocidos: otro", "registro ilegible"]
    assert [(r.nombre_present, r.cantidad_registros_present) for r in out[:2]] == [(False, True), (True, False)]


def test_wide_csv(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_bytes(";LD_DISTRITO;SUMINISTRO;MEDIDOR;TITULAR;CUIT;LOCALIDAD_RUTA;BARRIO_RUTA;DMCLATITUD;DMCLONGITUD;C_P2024B1;C_P2024B2\r\n1;x;S1;M1;Núñez;;Norte;B  San Martin;-34,5;;500;\r\n2;x;S2;M2;Paz;20-1;Sur;;;;;0\r\n".encode("iso-8859-1"))
    rows = wide_csv.meters(wide_csv.read(spark, str(path)))
    first = rows.orderBy("numero").first()
    assert (first.titular, first.barrio, first.latitud, first.longitud) == ("Núñez", "San Martin", -34.5, None)
    used = wide_csv.consumption(rows).orderBy("numero").collect()
    assert [(r.numero, r.lote, r.kwh, r.dias) for r in used] == [("S1", "REAL-2024-B1", 500.0, 60), ("S2", "REAL-2024-B2", 0.0, 61)]
    assert {r.numero_cliente for r in wide_csv.entities(rows)["clientes"].collect()} == {"S-S1", "20-1"}


def test_reasons(spark):
    df = spark.createDataFrame([("1.5",), ("-1",), ("abc",), ("1.2345",), ("1e12",), (None,)], "x string")
    out = [r[0] for r in df.select(scalar.numeric_reason(F.col("x"), "kwh")).collect()]
    assert out[0] is None and all(out[1:])


def test_synthetic_data_is_the_same_under_any_partitioning(spark):
    s = synthetic.supplies(spark, 40, 24)
    a, b = (synthetic.consumption(s.repartition(n), 24).orderBy("suministro", "inicio").collect() for n in (1, 3))
    assert a == b and {r.anomalia for r in s.collect()} >= set(synthetic.KINDS) and all(r.kwh >= 0 for r in a)


def test_process_batches(spark, sf_dir, tmp_path):
    rows = tables.consumption(spark, sf_dir, sparse=True)
    names = sorted(r.lote for r in rows.select("lote").distinct().collect())[10:12]
    vectors = process.vectors(rows, tables.supplies(spark, sf_dir)).filter(F.col("lote").isin(names)).persist()
    path = str(tmp_path / "out")
    states = process.process_batches(vectors, names, path, {n: process.PENDING for n in names}, {names[1]: False}, trees=20)
    assert states == {names[0]: process.DONE, names[1]: process.FAILED}
    results = sinks.published(spark, path, "resultados")
    assert results.count() == vectors.count() == sinks.published(spark, path, "vectores").count()
    with pytest.raises(process.BatchConflict):
        process.process_batches(vectors, names[:1], path, states)
    with pytest.raises(process.UnknownBatch):
        process.process_batches(vectors, ["?"], path, states)
    again = process.process_batches(vectors, names[1:], path, states, trees=20)
    assert again[names[1]] == process.DONE
    assert sinks.published(spark, path, "resultados").count() == results.count() == vectors.count()  # who read before still can


def test_the_gate_of_a_run(spark, tmp_path):
    batches = spark.createDataFrame([("A", 3), ("B", 2)], "lote string, declarados long")
    rows = spark.createDataFrame([("A",), ("B",), ("B",)], "lote string")
    gate, none = validation.completeness(batches, rows), spark.createDataFrame([], "suministro long, lote string")
    run = lambda b, **more: process.process_batches(none, [b], str(tmp_path / "out"), {"A": process.PENDING, "B": process.PENDING, "C": process.PENDING}, gate=gate, **more)
    with pytest.raises(process.IncompleteBatch):
        run("A")
    with pytest.raises(process.UnknownBatch):
        run("C")
    with pytest.raises(process.BatchConflict):
        run("B", recount=spark.createDataFrame([("B", 3)], "lote string, activos long"))


def test_publication_is_of_whole_runs(spark, tmp_path):
    path, shape = str(tmp_path / "p"), "v long, lote string"
    assert sinks.published(spark, path, "a") is None
    one = lambda *vs: spark.createDataFrame([(v, "L") for v in vs], shape)
    sinks.publish(spark, path, "L", {"a": one(1, 2), "b": one(3)})
    sinks.publish(spark, path, "M", {"a": one(7), "b": one()})
    before = sinks.published(spark, path, "a")
    one(9).write.parquet(f"{path}/a/corrida=99999999999999999999-x")  # a run that failed before its publication
    assert sorted(r.v for r in sinks.published(spark, path, "a").collect()) == [1, 2, 7]
    sinks.publish(spark, path, "L", {"a": one(), "b": one(4)})  # a table without rows replaces one with rows
    assert [r.v for r in sinks.published(spark, path, "a").collect()] == [7] and [r.v for r in sinks.published(spark, path, "b").collect()] == [4]
    assert before.count() == 3


def test_conflicts_reject_one_record(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id long, codigo string")
    new = spark.createDataFrame([(3, "x", 0), (2, "z", 1), (4, "w", 2), (5, "w", 3)], "id long, codigo string, posicion long")
    kept, rejected = sinks.upsert_rejecting(old, new, "id", ["codigo"], "posicion")
    assert sorted((r.id, r.codigo) for r in kept.collect()) == [(1, "x"), (2, "z"), (4, "w")]
    assert sorted((r.id, r.codigo) for r in rejected.collect()) == [(3, "x"), (5, "w")]


def clean(spark, rows, excluded=()):
    consumption = spark.createDataFrame(rows, "suministro long, inicio date, fin date, dias int, kwh double, lote string")
    supplies = spark.createDataFrame([(i, f"S{i}", "Activo", "Residencial", "Norte", D(2020, 1, 1)) for i in (1, 2)], "suministro long, numero string, estado string, categoria string, localidad string, fecha_alta date")
    gone = spark.createDataFrame(list(excluded), "lote string, suministro long")
    found = process.cleaned_vectors(consumption, supplies, gone, duplicates.conflicted_periods(consumption))
    return {(r.suministro, r.lote): r for r in found.collect()}


def test_conflicts_and_exclusions_in_vectors(spark):
    """A conflicted period with consumption leaves the history but still breaks the streak of zeros."""
    month = lambda s, m, kwh, last=28: (s, D(2024, m, 1), D(2024, m, last), last, kwh, f"L{m}")
    rows = [month(1, 1, 5.0), month(1, 2, 0.0), month(1, 4, 0.0), (1, D(2024, 3, 1), D(2024, 3, 20), 20, 9.0, "L3"), (1, D(2024, 3, 10), D(2024, 3, 28), 19, 8.0, "X3"), month(2, 4, 7.0), month(2, 5, 7.0)]
    found = clean(spark, rows, [("L5", 2)])
    assert set(found) == {(1, "L1"), (1, "L2"), (1, "L4"), (2, "L4")}
    assert (found[1, "L4"].zero_consumption_streak, found[1, "L4"].max_consumption, found[1, "L4"].has_conflicted_periods) == (1, 5.0, True)
    assert not found[2, "L4"].has_conflicted_periods


def test_order_statistics(spark):
    g = np.random.default_rng(4)
    values = {"a": [*g.integers(0, 9, 60).astype(float).tolist(), None], "b": [*g.normal(size=60).tolist(), None]}
    rows = spark.createDataFrame([("k" if i % 3 else "m", values["a"][i], values["b"][i]) for i in range(61)], "g string, a double, b double")
    found = {r.g: r for r in ranks.order_statistics(rows, ["g"], ["a", "b"], {"p1": 0.03, "p2": 0.5, "p3": 1.0}).collect()}
    for key in ("k", "m"):
        for c in "ab":
            own = [v for i, v in enumerate(values[c]) if v is not None and (i % 3 > 0) == (key == "k")]
            assert [found[key][f"{c}_p{i}"] for i in (1, 2, 3)] == pytest.approx(np.quantile(own, [0.03, 0.5, 1.0]).tolist())


def test_imports_of_readings_and_bills(spark):
    supplies = spark.createDataFrame([("S1", 1), ("S2", 2)], "numero_suministro string, id long")
    stored = spark.createDataFrame([(1, "2024-01-31", "0", "10", "31", False), (2, "2024-01-31", "0", "1", "31", True)], "suministro long, fecha_lectura string, lectura_anterior string, lectura_actual string, dias_facturados string, eliminado boolean")
    records = [("S1", "2024-01-31", "0", "10", "31"), ("S1", "2024-01-31", "0", "11", "31"), ("S2", "2024-01-31", "0", "1", "31"), ("S9", "2024-01-31", "0", "1", "31"), ("S1", "2024-02-30", "0", "1", "31"), (" ", "2024-01-31", "0", "1", "31"), ("S1", "2024-02-29", "x", "-1", "0")]
    incoming = spark.createDataFrame([(*r, i) for i, r in enumerate(records)], "numero_suministro string, fecha_lectura string, lectura_anterior string, lectura_actual string, dias_facturados string, posicion long")
    out = imports.import_readings(stored, incoming, supplies).orderBy("posicion").collect()
    assert [r.outcome for r in out] == ["unchanged", "updated", "restored", *["rejected"] * 4]
    batches = spark.createDataFrame([("L", 7)], "codigo_lote string, id long")
    readings = spark.createDataFrame([(1, "2024-01-31", 70), (2, "2024-01-31", 71)], "suministro long, fecha_lectura string, id long")
    held = spark.createDataFrame([(1, "2024-01-01", "2024-01-31", 7, 70, "31", "62", "2.000", False)], "suministro long, fecha_inicio string, fecha_fin string, lote long, lectura long, dias_facturados string, kwh string, consumo_promedio_diario string, eliminado boolean")
    bill = lambda s, kwh, fecha, present=True, lote="L", mean=None, has_mean=False: (s, lote, "2024-01-01", "2024-01-31", "31", kwh, mean, has_mean, fecha, present)
    rows = [bill("S1", "62", None, False), bill("S1", "93", None, False), bill("S1", "93", None), bill("S1", "93", "2024-01-31"), bill("S1", "93", "2024-02-01"), bill("S2", "31", "2024-01-31"), bill("S2", "31", "2024-01-31", mean="9.000", has_mean=True), bill("S1", "1", None, lote="?"), bill("S1", "1", "soon")]
    incoming = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "numero_suministro string, codigo_lote string, fecha_inicio string, fecha_fin string, dias_facturados string, kwh string, consumo_promedio_diario string, consumo_promedio_diario_present boolean, fecha_lectura string, fecha_lectura_present boolean, posicion long")
    out = imports.import_consumption(held, incoming, supplies, batches, readings).orderBy("posicion").collect()
    assert [r.outcome for r in out] == ["unchanged", "updated", "updated", "updated", "rejected", "created", "updated", "rejected", "rejected"]
    assert [(r.lectura, r.consumo_promedio_diario) for r in out[:4]] == [(70, "2.000"), (70, "3.000"), (None, "3.000"), (70, "3.000")]
    assert out[6].consumo_promedio_diario == "9.000"


def test_imports_of_clients(spark):
    shape = "numero_cliente string, nombre string, estado string, documento string, localidad string, barrio string, direccion struct<calle:string>"
    stored = spark.createDataFrame([("a", "Ana", "Activo", None, None, None, ("x",), False)], shape + ", eliminado boolean")
    rows = [(" a ", "Ana", "Activo", None, None, None, ("x",)), ("b", "Bo", "?", None, None, None, None), ("c", "Cy", "Activo", None, None, None, ("y" * 9000,)), ("d", "Di", "Activo", None, None, None, ("y" * 8000,)), (None, "E", "Activo", None, None, None, None)]
    incoming = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], shape + ", posicion long")
    assert [r.outcome for r in imports.import_clients(stored, incoming).orderBy("posicion").collect()] == ["unchanged", "rejected", "rejected", "created", "rejected"]


def test_neighbourhoods_and_labels(spark):
    shape = "localidad string, barrio string, ire_maximo int, primero int"
    rows = spark.createDataFrame([("Sur", "B", 5, 3), (None, "A", 9, 2), ("Sur", "A", 9, 1)], shape)
    assert [(r.localidad, r.barrio) for r in ranking.in_risk_order(rows).collect()] == [(None, "A"), ("Sur", "A"), ("Sur", "B")]
    assert ranking.of_locality(rows, "Sin localidad").count() == 1 and ranking.of_locality(rows, "Sur").count() == 2
    assert [r.localidad for r in ranking.localities_seen(rows, "primero").collect()] == ["Sur", "Sin localidad"]
    factors = spark.createDataFrame([([("score_ia", 1.0), ("?", 2.0)],)], "factores array<struct<factor:string,contribution:double>>")
    assert [f.factor for f in ranking.labelled_factors(factors).first().factores] == ["Score de IA (aproximación)", "?"]


def test_top_scores(spark):
    rows = spark.createDataFrame([("L", "global", f"S{i % 7}", float(i // 2)) for i in range(30)], "lote string, alcance string, numero string, ml_score double")
    found = [(r.ml_score, r.numero) for r in forest.top_scores(rows, 5).orderBy("puesto").collect()]
    assert found == sorted(((float(i // 2), f"S{i % 7}") for i in range(30)), key=lambda x: (-x[0], x[1]))[:5]


def test_categories_are_inserted_once(spark):
    stored = spark.createDataFrame([("Comercial",), ("Otra",)], "nombre string")
    again = tables.insert_missing_categories(tables.insert_missing_categories(stored))
    assert sorted(r.nombre for r in again.collect()) == sorted({*tables.CATEGORIES, "Otra"})
