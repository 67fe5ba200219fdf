"""Field rules of imports: every limit at and beyond its end, and what absent, null and blank mean."""

import json

import pytest
from pyspark.sql import functions as F

from wattsift.operators import constraints, imports
from wattsift.sources import json_import

CLIENT = {"numero_cliente": "a", "nombre": "Ana", "estado": "Activo", "documento": None, "localidad": None, "barrio": None, "direccion": None}
SUPPLY = {"numero_suministro": "s", "numero_cliente": "a", "categoria_tarifaria": "T", "estado": "Activo", "fecha_alta": "2020-01-31", "localidad": None, "barrio": None, "medidor": None, "latitud": None, "longitud": None}


def outcomes(spark, base, changes, run):
    """Each change as the only record of a key of its own."""
    key = next(iter(base))
    rows = [{**base, **c, "posicion": i} for i, c in enumerate(changes)]
    shape = ", ".join(f"{c} string" for c in base) + ", posicion long"
    records = spark.createDataFrame([tuple(r.values()) for r in rows], shape)
    if not any(key in c for c in changes):
        records = records.withColumn(key, F.concat(F.col(key), F.col("posicion").cast("string")))
    return {r.posicion: r for r in run(records).collect()}


def clients(spark):
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in CLIENT) + ", eliminado boolean")
    return lambda records: imports.import_clients(none, records)


def supplies(spark):
    shape = "numero_suministro string, cliente long, categoria long, estado string, fecha_alta string, localidad string, barrio string, medidor string, latitud string, longitud string, eliminado boolean"
    none, known, categories = spark.createDataFrame([], shape), spark.createDataFrame([("a", 1)], "numero_cliente string, id long"), spark.createDataFrame([("T", 2)], "categoria_tarifaria string, id long")
    return lambda records: imports.import_supplies(none, records, known, categories)


@pytest.mark.parametrize("field, most", [("numero_cliente", 30), ("nombre", 150), ("documento", 20), ("localidad", 100), ("barrio", 100)])
def test_client_lengths(spark, field, most):
    found = outcomes(spark, CLIENT, [{field: "é" * most}, {field: "é" * (most + 1)}, {field: " " + "é" * (most - 1) + "z "}], clients(spark))
    measured_stripped = field in ("numero_cliente", "nombre")
    assert [found[i].outcome for i in range(2)] == ["created", "rejected"]
    assert found[2].outcome == ("created" if measured_stripped else "rejected")


def test_client_states(spark):
    found = outcomes(spark, CLIENT, [{"estado": e} for e in (None, "", " ", "Inactivo", " Activo", "activo", "Baja")], clients(spark))
    assert [found[i].outcome for i in range(7)] == ["created", "rejected", "rejected", "created", "rejected", "rejected", "rejected"]
    assert found[0].estado == "Activo"


def test_missing_names(spark):
    found = outcomes(spark, CLIENT, [{"nombre": n} for n in (None, "", " \t ", " Ana ")], clients(spark))
    assert [found[i].outcome for i in range(4)] == ["rejected"] * 3 + ["created"] and found[3].nombre == "Ana"


ADDRESSES = [
    {"calle": "x"}, {"calle": "é" * 1363}, {"calle": "é" * 1364}, {"calle": "😀" * 681}, {"calle": "😀" * 682}, {"a": [1, 2.5, True, None, {"b": "c, d: e", "q": 'say "a, b"'}], "z": "\\ \n \t / \u007f"},
    {"n": list(range(1600))}, {"n": list(range(1700))}, {}, {"calle": "x" * 8179}, {"calle": "x" * 8180}, {"calle": '"' * 4089}, {"calle": '"' * 4090},
]


def test_address_bytes(spark):
    found = outcomes(spark, CLIENT, [{"direccion": json.dumps(a, ensure_ascii=i % 2 == 0, separators=(",", ":"))} for i, a in enumerate(ADDRESSES)], clients(spark))
    assert [found[i].outcome for i in range(len(ADDRESSES))] == ["rejected" if len(json.dumps(a).encode()) > 8192 else "created" for a in ADDRESSES]
    sizes = spark.createDataFrame([(json.dumps(a, ensure_ascii=False, indent=1),) for a in ADDRESSES], "x string").select(constraints.json_bytes(constraints.json_text(F.col("x")), 10**6).alias("n")).collect()
    assert [r.n for r in sizes] == [len(json.dumps(a).encode()) for a in ADDRESSES]


def test_addresses_are_objects_compared_by_content(spark):
    found = outcomes(spark, CLIENT, [{"direccion": a} for a in ("[1]", "7", "{", '{"a":1,"a":2}', "null")], clients(spark))
    assert {r.outcome for r in found.values()} == {"rejected"}
    stored = spark.createDataFrame([(*{**CLIENT, "direccion": '{"b": 1, "a": [2]}'}.values(), False)], ", ".join(f"{c} string" for c in CLIENT) + ", eliminado boolean")
    same = outcomes(spark, CLIENT, [{"numero_cliente": "a", "direccion": '{"a":[2],"b":1}'}, {"numero_cliente": "a", "direccion": '{"a":[2],"b":2}'}], lambda r: imports.import_clients(stored, r))
    assert [same[i].outcome for i in range(2)] == ["unchanged", "updated"]


def test_nothing_may_follow_an_address(spark):
    texts = ['{"a":1},"w":2', '{"a":1}, "z":{}', '{"a":1},"b":2', '{"a":1},{"b":2}', '{"a":1}]', '{"a":1}},{"b":2', '{"a":1} x', "", ' {"a":1} ']
    found = outcomes(spark, CLIENT, [{"direccion": a} for a in texts], clients(spark))
    assert [found[i].outcome for i in range(len(texts))] == ["rejected"] * 8 + ["created"] and found[8].direccion == '{"a":1}'


@pytest.mark.parametrize("field, most", [("numero_suministro", 30), ("localidad", 100), ("barrio", 100), ("estado", 15), ("medidor", 20)])
def test_supply_lengths(spark, field, most):
    found = outcomes(spark, SUPPLY, [{field: "x" * most}, {field: "x" * (most + 1)}, {field: f" {'x' * (most - 1)}y "}], supplies(spark))
    assert [found[i].outcome for i in range(3)] == ["created", "rejected", "rejected" if field in ("localidad", "barrio") else "created"]


def test_supply_states_and_places(spark):
    given = [{"estado": None}, {"estado": "  "}, {"estado": " Suspendido "}, {"latitud": "abc"}, {"latitud": "90"}, {"latitud": "90.01"}, {"longitud": "-180"}, {"longitud": "-180.5"}, {"latitud": "NaN"}, {"fecha_alta": " 2020-02-29 "}, {"fecha_alta": "2021-02-29"}, {"fecha_alta": None}, {"numero_cliente": "?"}, {"numero_cliente": " a "}]
    found = outcomes(spark, SUPPLY, given, supplies(spark))
    assert [found[i].outcome == "created" for i in range(len(given))] == [True, False, True, False, True, False, True, False, False, True, False, False, False, True]
    assert (found[0].estado, found[2].estado, found[9].fecha_alta) == ("Activo", "Suspendido", "2020-02-29")


def test_all_reasons_are_given(spark):
    row = spark.createDataFrame([("", "n" * 151, "?", "9" * 21, None, None, "[]")], ", ".join(f"{c} string" for c in CLIENT))
    found = row.select(imports.reasons(*constraints.all_reasons(constraints.CLIENT)).alias("r")).first().r
    assert [x.split(":")[0] for x in found] == ["numero_cliente", "nombre", "estado", "documento", "direccion"]


def test_from_json_text_to_outcomes(spark):
    """Records as they come, an address as nested JSON and numbers as numbers, through parsing into the merge."""
    lines = ['{"numero_cliente":"c1","nombre":"Ana","direccion":{"calle":"x","n":1}}', '{"numero_cliente":"c2","nombre":null}', '{"numero_cliente":"c3","nombre":"B","estado":"?"}', '{"numero_cliente":"c4","otro":1}']
    good, bad = json_import.split(json_import.parse(spark.createDataFrame(list(enumerate(lines)), "posicion long, registro string"), "clientes"))
    assert bad.count() == 1
    assert {r.numero_cliente: r.outcome for r in clients(spark)(good).collect()} == {"c1": "created", "c2": "rejected", "c3": "rejected"}


def test_bills_with_bad_means(spark):
    shape = "suministro long, fecha_inicio string, fecha_fin string, lote long, lectura long, dias_facturados string, kwh string, consumo_promedio_diario string, eliminado boolean"
    records = [("1", "abc"), ("1", "-1"), ("1", "1.2345"), ("1", "1.5"), ("x", "1"), ("NaN", "1"), ("1e3", None), ("1000000000", "1")]
    rows = [("S", "L", f"2024-0{i + 1}-01", f"2024-0{i + 1}-28", "28", kwh, mean, True, None, False, i) for i, (kwh, mean) in enumerate(records)]
    incoming = spark.createDataFrame(rows, "numero_suministro string, codigo_lote string, fecha_inicio string, fecha_fin string, dias_facturados string, kwh string, consumo_promedio_diario string, consumo_promedio_diario_present boolean, fecha_lectura string, fecha_lectura_present boolean, posicion long")
    found = imports.import_consumption(spark.createDataFrame([], shape), incoming, spark.createDataFrame([("S", 1)], "numero_suministro string, id long"), spark.createDataFrame([("L", 1)], "codigo_lote string, id long"), spark.createDataFrame([], "suministro long, fecha_lectura string, id long"))
    assert {r.posicion: r.outcome == "created" for r in found.collect()} == dict(enumerate([False, False, False, True, False, False, True, False]))
