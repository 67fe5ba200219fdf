"""Upserts by key with ids, published rows that stay, the sweep for conflicts, and factors read entry by entry."""

import random
from datetime import date as D
from datetime import timedelta

from pyspark.sql import functions as F

from wattsift.operators import duplicates, scoring, sinks


def test_upsert_keeps_one_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, at long")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1), (3, "z", 1)], "k long, v string, at long")
    assert sorted((r.k, r.v) for r in sinks.upsert(old, new, ["k"], "at").collect()) == [(1, "a"), (2, "y"), (3, "z")]
    assert sinks.upsert(old, new, ["k"]).count() == 3


def test_numbers_are_dense_over_many_tasks(spark):
    rows = spark.range(1000).select("id").repartition(13).filter("id % 3 = 0")
    found = sinks.numbered(rows, "n", 7).collect()
    assert sorted(r.n for r in found) == list(range(7, 7 + 334)) and len({r.id for r in found}) == 334
    assert sinks.numbered(rows.limit(0), "n").count() == 0


def test_results_are_upserted_with_ids(spark):
    """A second run of a batch: results met again keep their ids, one more gets the next, one not given again stays, and vectors follow."""
    keys = ["suministro", "lote"]
    none = spark.createDataFrame([], "suministro long, lote string, ire int, id long")
    first = sinks.upsert_with_ids(none, spark.createDataFrame([(s, "L", 10 * s) for s in (1, 2, 3)], "suministro long, lote string, ire int"), keys)
    ids = {r.suministro: r.id for r in first.collect()}
    assert sorted(ids.values()) == [1, 2, 3]
    stored = spark.createDataFrame([(r.suministro, r.lote, r.ire, r.id) for r in first.collect()], none.schema)
    second = {r.suministro: (r.ire, r.id) for r in sinks.upsert_with_ids(stored, spark.createDataFrame([(2, "L", 99), (4, "L", 40)], "suministro long, lote string, ire int"), keys).collect()}
    assert second == {1: (10, ids[1]), 2: (99, ids[2]), 3: (30, ids[3]), 4: (40, 4)}
    vectors = spark.createDataFrame([(1, "L", None), (5, "L", None), (2, "L", 77)], "suministro long, lote string, resultado long")
    filled = {r.suministro: r.resultado for r in sinks.backfill(vectors, stored, keys, "resultado").collect()}
    assert filled == {1: ids[1], 5: None, 2: ids[2]}


def test_published_rows_of_earlier_runs_stay(spark, tmp_path):
    path, rows = str(tmp_path / "p"), lambda *x: spark.createDataFrame(list(x), "suministro long, lote string, ire int")
    assert sinks.published_by_key(spark, path, "r", ["suministro", "lote"]) is None
    sinks.publish(spark, path, ["L", "M"], {"r": rows((1, "L", 10), (2, "L", 20), (1, "M", 5))})
    sinks.publish(spark, path, "L", {"r": rows((2, "L", 21))})
    rows((9, "L", 9)).write.parquet(f"{path}/r/corrida=99999999999999999999-x")  # never published
    assert sorted((r.suministro, r.lote, r.ire) for r in sinks.published_by_key(spark, path, "r", ["suministro", "lote"]).collect()) == [(1, "L", 10), (1, "M", 5), (2, "L", 21)]
    assert sorted((r.suministro, r.lote, r.ire) for r in sinks.published(spark, path, "r").collect()) == [(1, "M", 5), (2, "L", 21)]


def test_the_sweep_marks_what_pairs_mark(spark):
    r = random.Random(2)
    day = lambda k: D(2024, 1, 1) + timedelta(days=k)
    rows = []
    for s in range(60):
        for _ in range(r.randint(1, 7)):
            a = r.randint(0, 60)
            rows.append((s, day(a), day(a + r.randint(-2, 12)), r.choice(["A", "B", "C"])))
    df = spark.createDataFrame(rows, "suministro long, inicio date, fin date, lote string")
    found = {(x.suministro, x.inicio, x.lote) for x in duplicates.conflicted_periods(df).collect()}
    want = {(a[0], a[1], a[3]) for a in rows for b in rows if a[0] == b[0] and (a[1], a[3]) != (b[1], b[3]) and a[1] <= a[2] and b[1] <= b[2] and a[1] <= b[2] and b[1] <= a[2]}
    assert found == want and 0 < len(want) < len({(a[0], a[1], a[3]) for a in rows})


def test_the_sweep_is_linear_for_nested_periods(spark):
    """Ten thousand periods of one supply within each other: 50 million pairs, one window."""
    rows = spark.range(10_000).select(F.lit(1).alias("suministro"), F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("inicio"), F.date_sub(F.lit("2060-01-01").cast("date"), F.col("id").cast("int")).alias("fin"), F.lit("L").alias("lote"))
    marked = duplicates.conflicted_periods(rows)
    assert marked.count() == 10_000 and "Join" not in marked._jdf.queryExecution().executedPlan().toString()


def test_factors_are_read_entry_by_entry(spark):
    good = '{"factor":"a","contribution":1.5,"reason":"r"}'
    texts = [f"[{good}]", f"[1, {good}, null, [2]]", f'[{good}, {{"factor":"b","contribution":2}}]', f'[{good}, {{"factor":"b","contribution":2,"reason":null}}]', good, f"[{good}", "", None, "[]", '[{"factor":"b","contribution":"x","reason":"r"}]', f'[{{"extra":[1],"reason":"q","factor":"c","contribution":3}}, {good}]', f"[{good}]]", f"[{good}] x", f"[{good}]}}", f" [{good}]\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, observaciones string")
    found = {r.id: [(f.factor, f.contribution, f.reason) for f in r.factores] for r in scoring.read_factors(rows).collect()}
    a = ("a", 1.5, "r")
    assert [found[i] for i in range(len(texts))] == [[a], [a], [a], [a, ("b", 2.0, None)], [], [], [], [], [], [], [("c", 3.0, "q"), a], [], [], [], [a]]
