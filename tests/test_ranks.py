"""Distributed ranks: groups that span many ranges give what a sort of the whole group gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattsift.operators import cohort, forest, ranks, scoring


@pytest.fixture(scope="module")
def one_group(spark):
    """One batch and category of 4,000 supplies, a third of them with equal values."""
    r = random.Random(1)
    rows = [(i, "L1", "Residencial", "Norte" if i % 500 else None, 0.0 if i % 3 == 0 else float(r.randint(1, 400)) / 8) for i in range(4000)]
    rows += [(9000 + i, "L1", "Comercial", "Sur", float(i)) for i in range(2)] + [(9100 + i, "L2", "Residencial", "Sur", 5.0) for i in range(4)]
    return rows, spark.createDataFrame(rows, "suministro long, lote string, categoria string, localidad string, kwh double").repartition(7)


def test_group_spans_ranges(spark, one_group):
    rows, df = one_group
    counted = ranks.running_counts(ranks.value_counts(df, ["lote"], "kwh"), ["lote"], "kwh", ranges=16)
    values = {}
    for _, lote, _, _, kwh in rows:
        values.setdefault(lote, []).append(kwh)
    want = sorted((lote, v, x.count(v), sum(y < v for y in x), len(x)) for lote, x in values.items() for v in set(x))
    assert sorted(tuple(r) for r in counted.select("lote", "kwh", "k", "below", "n").collect()) == want
    placed = spark.read.parquet(*counted.inputFiles())
    spread = placed.filter("lote = 'L1'").agg(F.countDistinct("__range"), F.max("k")).first()
    assert spread[0] > 8


def test_nulls_are_a_value_and_a_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), ("a", 2.0), ("a", 2.0), ("a", None)], "g string, v double")
    found = ranks.running_counts(ranks.value_counts(df, ["g"], "v"), ["g"], "v", ranges=3).collect()
    assert {(r.g, r.v, r.k, r.below, r.n) for r in found} == {(None, None, 1, 0, 2), (None, 1.0, 1, 1, 2), ("a", None, 1, 0, 3), ("a", 2.0, 2, 1, 3)}
    assert ranks.running_counts(ranks.value_counts(df.limit(0), ["g"], "v"), ["g"], "v").count() == 0


def brute_cohort(rows):
    out = {}
    for s, lote, cat, loc, kwh in rows:
        fine = sorted(k for _, l, c, o, k in rows if (l, c, o) == (lote, cat, loc))
        coarse = sorted(k for _, l, c, _, k in rows if (l, c) == (lote, cat))
        peers = fine if len(fine) >= 10 else coarse
        ratio = kwh / m if (m := float(np.median(peers))) else None
        share = flag = None
        if len(peers) >= 3:
            share = sum(k <= kwh for k in peers) / len(peers)
            others = list(peers)
            others.remove(kwh)
            q1, q3 = np.percentile(others, [25, 75])
            flag = bool(kwh < q1 - 1.5 * (q3 - q1) or kwh > q3 + 1.5 * (q3 - q1))
        out[s] = (ratio, share, flag, len(peers))
    return out


def test_cohort_over_many_ranges(one_group):
    rows, df = one_group
    few = [r for r in rows if r[0] % 7 == 0 or r[0] >= 9000]
    found = cohort.cohort_indicators(df.filter("suministro % 7 = 0 OR suministro >= 9000"), ranges=16).collect()
    want = brute_cohort(few)
    assert len(found) == len(few)
    for r in found:
        ratio, share, flag, size = want[r.suministro]
        assert (r.iqr_outlier_flag, r.cohort_size) == (flag, size), r
        assert r.percentile_peer == pytest.approx(share) and r.peer_ratio == pytest.approx(ratio)


def test_no_window_over_a_cohort(one_group):
    plan = cohort.cohort_indicators(one_group[1])._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("__range" in x for x in windows)


def test_percent_rank_over_many_ranges(one_group):
    rows, df = one_group
    found = scoring.exposure_percentile(df.withColumnRenamed("kwh", "avg_consumption"), ranges=16).collect()
    values = {lote: sorted(r[4] for r in rows if r[1] == lote) for lote in ("L1", "L2")}
    for r in found:
        x = values[r.lote]
        assert r.avg_percentil == pytest.approx(100 * sum(v < r.avg_consumption for v in x) / (len(x) - 1))


@pytest.mark.parametrize("ranges", [None, 16])
def test_impute_and_scale_from_one_counting(spark, ranges):
    r = random.Random(6)
    kinds = {"all_null": lambda: None, "some": lambda: r.choice([None, float(r.randint(0, 9))]), "mostly": lambda: r.choice([None, None, None, r.random()]), "same": lambda: 4.0, "plain": lambda: r.gauss(0, 5)}
    own = [list(kinds.values())[i % len(kinds)] for i in range(len(forest.COLUMNS))]
    rows = [(i, "L" if i < 150 else "M", "global", *(f() for f in own)) for i in range(200)]
    df = spark.createDataFrame(rows, "suministro long, lote string, alcance string, " + ", ".join(f"{c} double" for c in forest.COLUMNS))
    scaled = {x.suministro: x for x in forest.robust_scaled(df, ranges).collect()}
    filled = {x.suministro: x for x in forest.imputed(df, ranges).collect()}
    for lote in ("L", "M"):
        part = [x for x in rows if x[1] == lote]
        for j, c in enumerate(forest.COLUMNS):
            x = [v[3 + j] for v in part]
            known = [v for v in x if v is not None]
            fill = float(np.median(known)) if known else 0.0
            full = np.array([fill if v is None else v for v in x])
            q1, q2, q3 = np.percentile(full, [25, 50, 75])
            for v, y in zip(part, (full - q2) / ((q3 - q1) or 1.0)):
                assert scaled[v[0]][c] == pytest.approx(float(y), abs=1e-9), (c, lote)
                assert filled[v[0]][c] == pytest.approx(fill if v[3 + j] is None else v[3 + j])
