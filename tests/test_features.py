"""Hand-computed values of features, cohorts and rules."""

from datetime import date
from math import isclose, sqrt

import pytest
from pyspark.sql import functions as F

from wattsift.operators import cohort, features, rules


def months(spark, values, first=(2023, 1), supply=1, at=None):
    rows = []
    for i, v in enumerate(values):
        n = (at[i] if at else i) + first[1] - 1
        rows.append((supply, date(first[0] + n // 12, n % 12 + 1, 1), float(v)))
    return spark.createDataFrame(rows, "suministro long, inicio date, kwh double")


def last(df):
    return df.orderBy(F.desc("inicio")).first()


def test_linear_series(spark):
    r = last(features.history_features(months(spark, range(100, 231, 10))))
    assert (r.avg_consumption, r.max_consumption, r.min_consumption, r.moving_avg_6m, r.trend_slope) == (175.0, 230.0, 120.0, 205.0, 10.0)
    assert isclose(r.stddev_consumption, sqrt(1300)) and isclose(r.pct_change_prev_period, 10 / 220) and isclose(r.pct_change_yoy, 120 / 110)
    assert isclose(r.deviation_from_baseline, 55 / sqrt(1300)) and isclose(r.seasonality_index, 230 / 110) and isclose(r.zscore_self, 65 / sqrt(1750))
    assert r.zero_consumption_streak == 0 and not r.is_cold_start


def test_two_months_are_a_cold_start(spark):
    r = last(features.history_features(months(spark, [100, 150])))
    assert r.is_cold_start and r.avg_consumption == 125 and r.pct_change_prev_period == 0.5 and r.seasonality_index == 1.0
    assert r.stddev_consumption is None and r.deviation_from_baseline is None and r.trend_slope is None and r.zscore_self is None and r.pct_change_yoy is None


def test_later_periods_change_nothing(spark):
    short = features.history_features(months(spark, [100, 120, 90, 80])).collect()
    long = {r.inicio: r for r in features.history_features(months(spark, [100, 120, 90, 80, 99999])).collect()}
    assert all(long[r.inicio] == r for r in short)


def test_slope_uses_the_calendar(spark):
    r = last(features.history_features(months(spark, [100, 100, 100, 400], at=[0, 1, 2, 12])))
    assert isclose(r.trend_slope, 2475 / 92.75)


def test_seasonality_of_zero_mean_is_null(spark):
    r = last(features.history_features(months(spark, [0, 50], at=[0, 12])))
    assert r.seasonality_index is None and r.pct_change_yoy is None


def test_streak_counts_the_whole_history(spark):
    whole = months(spark, [0, 500, 0, 0])
    assert last(features.streak_of_all(whole)).zero_consumption_streak == 2
    assert last(features.history_features(whole.filter("kwh <> 500"))).zero_consumption_streak == 3


def peers(spark, values, locality="L"):
    rows = [(i, "B", "C", locality if locality != "mixed" else f"L{i % 3}", float(v)) for i, v in enumerate(values)]
    return {r.kwh: r for r in cohort.cohort_indicators(spark.createDataFrame(rows, "suministro long, lote string, categoria string, localidad string, kwh double")).collect()}


def test_large_cohort(spark):
    r = peers(spark, [*range(100, 151, 5), 1000])
    assert r[1000].iqr_outlier_flag and r[1000].percentile_peer == 1.0
    assert not r[100].iqr_outlier_flag and isclose(r[100].percentile_peer, 1 / 12)


def test_fallback_cohort(spark):
    r = peers(spark, [10, 20, 30, 40, 50], "mixed")
    assert r[30].percentile_peer == 0.6 and r[30].peer_ratio == 1 and not r[30].iqr_outlier_flag and isclose(r[50].peer_ratio, 50 / 30)


def test_small_cohort_and_missing_locality(spark):
    r = peers(spark, [10, 20], None)
    assert r[20].percentile_peer is None and r[20].iqr_outlier_flag is None and isclose(r[20].peer_ratio, 20 / 15) and r[20].localidad is None


def test_quartiles_leave_the_row_out(spark):
    r = peers(spark, [10, 20, 10000], "mixed")
    assert r[10000].iqr_outlier_flag and r[10000].percentile_peer == 1.0 and not r[10].iqr_outlier_flag


@pytest.mark.parametrize(("change", "expected"), [
    ({"zero_consumption_streak": 3}, {"R1"}), ({"zero_consumption_streak": 3, "estado": "Baja"}, set()), ({"zero_consumption_streak": 2}, set()),
    ({"pct_change_prev_period": -0.60}, {"R2"}), ({"pct_change_prev_period": -0.59}, set()), ({"pct_change_prev_period": 2.0}, {"R3"}), ({"pct_change_prev_period": 1.99}, set()),
    ({"percentile_peer": 0.05, "peer_ratio": 0.4}, {"R4"}), ({"percentile_peer": 0.05, "peer_ratio": 0.41}, set()),
    ({"percentile_peer": 0.95, "peer_ratio": 2.5}, {"R5"}), ({"percentile_peer": 0.95, "peer_ratio": 2.49}, set()),
    ({"deviation_from_baseline": 3.0}, {"R6"}), ({"deviation_from_baseline": -3.0}, {"R6"}), ({"deviation_from_baseline": 2.99}, set()),
])
def test_rules(spark, change, expected):
    row = {"suministro": 1, "lote": "B", "estado": "Activo", "zero_consumption_streak": 0, "pct_change_prev_period": None, "percentile_peer": None, "peer_ratio": None, "deviation_from_baseline": None} | change
    schema = "suministro long, lote string, estado string, zero_consumption_streak long, pct_change_prev_period double, percentile_peer double, peer_ratio double, deviation_from_baseline double"
    df = spark.createDataFrame([tuple(row[k.split()[0]] for k in schema.split(", "))], schema)
    hits = rules.rule_hits(df).collect()
    assert {h.regla for h in hits} == expected and all(h.descripcion for h in hits)
    assert rules.with_hit_count(df).first().n_reglas == len(expected)
