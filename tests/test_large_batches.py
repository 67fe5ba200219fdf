"""Batches in which a category has a thousand supplies and more."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wattsift.operators import forest, imports
from wattsift.plans import catalog


@pytest.fixture(scope="module")
def wide_dir(tmp_path_factory):
    """1,300 supplies of two categories in three months; one category has over 1,000 in each."""
    d = tmp_path_factory.mktemp("wide")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT CAST(i AS INTEGER) AS n_nationkey, 'N' || i AS n_name, CAST(i AS INTEGER) AS n_regionkey FROM range(2) t(i)) TO '{d}/nation.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT i AS s_suppkey, 'S' || i AS s_name, CAST(i >= 1100 AS INTEGER) AS s_nationkey, 1.0 AS s_acctbal FROM range(1300) t(i)) TO '{d}/supplier.parquet' (FORMAT parquet)")
    con.execute(f"""COPY (SELECT i AS l_suppkey, CAST(CASE WHEN i >= 1100 THEN i * 3 + m ELSE (i * 31 + m * 7) % 50 END AS DOUBLE) AS l_quantity, CASE WHEN i % 5 = m THEN 'N' ELSE 'R' END AS l_returnflag,
      TIMESTAMP '1995-01-10' + INTERVAL (m) MONTH AS l_shipdate FROM range(1300) t(i), range(3) u(m) WHERE i % 23 <> m) TO '{d}/lineitem.parquet' (FORMAT parquet)""")  # fmt: skip
    return str(d)


def _rows(con, sql):
    return sorted(con.execute(sql).fetchall())


@pytest.mark.parametrize("name", ["impute_matrix", "robust_scaled"])
def test_one_scope_as_in_the_sql(name, spark, wide_dir, tmp_path):
    con = duckdb.connect()
    for t in ("nation", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{wide_dir}/{t}.parquet'")
    entry.queries()[name](spark, wide_dir).write.parquet(f"{tmp_path}/ours")
    con.execute(f"CREATE TABLE theirs AS {entry.oracle_sql()[name]}")
    names = ", ".join(r[0] for r in con.execute("DESCRIBE theirs").fetchall())
    assert _rows(con, f"SELECT {names} FROM '{tmp_path}/ours/*.parquet'") == _rows(con, f"SELECT {names} FROM theirs")


def test_scopes_of_their_own_are_imputed_apart(spark, wide_dir, tmp_path):
    """What the queries don't show: the model's medians are those of (batch, category) where a category is large enough."""
    vectors = forest.with_scope(catalog.rules.prior_anomalies(catalog._vectors(spark, wide_dir)))
    columns = ["pct_change_prev_period", "stddev_consumption"]
    forest.numeric(vectors).write.parquet(f"{tmp_path}/matrix")
    forest.imputed(spark.read.parquet(f"{tmp_path}/matrix")).select("suministro", "lote", "alcance", *columns).write.parquet(f"{tmp_path}/ours")
    con = duckdb.connect()
    filled = ", ".join(f"round(coalesce({c}, quantile_cont({c}, 0.5) OVER (PARTITION BY lote, alcance), 0.0), 9) + 0.0" for c in columns)
    ours = _rows(con, f"SELECT suministro, lote, alcance, {', '.join(f'round({c}, 9) + 0.0' for c in columns)} FROM '{tmp_path}/ours/*.parquet'")
    assert ours == _rows(con, f"SELECT suministro, lote, alcance, {filled} FROM '{tmp_path}/matrix/*.parquet'")
    assert vectors.select("alcance").distinct().count() == 2 and vectors.filter(F.col("alcance") != "global").count() > 1000


def _times(df, word: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(word)


def test_addresses_are_parsed_once(spark, sf_dir):
    """Of the records' addresses nothing is left to parse in the merge's branches; the stored ones are parsed in one place."""
    for name in ("merge_clients", "merge_client_counts"):
        assert _times(entry.queries()[name](spark, sf_dir), "parseJson") <= 3


def test_records_are_judged_once_and_by_many_tasks(spark, sf_dir, monkeypatch):
    """Records of one row group are dealt before they are parsed, and the merge's branches measure no address again."""
    written = []
    monkeypatch.setattr(imports, "cut", lambda df, name: written.append(catalog.cut(df, name)) or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few records would come to one task
    try:
        merged = entry.queries()["merge_clients"](spark, sf_dir)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shares = [r["count"] for r in written[0].groupBy(F.input_file_name()).count().collect()]
    assert max(shares) < 0.5 * sum(shares)
    assert _times(merged, "regexp_replace") == 0


def test_rows_are_scaled_where_they_are(spark, wide_dir):
    """Statistics go to the rows: no plan shuffles the matrix to join what is known of its scopes."""
    vectors = catalog.cut(catalog.rules.prior_anomalies(catalog._vectors(spark, wide_dir)), "vectors")
    scaled = forest.robust_scaled(forest.numeric(forest.with_scope(vectors)))
    assert scaled._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2 == _times(scaled, "strategy=broadcast")


@pytest.mark.parametrize("size", [1, 2, 40, 5000])
def test_scores_are_those_of_a_plain_walk(size, monkeypatch):
    monkeypatch.setattr(forest, "CHUNK", 64)
    x = np.random.default_rng(size).integers(0, 9, (size, 4)) / 8.0
    grown = forest.fit_forest(x, trees=7, sample=32)
    paths = []
    for row in x[:200]:
        total = 0.0
        for f, s, v in zip(grown.feature, grown.split, grown.value):
            i = 0
            while f[i] >= 0:
                i = 2 * i + 1 + int(row[f[i]] >= s[i])
            total += v[i]
        paths.append(total)
    norm = float(forest.average_path(grown.size))
    want = -np.power(2.0, -np.array(paths) / 7 / norm) if norm else np.full(len(paths), -0.5)
    assert (forest.score_samples(grown, x[:200]) == want).all()


def test_model_scores_are_computed_once(spark, wide_dir):
    """Scales and percentiles start from the rows with their scores, not from what the scores come from."""
    vectors = catalog.cut(catalog.rules.prior_anomalies(catalog._vectors(spark, wide_dir)), "vectors")
    scored = catalog.process.scored(vectors, catalog._predictions(vectors), reasons=True)
    assert all("/modelled-" in f or "/ranges-" in f for f in scored.inputFiles())
