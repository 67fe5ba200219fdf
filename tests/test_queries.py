"""Every registered query with SQL gives the same rows in Spark and in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")
NO_SQL = ["factor_explanations", "factors_read_back", "feature_vectors_json", "synthetic_consumption", "ml_report"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def comparable(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v) + 0.0:.6f}"
        return str(v)[:10] if type(v).__name__ in ("date", "Timestamp") else str(v)

    columns = sorted(df.columns)
    return sorted(tuple(text(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(name, spark, sf_dir, duck):
    ours = entry.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert comparable(ours) == comparable(theirs)


@pytest.mark.parametrize("name", NO_SQL)
def test_runs(name, spark, sf_dir):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "ire" in rows.columns
