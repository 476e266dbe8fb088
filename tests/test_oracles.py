"""Every query with SQL gives the same rows in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from corpusloom.plans import catalog

ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canon(table) -> list[tuple]:
    df = table.to_pandas(types_mapper=pd.ArrowDtype)
    df = df[sorted(df.columns)].astype(object)
    floats = [isinstance(v, float) for v in (df.iloc[0] if len(df) else [])]

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "-"
        return float(v) if isinstance(v, float) else str(v)

    rows = [tuple(map(cell, row)) for row in df.itertuples(index=False)]
    exact = lambda row: tuple(str(v) for v in row if not isinstance(v, float))
    return sorted(rows, key=lambda row: (exact(row), [f"{v:.4f}" for v in row if isinstance(v, float)])) if floats else rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, duck, data_dir):
    ours = catalog.queries()[name](spark, data_dir).toArrow()
    theirs = duck.execute(ORACLE[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    a, b = canon(ours), canon(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            # one unit of the last of six places: sums in another order
            assert u == v or isinstance(u, float) and isinstance(v, float) and abs(u - v) < 1.1e-6, (x, y)


def test_entry(spark, data_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
