"""Every catalogue query against its SQL in DuckDB, over the smallest tables."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from artilake.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if pd.isna(v):
            return "null"
        return repr(round(float(v), 6)) if not isinstance(v, str) and not math.isnan(float(v)) else v

    return sorted(tuple(value(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_imports_without_the_training_operators():
    block = "import sys; sys.modules['artilake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", block], capture_output=True, text=True, cwd=root, check=True).stdout.split()
    assert out == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLE)), "False"]
