"""Every query of the subpackage that has SQL against it on the smallest tables."""

import math
import os

import duckdb
import pytest

pytest.importorskip("corpusmill.llm")
from corpusmill.llm import queries  # noqa: E402

DIR = "/root/testdata/sf0.001"


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, db, name):
    df = queries.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    rel = db.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == columns and got
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
