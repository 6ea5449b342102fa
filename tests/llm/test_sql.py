"""The corpus queries that have SQL, against it."""

import duckdb
import pytest

from veraframe.llm import registry

from .helpers import MIDDLE, SMALL

FOLDERS = {"op5_minhash": SMALL, "op9_line_dedup": MIDDLE}


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    folder = FOLDERS[name]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = registry.queries()[name](spark, folder)
    want = db.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: str(r)
    columns = sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted((tuple(r) for r in want.select(*columns).fetchall()), key=key)
