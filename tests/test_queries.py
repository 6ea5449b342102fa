"""Each registered query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from veraframe.plans import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cells(df):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "-"
        if isinstance(v, bool) or isinstance(v, str):
            return str(v)
        return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else f"{float(v):.9g}"

    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(engine.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = __spark_entry__.queries()[name](spark, SF)
    a = pd.DataFrame([tuple(r) for r in got.collect()], columns=got.columns)
    b = db.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and cells(a) == cells(b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_plans_are_what_they_should_be(spark):
    from veraframe.operators.check import check_spec, duplicated_rows
    from veraframe.plans.specs import lineitem

    d = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert duplicated_rows(d, ["l_orderkey", "l_linenumber"]) >= 0
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    check_spec(d, lineitem(), "LINES")
    assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup()) - set(before)) <= 14
    # Of a table of eleven columns the key check reads its two.
    plan = d.groupBy("l_orderkey", "l_linenumber").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan
