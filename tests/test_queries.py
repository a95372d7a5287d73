"""Every registered query against its SQL twin on the smallest data, where that is at hand."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from casewatch.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(catalog.queries())


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "~" if v is None or v is pd.NA or v is pd.NaT or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v))
        df[c] = df[c].astype(str).str.replace(r"\.0$", "", regex=True)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    if not DATA.is_dir():
        pytest.skip("no test data here")
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    got = df.toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        pd.testing.assert_frame_equal(plain(got), plain(duck.sql(sql).df()))


def test_stream_payments_match_the_batch(spark, duck):
    q = catalog.queries()
    a, b = (q[n](spark, str(DATA)).toPandas() for n in ("p04_apply_payments", "t06_stream_payments"))
    merged = a.merge(b, on="assinatura", suffixes=("", "_s"))
    assert len(merged) == len(b) and (merged.vigente_ate == merged.vigente_ate_s).all() and (merged.pagamentos == merged.pagamentos_s).all()


def test_llm_is_not_imported_by_the_rest():
    for p in Path(catalog.__file__).parents[1].rglob("*.py"):
        if "llm" not in p.parts:
            assert "casewatch.llm" not in p.read_text() and "from ..llm" not in p.read_text()


def test_filters_and_columns_reach_the_scan(spark, duck):
    from casewatch.operators import normalize
    from casewatch.plans import bindings

    rows = bindings.table(spark, str(DATA), "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    plan = rows.where("o_totalprice > 1000").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan and "o_custkey" not in plan.split("ReadSchema")[1]
    p = normalize.filter_rows(bindings.processo(spark, str(DATA)), 3, status="O")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in p
