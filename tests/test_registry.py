"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def entries():
    from quantloom.plans import ALL

    return sorted(ALL)


def rows(df):
    cell = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    columns = sorted(df.columns)
    return sorted(([cell(v) for v in r] for r in df[columns].astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", entries())
def test_query(spark, duck, name):
    from quantloom.plans import ALL, ORACLE

    got = ALL[name](spark, SF).toPandas()
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        plain(name, got, duck)


def plain(name, got, duck):
    """What can be said of queries without SQL."""
    import json

    one = lambda sql: duck.execute(sql).fetchone()[0]
    if name == "report_payloads":
        want = {k: (str(p), s) for k, p, s in duck.execute("SELECT o_orderkey, o_totalprice::DECIMAL(20, 6), o_orderstatus FROM orders").fetchall()}
        assert {r.o_orderkey: tuple(json.loads(r.payload).values()) for r in got.itertuples()} == want
    elif name == "mock_feed":
        assert len(got) == 180 and (got.low <= got[["open", "close"]].min(axis=1)).all() and (got.high >= got[["open", "close"]].max(axis=1)).all()
    elif name == "token_bucket":
        assert len(got) == one("SELECT count(*) FROM events") and (got.select_dtypes("number").filter(like="wait") >= 0).all().all()
    elif name in ("gbt_prediction", "gbt_by_symbol"):
        assert sorted(got.symbol) == sorted(r[0] for r in duck.execute("SELECT DISTINCT event_type FROM events").fetchall()) and got.rise_probability.between(0, 1).all()
        if name == "gbt_by_symbol":
            assert (got.confidence_lower <= got.rise_probability).all() and (got.rise_probability <= got.confidence_upper).all() and (got.validation_samples > 0).all()
    else:
        raise AssertionError(f"{name} has neither SQL nor a check")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
