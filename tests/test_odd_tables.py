"""Registered queries against their SQL on tables with what the smallest ones lack."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def held(spark, tmp_path):
    """Runs a query and its SQL on tables made by SELECTs; gives its rows."""

    def run(name, **tables):
        from quantloom.plans import ALL, ORACLE

        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for table, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet'")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        want = con.execute(ORACLE[name])
        columns = [c[0] for c in want.description]
        got = ALL[name](spark, str(tmp_path)).select(*columns).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
        return got

    return run


def test_guarded_bars_of_values_not_above_zero(held):
    got = held("guarded_bars", events=f"SELECT * REPLACE (CASE event_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN -value ELSE value END AS value) FROM '{SF}/events.parquet'")
    assert min(r.low for r in got) < 0


def test_request_bounds_of_order_zero(held):
    # beyond the bound by the key's digits alone, 0 wasn't
    got = held("request_bounds", orders=f"SELECT * REPLACE (i * 10 AS o_orderkey, c AS o_custkey) FROM (SELECT * FROM '{SF}/orders.parquet' LIMIT 1), range(50) r(i), range(5, 12) s(c)")
    assert "fast_period,max_volume_participation" in {r.errors for r in got if r.id == 0}


def test_compliance_scan_beside_letters_beyond_ascii(held):
    said = ["ébuy", "buyé", "\u0301buy", "매수sell", "sell을", "x\u017fell", "\u017fell", "\u017ftrong buy", "mu\u017ft sell", "must\u000bsell", "must\u00a0sell", "strong\u0085buy", "_buy", "buy_", "buy1", "BUY\u200d", "사야\u000b합니다", "팔아야 \n해요", "bu\u212ay", "", "자매수"]
    rows = " UNION ALL ".join(f"SELECT {4 + 5 * k}::BIGINT, '{t}'" for k, t in enumerate(said))
    got = held("compliance_scan", documents=f"SELECT * FROM ({rows} UNION ALL SELECT 1004, NULL UNION ALL SELECT 1005, NULL) t(doc_id, text)")
    assert len({r.pattern for r in got}) > 4


def copies(table, key, n, shift, **more):
    """A table n times, with shifted keys."""
    put = ", ".join(f"{c} + i * {d} AS {c}" for c, d in {key: shift, **more}.items())
    return f"SELECT t.* REPLACE ({put}) FROM '{SF}/{table}.parquet' t, range({n}) r(i)"


def test_candidate_scan_of_receipts_that_come_again(held):
    # one receipt number, day by day, of orders of several symbols and of one
    got = held("candidate_scan", orders=copies("orders", "o_orderkey", 3, 1_000_000, o_custkey=1000))
    assert len({r.receipt_no for r in got}) * 3 == len(got)


def test_candidates_by_more_than_the_receipt(spark):
    from quantloom.operators import actions as A

    rows = spark.createDataFrame([("S", "bonus_issue", "20240101000001", k) for k in (2, 1)], "symbol string, kind string, receipt_no string, k int").selectExpr("*", "1.0BD ratio", "1.0BD before", "1.0BD after", "null::date decision_date", "null::date record_date")
    filings = spark.createDataFrame([("20240101000001", 1, "[기재정정] x", None), ("20240101000001", 2, "x", "정")], "receipt_no string, k int, report_name string, remarks string")
    got = A.candidates(rows, filings, by=["receipt_no", "k"]).orderBy("place").collect()
    assert [(r.k, r.place, r.correction_hint, r.superseded_hint) for r in got] == [(2, 1, False, True), (1, 2, True, False)]


def test_code_catalogue_of_codes_that_come_again(held):
    got = held("code_catalogue", customer=copies("customer", "c_custkey", 4, 300_000))
    assert len({(r.archive, r.stock_code) for r in got}) < len(got)


def test_approval_workflow_of_keys_beyond_a_receipts_digits(held):
    got = held("approval_workflow", orders=copies("orders", "o_orderkey", 3, 1_000_000))
    assert {r.error for r in got if r.created} == {"none"} and any(r.already for r in got)
