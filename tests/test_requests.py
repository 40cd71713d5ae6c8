"""Request bounds, report gate, mapped actions, isolated axes, numbers."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quantloom.functions import numeric as N
from quantloom.operators import actions as A
from quantloom.operators import requests as R
from quantloom.operators import scoring as S
from quantloom.operators import text as X


def checked(spark, kind, payloads):
    df = spark.createDataFrame([(k, p if p is None or isinstance(p, str) else json.dumps(p)) for k, p in enumerate(payloads)], "id int, payload string")
    return sorted(R.checked(df, kind).collect(), key=lambda r: r.id)


def test_defaults_and_bounds_of_a_backtest(spark):
    got = checked(spark, "backtest", [{"symbol": "A1"}, {"symbol": "A1", "limit": 30, "tax_rate": 0.5, "initial_capital": 1e3, "engine": "event_driven"}])
    assert not any(r.errors for r in got)
    assert got[0].request.asDict() == {"symbol": "A1", "strategy": "ma_cross", "engine": "vectorized", "limit": 240, "fast_period": 5, "slow_period": 20, "initial_capital": 1e7, "commission_rate": 0.00015, "tax_rate": 0.0018, "slippage_rate": 0.0005, "corporate_action_mode": "none", "max_volume_participation": 1.0}
    assert (got[1].request.limit, got[1].request.tax_rate, got[1].request.engine) == (30, 0.5, "event_driven")
    wrong = [
        ({}, ["symbol"]), ({"symbol": "A.1"}, ["symbol"]), ({"symbol": None}, ["symbol"]), ({"symbol": 5}, ["symbol"]), ({"symbol": "A", "limit": 29}, ["limit"]), ({"symbol": "A", "limit": 366}, ["limit"]), ({"symbol": "A", "limit": 30.5}, ["limit"]), ({"symbol": "A", "limit": True}, ["limit"]), ({"symbol": "A", "limit": None}, ["limit"]),
        ({"symbol": "A", "limit": "x"}, ["limit"]), ({"symbol": "A", "initial_capital": 0}, ["initial_capital"]), ({"symbol": "A", "tax_rate": 1}, ["tax_rate"]), ({"symbol": "A", "commission_rate": -0.1, "slippage_rate": 2}, ["commission_rate", "slippage_rate"]), ({"symbol": "A", "max_volume_participation": 0}, ["max_volume_participation"]),
        ({"symbol": "A", "strategy": "sell"}, ["strategy"]), ({"symbol": "A", "engine": "x", "corporate_action_mode": "y"}, ["engine", "corporate_action_mode"]), ("[1]", ["payload"]), ("{", ["payload"]), (None, ["payload"]), ('"text"', ["payload"]),
    ]
    got = checked(spark, "backtest", [p for p, _ in wrong])
    assert [sorted(r.errors) for r in got] == [sorted(e) for _, e in wrong] and all(r.request is None for r in got)


def test_bounds_of_other_requests(spark):
    errors = lambda kind, *payloads: [r.errors for r in checked(spark, kind, payloads)]
    assert errors("candles", {}, {"limit": 0}, {"limit": 365}) == [[], ["limit"], []]
    assert errors("validation", {"symbol": "A", "n_splits": 7, "warmup_candles": 20}, {"symbol": "A", "n_splits": 2}) == [["n_splits", "warmup_candles"], []]
    assert errors("comparison", {"symbol": "BRK.B"}, {"symbol": "a"}) == [[], ["symbol"]]
    alert = {"symbol": "A", "condition": "above", "target_price": "1.5"}
    assert errors("price_alert", alert, alert | {"target_price": 0}, alert | {"target_price": "1.1234567"}, alert | {"target_price": "123456789012345.5"}, alert | {"condition": "at"}) == [[], ["target_price"], ["target_price"], ["target_price"], ["condition"]]
    good = {"start": "2026-01-01", "end": "2026-02-01", "group_hint": "candidate:" + "a0" * 10, "receipt_no": "1" * 14, "effective_at": "2026-01-05T00:00:00+09:00", "exchange_evidence_url": "https://a.b/c", "confirmation": "CONFIRM_CORPORATE_ACTION"}
    got = checked(spark, "approval", [good, good | {"start": "2026-02-30"}, good | {"receipt_no": "1" * 13, "group_hint": "candidate:x"}, good | {"effective_at": "soon", "exchange_evidence_url": "x" * 2049}, {k: v for k, v in good.items() if k != "confirmation"}])
    assert [r.errors for r in got] == [[], ["start"], ["group_hint", "receipt_no"], ["effective_at", "exchange_evidence_url"], ["confirmation"]]
    assert got[0].request.effective_at == datetime(2026, 1, 4, 15)


def test_reports_are_blocked_by_what_they_say_anywhere(spark):
    good = {"disclaimer": "d", "data_as_of": "2026-01-01T00:00:00Z", "is_investment_advice": False, "reference_signal": "risk_aware", "parts": [{"buy": ["calm", {"x": {"y": [["ok"]]}}]}]}
    deep = lambda text: good | {"parts": [{"a": [{"b": {"c": {"d": {"e": {"f": [text]}}}}}]}]}
    cases = [
        (good, None), (deep("You must  sell now"), "report-compliance-blocked"), (deep("지금 사야 합니다"), "report-compliance-blocked"), (deep('say "strong buy"'), "report-compliance-blocked"), (deep("buyer"), None), (deep("a\nb"), None), (good | {"x": "mu", "y": "st sell"}, "report-compliance-blocked"),
        (good | {"disclaimer": ""}, "report-compliance-metadata-missing"), ({k: v for k, v in good.items() if k != "data_as_of"}, "report-compliance-metadata-missing"), (good | {"is_investment_advice": None}, "report-compliance-metadata-missing"), (good | {"is_investment_advice": True}, "report-investment-advice-forbidden"),
        (good | {"is_investment_advice": "false"}, "report-investment-advice-forbidden"), (good | {"reference_signal": "hold"}, "report-reference-signal-invalid"), (good | {"reference_signal": 3}, "report-reference-signal-invalid"), (good | {"data_as_of": "yesterday"}, "report-data-as-of-invalid"), (good | {"data_as_of": 20260101}, "report-data-as-of-invalid"), ([1], "report-compliance-metadata-missing"),
    ]
    df = spark.createDataFrame([(k, json.dumps(p, ensure_ascii=False)) for k, (p, _) in enumerate(cases)] + [(99, None), (98, "{")], "id int, payload string")
    got = {r.id: r.fault for r in df.select("id", X.report_fault(F.col("payload")).alias("fault")).collect()}
    assert [got[k] for k in range(len(cases))] == [f for _, f in cases]
    assert got[99] == got[98] == "report-compliance-metadata-missing"
    said = {"k": 'a"b', "n": ["", {"x:": "y"}], "z": "q\\", "u": "é\n"}
    texts = spark.createDataFrame([(json.dumps(said),)], "p string").select(X.strings_of(F.col("p")).alias("s")).first().s
    assert texts == ['a"b', "", "y", "q\\", "é\n"]


ROWS = "kind string, symbol string, event_id string, revision int, known_at timestamp, effective_at timestamp, status string, ratio string, before string, after string, decided string, proportional boolean"


def test_mapped_actions(spark):
    t = datetime(2026, 1, 5)
    base = {"kind": "bonus_issue", "symbol": " a", "event_id": "e", "revision": 1, "known_at": t, "effective_at": t, "status": "announced", "ratio": "0.25", "before": "1,000", "after": "800", "decided": "2026-01-02", "proportional": True}
    cut = {"kind": "capital_reduction"}
    cases = [
        ({}, None), (cut, None), ({"decided": ""}, None), ({"decided": None}, None), ({"decided": "20260102"}, None), ({"kind": "split"}, "kind"), ({"kind": None}, "kind"), (cut | {"proportional": None}, "proportional_consolidation"), ({"ratio": "0"}, "ratio"), ({"ratio": "NaN"}, "ratio"), ({"ratio": None}, "ratio"),
        (cut | {"before": "x"}, "outstanding_shares"), (cut | {"after": "1000"}, "no_reduction"), ({"decided": "2026-02-30"}, "decision_date"), ({"known_at": None}, "times"), ({"symbol": " "}, "identity"), ({"revision": 0}, "identity"), ({"status": "odd"}, "status"),
    ]
    df = spark.createDataFrame([(*(base | c | {"event_id": f"{k}"}).values(),) for k, (c, _) in enumerate(cases)], ROWS)
    sound, bad = A.mapped_actions(df, strict=False)
    assert {int(r.event_id): r.reason for r in bad.collect()} == {k: r for k, (_, r) in enumerate(cases) if r}
    got = {int(r.event_id): r for r in sound.collect()}
    assert (float(got[0].price_factor), float(got[0].volume_factor), got[0].symbol, got[0].announced_at) == (0.8, 1.25, "A", datetime(2026, 1, 1, 15))
    assert (float(got[1].price_factor), float(got[1].volume_factor), got[1].action_type) == (1.25, 0.8, "reverse_split")
    assert got[2].announced_at is None and got[4].announced_at == got[0].announced_at
    assert A.mapped_actions(df.where("event_id < 5"))[0].count() == 5
    with pytest.raises(Exception, match="rejected action: kind"):
        A.mapped_actions(df.where("event_id <= 5"))[0].select("symbol").collect()


def test_an_axis_that_fails_when_it_runs_is_missing_alone(spark, tmp_path):
    symbols = spark.createDataFrame([("a",), ("b",)], "symbol string")
    score = lambda v: symbols.withColumn("score", F.lit(v))

    def keep(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def none():
        raise OSError("no feed")

    loaders = {"technical": lambda: score(60.0), "news": lambda: score(1.0).withColumn("score", F.raise_error(F.lit("broken")).cast("double")), "financial": none, "disclosure": lambda: symbols.select("symbol", "score")}
    found, status = S.isolated_axes(symbols, loaders, keep)
    assert sorted((r.symbol, r.technical, r.news, r.financial, r.risk) for r in found.collect()) == [("a", 60.0, None, None, None), ("b", 60.0, None, None, None)]
    assert status["technical"] == "available" and status["risk"] == "unavailable" and all(status[a].startswith("failed: ") for a in ("news", "financial", "disclosure")) and status["financial"] == "failed: OSError"


def test_numbers_of_json(spark):
    df = spark.createDataFrame([("1",), ("-2.5",), ("true",), ('"3"',), ("null",), ("[1]",), ("1e3",)], "j string")
    assert [r[0] for r in df.select(N.number_of(F.parse_json("j"))).collect()] == [1.0, -2.5, None, None, None, None, 1000.0]


def test_results_as_json(spark):
    from decimal import Decimal

    from quantloom.operators import history as H

    metrics = spark.createDataFrame([("a", Decimal("1.50"), 0.5), ("b", None, None)], "run string, total decimal(10,2), rate double")
    curve = spark.createDataFrame([("a", 2, 20.0), ("a", 1, 10.0), ("c", 1, 1.0)], "run string, at int, equity double")
    got = {r.run: (json.loads(r.metrics), json.loads(r.curve)) for r in H.result_payloads(metrics, {"curve": curve}, ["run"], ["at"]).collect()}
    assert got == {"a": ({"total": "1.50", "rate": 0.5}, [{"at": 1, "equity": 10.0}, {"at": 2, "equity": 20.0}]), "b": ({}, [])}
    with pytest.raises(Exception, match="more than 1 rows of curve"):
        H.result_payloads(metrics, {"curve": curve}, ["run"], ["at"], 1).collect()
