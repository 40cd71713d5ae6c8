"""Golden values and look-ahead checks of bars, indicators, patterns and backtests."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import actions as A
from quantloom.operators import backtest as K
from quantloom.operators import bars as B
from quantloom.operators import indicators as I
from quantloom.operators import patterns as P
from quantloom.operators import scoring as S
from quantloom.streaming import quotes as Q

START = datetime(2026, 1, 1)
SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def bars(spark, rows, symbol="A", days=None, schema=SCHEMA):
    days = days or [START + timedelta(days=i) for i in range(len(rows))]
    return spark.createDataFrame([(symbol, d, *map(float, r[:4]), int(r[4])) for d, r in zip(days, rows)], schema)


def raw(spark, rows, days, basis=None):
    df = [(("A", d, *map(float, r[:4]), int(r[4])) + (i, (basis or ["unadjusted"] * len(rows))[i])) for i, (d, r) in enumerate(zip(days, rows))]
    return spark.createDataFrame(df, SCHEMA + ", seq long, price_basis string")


def rising(n, step=1, volume=100):
    return [(100 + step * i, 102 + step * i, 98 + step * i, 101 + step * i, volume) for i in range(n)]


def test_indicators_of_a_rising_series(spark):
    row = I.with_indicators(bars(spark, rising(40))).orderBy(F.desc("ts")).first()
    assert (row.ma_5, row.ma_20, row.rsi_14, row.mfi_14, row.obv, row.vwap) == (138.0, 130.5, 100.0, 100.0, 3900.0, 119.833333)
    short = I.with_indicators(bars(spark, rising(10))).orderBy(F.desc("ts")).first()
    assert short.rsi_14 is None and short.ma_20 is None and short.atr_14 is None


def test_technical_scores(spark):
    for step, want in ((1, 56.8517), (-1, 27.3063)):
        rows = [(100 + step * i, 102 + step * i, 98 + step * i, 101 + step * i if step > 0 else 101 + step * i, 1000) for i in range(40)]
        got = S.technical(I.with_indicators(bars(spark, rows))).orderBy(F.desc("ts")).first().technical_score
        assert got == pytest.approx(want, abs=1e-4)


def test_partial_score(spark):
    axes = spark.createDataFrame([(60.0, None, None, None, None, None)], "technical double, financial double, news double, disclosure double, investor_flow double, market_risk double")
    row = S.aggregate(axes).first()
    assert (row.overall_score, row.coverage, row.available_axes) == (60.0, 0.3, 1)


def test_look_ahead(spark):
    rng = np.random.default_rng(1)
    close = 100 + rng.normal(size=60).cumsum()
    rows = [(c, c + 2, c - 2, c + 0.5, 100) for c in close]
    changed = [*rows[:-1], (50, 300, 10, 200, 999)]
    for build in (I.with_indicators, S.features, lambda b: K.ma_cross(b), lambda b: P.patterns(b)):
        a, b = (build(bars(spark, r)).where(F.col("ts") < START + timedelta(days=54)).drop("label").orderBy("ts", *(["rank"] if build.__name__ == "<lambda>" and "rank" in build(bars(spark, r)).columns else [])).toPandas() for r in (rows, changed))
        pd.testing.assert_frame_equal(a, b)


def test_pipeline_rules(spark):
    days = [datetime(2026, 7, 1), datetime(2026, 7, 2)]
    bad = raw(spark, [(10, 12, 8, 10, 1), (10, 9, 8, 10, 1)], days)
    assert B.clean(bad).count() == 1 and B.quality_logs(bad).where("severity = 'error'").count() >= 1
    week = bars(spark, [(10, 10, 10, 10, 10), (12, 12, 12, 12, 20), (11, 11, 11, 11, 30)], days=[datetime(2026, 7, d) for d in (6, 7, 8)])
    row = B.resample(week, "1w").first()
    assert (row.open, row.close, row.volume) == (10, 11, 60)
    flat = [(10, 10, 10, 10, 1)] * 3
    assert B.gaps(raw(spark, flat, [datetime(2026, 7, d) for d in (3, 6, 10)])).count() == 0
    assert [r.missing_days for r in B.gaps(raw(spark, flat[:2], [datetime(2026, 7, 1), datetime(2026, 7, 10)])).collect()] == [6]
    rules = {r.rule for r in B.quality_logs(raw(spark, flat[:2], [datetime(2026, 7, 10), datetime(2026, 7, 1)])).collect()}
    assert rules == {"out_of_order", "missing_daily_candles"}
    mixed = raw(spark, flat[:2], days, ["unadjusted", "provider_adjusted"])
    assert B.clean(mixed).count() == 0 and "mixed_price_basis" in {r.rule for r in B.quality_logs(mixed).collect()}


def names(spark, rows):
    return {r.name for r in P.latest_patterns(bars(spark, rows)).collect()}


def test_patterns(spark):
    assert "doji" in names(spark, [(100, 105, 95, 100.5, 1)])
    assert "hammer" in names(spark, [(104, 105, 90, 102, 1)])
    assert "shooting_star" in names(spark, [(96, 110, 95, 98, 1)])
    assert "bullish_engulfing" in names(spark, [(104, 105, 99, 100, 1), (99, 106, 98, 105, 1)])
    assert "bearish_engulfing" in names(spark, [(100, 105, 99, 104, 1), (105, 106, 98, 99, 1)])
    flat = [(100, 102, 98, 100, 1)] * 20
    assert "range_breakout_up" in names(spark, [*flat, (101, 106, 100, 105, 1)])
    assert "range_breakout_down" in names(spark, [*flat, (99, 100, 94, 95, 1)])
    highs = [100, 102, 105, 110, 105, 102, 100, 103, 106, 109.5, 106, 101, 98, 95]
    assert "double_top_confirmed" in names(spark, [(h - 3, h, h - 6, h - 2, 1) for h in highs])
    lows = [100, 98, 95, 90, 95, 98, 100, 97, 94, 90.5, 94, 99, 102, 105]
    assert "double_bottom_confirmed" in names(spark, [(l + 3, l + 6, l, l + 2, 1) for l in lows])


FREE = dict(initial_capital=1000.0, commission=0.0, tax=0.0, slippage=0.0)


def pairs(spark, rows, volume=100):
    return K.buy_and_hold(bars(spark, [(o, max(o, c), min(o, c), c, volume) for o, c in rows]))


def test_backtests(spark):
    known = pairs(spark, [(100, 100), (100, 110), (110, 121)])
    config = K.Config(**FREE, force_close=False)
    curve = K.vectorized(known, config)
    assert curve.orderBy(F.desc("ts")).first().equity == pytest.approx(1210)
    event = K.event_driven(known, config)
    assert event.orderBy(F.desc("ts")).first().equity == pytest.approx(1210)
    assert [(r.side, r.quantity) for r in K.fills(event).collect()] == [("buy", 10)]
    late = K.vectorized(pairs(spark, [(50, 100), (100, 100), (100, 100)]), config)
    assert late.orderBy(F.desc("ts")).first().equity == pytest.approx(1000)
    drop = pairs(spark, [(100, 100), (100, 80), (80, 100)])
    curve = K.vectorized(drop, config)
    assert K.metrics(curve, K.trades(curve, config), config).first().max_drawdown == pytest.approx(-0.2)
    costly = K.Config(initial_capital=1000.0, commission=0.001, tax=0.002, slippage=0.001)
    curve = K.vectorized(drop, costly)
    assert K.metrics(curve, K.trades(curve, costly), costly).first().trade_count == 2
    closed = K.event_driven(pairs(spark, [(100, 100), (100, 110), (110, 120)]), K.Config(initial_capital=1000.0, commission=0.001, tax=0.002, slippage=0.0))
    assert [(r.side, r.reason) for r in K.events_of(closed).where("event_type = 'fill'").orderBy("ts").collect()] == [("buy", "signal"), ("sell", "force_close")]
    level = [(100, 100)] * 3
    part = K.event_driven(pairs(spark, level), K.Config(**FREE, force_close=False, participation=0.05))
    assert [(r.requested, r.quantity) for r in K.events_of(part).where("event_type = 'partial_fill'").collect()] == [(10, 5)]
    dry = K.event_driven(pairs(spark, level, 0), K.Config(**FREE, force_close=False, participation=0.1))
    assert {r.reason for r in K.events_of(dry).collect()} == {"insufficient_liquidity"}


def action(revision=1, status="confirmed", known=datetime(2026, 1, 5)):
    from decimal import Decimal

    return ("A", "feed", "e1", revision, datetime(2026, 1, 10), known, Decimal("0.5"), Decimal("2"), status)


ACTION = "symbol string, source string, event_id string, revision int, effective_at timestamp_ntz, known_at timestamp_ntz, price_factor decimal(24,12), volume_factor decimal(24,12), status string"


def test_corporate_actions(spark):
    two = bars(spark, [(100, 120, 90, 110, 1000), (55, 60, 50, 58, 2200)], days=[datetime(2026, 1, 2), datetime(2026, 1, 12)])
    one = spark.createDataFrame([action()], ACTION)
    rows = A.adjust_backward(two, one, datetime(2026, 1, 12)).orderBy("ts").collect()
    assert [(float(r.open), float(r.close), r.volume) for r in rows] == [(50, 55, 2000), (55, 58, 2200)]
    both = spark.createDataFrame([action(), action(2, "cancelled", datetime(2026, 1, 15))], ACTION)
    for when, want in ((datetime(2026, 1, 12), 50), (datetime(2026, 1, 16), 100)):
        assert float(A.adjust_backward(two, both, when).orderBy("ts").first().open) == want
    forward = A.adjust_forward(two, one, datetime(2026, 1, 12)).orderBy("ts").collect()
    assert [(float(r.close), r.volume) for r in forward] == [(110, 1000), (116, 1100)]
    with pytest.raises(Exception, match="revised or late"):
        A.adjust_forward(two, both, datetime(2026, 1, 16)).collect()
    late = spark.createDataFrame([action(known=datetime(2026, 1, 11))], ACTION)
    with pytest.raises(Exception, match="revised or late"):
        A.adjust_forward(two, late, datetime(2026, 1, 16)).collect()


def test_many_actions_of_a_symbol(spark):
    """Against a product for each bar, over streams of many batches; no list of a symbol's actions."""
    from decimal import Decimal

    rng = np.random.default_rng(3)
    days = [START + timedelta(days=i) for i in range(120)]
    df = bars(spark, rising(120), days=days).unionByName(bars(spark, rising(3), "B", days[:3]))
    acts = [("A", "feed", f"e{i}", 1, days[int(rng.integers(120))], START - timedelta(days=9), Decimal(str(f)), Decimal(str(1 / f)), "confirmed") for i in range(300) for f in [(0.5, 0.8, 2.0, 1.25)[i % 4]]]
    actions, end = spark.createDataFrame(acts, ACTION), START + timedelta(days=400)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for run, hit, inverse in ((A.adjust_backward, lambda ts, at: ts < at, False), (A.adjust_forward, lambda ts, at: ts >= at, True)):
            out = run(df, actions, end)
            got = {(r.symbol, r.ts): r for r in out.collect()}
            assert len(got) == 123
            for i, ts in enumerate(days):
                chosen = [float(a[6]) for a in acts if hit(ts, a[4])]
                factor = np.prod(chosen) if not inverse else 1 / np.prod(chosen)
                assert float(got["A", ts].close) == pytest.approx((101 + i) * factor, rel=1e-6) and got["A", ts].applied == len(chosen)
            assert all(got["B", d].applied == 0 and float(got["B", d].close) == 101 + i for i, d in enumerate(days[:3]))
            assert "collect_list" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_signals_and_portfolio(spark):
    df = spark.createDataFrame([(68.0, 0.70, 0), (72.0, 0.25, 0), (32.0, 0.30, 0), (50.0, 0.5, 1), (None, 0.5, 0)], "overall_score double, rise_probability double, warning_count int")
    assert [r.signal for r in S.reference_signal(df).collect()] == ["positive_watch", "neutral_watch", "defensive_watch", "risk_aware", "data_insufficient"]
    held = spark.createDataFrame([("KRW", "A", 100.0, 90.0, 10.0), ("USD", "B", 50.0, 45.0, 5.0)], "currency string, symbol string, market_value double, purchase_amount double, profit_loss_after_cost double")
    by = S.portfolio(held)
    assert {r.concentration_index for r in by.collect()} == {1.0} and S.portfolio_signal(by).first()[0] == "concentration_watch"
    split = S.purged_splits(spark.createDataFrame([("A", 120)], "symbol string, n long"), 5, 40, 3).collect()
    assert all(r.train_end - 1 + 5 < r.test_start for r in split) and len(split) == 3


def test_limits_hold_one_batch(spark):
    """A hot key, null keys and keys that cross batches, against plain folds; no frame of a whole key."""
    rng = np.random.default_rng(4)
    rows = [((None, 1, 2, 2, 2)[int(rng.integers(5))], START + timedelta(seconds=int(rng.integers(900))), i) for i in range(400)]
    events = spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long")
    allowed, waits = {}, {}
    for key in (None, 1, 2):
        held, at, tokens = [], None, 1.5
        for _, ts, seq in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            now = (ts - START).total_seconds()
            held = [x for x in held if x > now - 60]
            allowed[seq] = len(held) < 3
            held += [now] * allowed[seq]
            begin = now if at is None else max(now, at)
            tokens = min(1.5, tokens + (begin - (begin if at is None else at)) * 1.5)
            wait = max(0.0, (1 - tokens) / 1.5)
            tokens, at = tokens + wait * 1.5 - 1, begin + wait
            waits[seq] = at - now
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        limited, bucket = Q.sliding_limit(events, 3, 60), Q.token_bucket(events, 1.5)
        assert {r.seq: r.allowed for r in limited.collect()} == allowed
        assert {r.seq: pytest.approx(r.wait_seconds, abs=1e-5) for r in bucket.collect()} == waits
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for df in (limited, bucket):
        assert "FlatMapGroups" not in df._jdf.queryExecution().toString()


def test_empty_bars(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert I.with_indicators(none).count() == 0 and P.patterns(none).count() == 0
    assert K.event_driven(K.buy_and_hold(none)).count() == 0
