"""Queries on backtests and corporate actions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quantloom.operators import actions as A
from quantloom.operators import backtest as K
from quantloom.operators import indicators as I
from quantloom.operators import scoring as S
from quantloom.plans.market import BASE, DAY, HOUR, PATTERNS, STAMP, W, bars_sql, show
from quantloom.plans.registry import query
from quantloom.sources import tables as T

CONFIG = K.Config()
BUY, SELL = CONFIG.commission + CONFIG.slippage, CONFIG.commission + CONFIG.tax + CONFIG.slippage
CROSS = f"""sig AS (SELECT *, CASE WHEN count(close) OVER f20 = 20 AND avg(close) OVER f5 > avg(close) OVER f20 THEN 1 ELSE 0 END AS signal FROM b WINDOW f5 AS ({W} ROWS 4 PRECEDING), f20 AS ({W} ROWS 19 PRECEDING))"""
HOLD = "sig AS (SELECT *, 1 AS signal FROM b)"


def curve_sql(signal: str = "sig", out: str = "cur") -> str:
    return f"""{out}0 AS (SELECT *, coalesce(lag(signal) OVER w, 0) AS position, lag(close) OVER w AS pc, lead(ts) OVER w IS NULL AS is_last FROM {signal} WINDOW w AS ({W})), {out}1 AS (
  SELECT *, coalesce(lag(position) OVER ({W}), 0) AS was FROM {out}0), {out}2 AS (
  SELECT *, (1 + was * coalesce(open / pc - 1, 0.0)) * (1 + position * (close / open - 1)) - 1 - greatest(position - was, 0) * {BUY}::DOUBLE - greatest(was - position, 0) * {SELL}::DOUBLE
         - CASE WHEN is_last AND position = 1 THEN {SELL}::DOUBLE ELSE 0.0 END AS daily_return FROM {out}1), {out} AS (
  SELECT *, {CONFIG.initial_capital} * product(1 + daily_return) OVER ({W} ROWS UNBOUNDED PRECEDING) AS equity FROM {out}2)"""


def trade_sql(source: str = "cur", out: str = "tr") -> str:
    return f"""{out} AS (WITH q AS (SELECT *, coalesce(lag(equity) OVER ({W}), {CONFIG.initial_capital}) AS before FROM {source})
  SELECT symbol, ts, 0 AS seq, CASE WHEN position > was THEN 'buy' ELSE 'sell' END AS side, open * CASE WHEN position > was THEN 1 + {CONFIG.slippage}::DOUBLE ELSE 1 - {CONFIG.slippage}::DOUBLE END AS execution_price,
         before * CASE WHEN position > was THEN {CONFIG.commission}::DOUBLE ELSE {CONFIG.commission + CONFIG.tax}::DOUBLE END AS cost, CASE WHEN position > was THEN 1 ELSE 0 END AS position_after FROM q WHERE position != was
  UNION ALL SELECT symbol, ts, 1, 'sell', close * (1 - {CONFIG.slippage}::DOUBLE), before * {CONFIG.commission + CONFIG.tax}::DOUBLE, 0 FROM q WHERE is_last AND position = 1)"""


def metric_sql(curve: str = "cur", made: str = "tr", out: str = "met") -> str:
    return f"""{out} AS (WITH p AS (SELECT *, equity / greatest(max(equity) OVER ({W} ROWS UNBOUNDED PRECEDING), {CONFIG.initial_capital}) - 1 AS dd FROM {curve}), a AS (
    SELECT symbol, count(*) AS n, last(equity ORDER BY ts) AS final, min(dd) AS dd, avg(daily_return) AS mean, stddev_samp(daily_return) AS sd FROM p GROUP BY symbol), f AS (
    SELECT symbol, side, lead(side) OVER o AS ns, (lead(execution_price) OVER o * {1 - CONFIG.commission - CONFIG.tax}::DOUBLE) / (execution_price * {1 + CONFIG.commission}::DOUBLE) - 1 AS won FROM {made} WINDOW o AS (PARTITION BY symbol ORDER BY ts, seq)), c AS (
    SELECT symbol, count(*) AS trade_count, avg(CASE WHEN side = 'buy' AND ns = 'sell' THEN CASE WHEN won > 0 THEN 1.0 ELSE 0.0 END END) AS win_rate FROM f GROUP BY symbol)
  SELECT a.symbol, round(final / {CONFIG.initial_capital} - 1, 8) AS total_return, round(pow(final / {CONFIG.initial_capital}, 1 / greatest((n - 1) / 252.0::DOUBLE, 1 / 252.0::DOUBLE)) - 1, 8) AS cagr, round(dd, 8) AS max_drawdown,
         round(CASE WHEN sd > 0 THEN mean / sd * sqrt(252.0::DOUBLE) ELSE 0.0 END, 6) AS sharpe_ratio, round(coalesce(win_rate, 0.0), 6) AS win_rate, coalesce(trade_count, 0) AS trade_count, round(final, 4) AS final_equity FROM a LEFT JOIN c USING (symbol))"""


def crossed(spark, sf_dir, bars=None):
    return K.ma_cross(bars if bars is not None else T.hourly(spark, sf_dir))




def curve_show(df):
    return show(df, F.round(F.col("equity") / CONFIG.initial_capital, 6).alias("growth"), F.round("daily_return", 6).alias("daily_return"), "position")


def curve_pick(ctes: str) -> str:
    return f"WITH {ctes} SELECT symbol, {STAMP}, round(equity / {CONFIG.initial_capital}, 6) AS growth, round(daily_return, 6) AS daily_return, position FROM cur"


@query("bt_buy_hold", curve_pick(f"{DAY}, {HOLD}, {curve_sql()}"))
def bt_buy_hold(spark, sf_dir):
    return curve_show(K.vectorized(K.buy_and_hold(T.daily(spark, sf_dir)), CONFIG))


@query("bt_ma_cross", f"WITH {HOUR}, {CROSS} SELECT symbol, {STAMP}, signal FROM sig")
def bt_ma_cross(spark, sf_dir):
    return show(crossed(spark, sf_dir), "signal")


DAY_CROSS = f"{DAY}, {CROSS}, {curve_sql()}, {trade_sql()}"


@query("bt_equity", curve_pick(f"{DAY}, {CROSS}, {curve_sql()}"))
def bt_equity(spark, sf_dir):
    return curve_show(K.vectorized(crossed(spark, sf_dir, T.daily(spark, sf_dir)), CONFIG))


@query("bt_trades", f"WITH {DAY_CROSS} SELECT symbol, {STAMP}, seq, side, round(execution_price, 6) AS execution_price, round(cost, 2) AS cost, position_after FROM tr")
def bt_trades(spark, sf_dir):
    curve = K.vectorized(crossed(spark, sf_dir, T.daily(spark, sf_dir)), CONFIG)
    return show(K.trades(curve, CONFIG), "seq", "side", F.round("execution_price", 6).alias("execution_price"), F.round("cost", 2).alias("cost"), "position_after")


METRICS = {"total_return": 6, "max_drawdown": 6, "sharpe_ratio": 4, "win_rate": 4}


def metric_pick(source: str, key: str = "symbol") -> str:
    return f"SELECT {key}, round(ln(greatest(1 + cagr, 0.001)), 4) AS log_growth, " + ", ".join(f"round({m}, {n}) AS {m}" for m, n in METRICS.items()) + f", trade_count FROM {source}"


def metric_show(df, *keys):
    return df.select(*keys, F.round(F.ln(F.greatest(1 + F.col("cagr"), F.lit(0.001))), 4).alias("log_growth"), *[F.round(m, n).alias(m) for m, n in METRICS.items()], "trade_count")


@query("bt_metrics", f"WITH {DAY_CROSS}, {metric_sql()} {metric_pick('met')}")
def bt_metrics(spark, sf_dir):
    curve = K.vectorized(crossed(spark, sf_dir, T.daily(spark, sf_dir)), CONFIG)
    return metric_show(K.metrics(curve, K.trades(curve, CONFIG), CONFIG), "symbol")


@query("curve_downsample", f"""WITH {HOUR}, {HOLD}, {curve_sql()}, d AS (SELECT symbol, ts, round(equity / {CONFIG.initial_capital} * 100, 6) AS normalized_equity, row_number() OVER ({W}) - 1 AS n, count(*) OVER (PARTITION BY symbol) - 1 AS last FROM cur)
SELECT symbol, {STAMP}, round(normalized_equity, 4) AS normalized_equity FROM d WHERE last < 120 OR n IN (SELECT round_even(i * d.last / 119.0::DOUBLE, 0) FROM range(120) r(i))""")
def curve_downsample(spark, sf_dir):
    curve = K.vectorized(K.buy_and_hold(T.hourly(spark, sf_dir)), CONFIG)
    return show(K.downsample(curve, CONFIG.initial_capital), F.round("normalized_equity", 4).alias("normalized_equity"))


PATTERN_SIGNAL = f"""{PATTERNS}, sd AS (SELECT symbol, ts, first(CASE WHEN direction = 'upward' THEN 1 ELSE 0 END ORDER BY rank) AS side FROM every WHERE direction != 'neutral' AND confidence >= 0.68 GROUP BY 1, 2), psig AS (
  SELECT b.*, coalesce(last_value(side IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS UNBOUNDED PRECEDING), 0) AS signal FROM b LEFT JOIN sd USING (symbol, ts))"""


@query("pattern_strategy", f"WITH {PATTERN_SIGNAL} SELECT symbol, {STAMP}, signal FROM psig")
def pattern_strategy(spark, sf_dir):
    return show(K.pattern_reference(T.hourly(spark, sf_dir)), "signal")


COMPARE = f"""{PATTERN_SIGNAL}, {CROSS}, hold AS (SELECT *, 1 AS signal FROM b), {curve_sql('psig', 'pc')}, {trade_sql('pc', 'pt')}, {metric_sql('pc', 'pt', 'pm')}, {curve_sql()}, {trade_sql()}, {metric_sql()},
  {curve_sql('hold', 'hc')}, {trade_sql('hc', 'ht')}, {metric_sql('hc', 'ht', 'hm')}, al AS (SELECT *, 'pattern_reference' AS strategy FROM pm UNION ALL SELECT *, 'ma_cross' FROM met UNION ALL SELECT *, 'buy_and_hold' FROM hm)"""


@query("strategy_compare", f"""WITH {COMPARE} SELECT al.symbol, strategy, round(al.total_return, 4) AS total_return, al.trade_count, round(al.total_return - hm.total_return, 4) AS total_return_delta, round(al.sharpe_ratio - hm.sharpe_ratio, 4) AS sharpe_ratio_delta
FROM al JOIN hm USING (symbol)""")
def strategy_compare(spark, sf_dir):
    signals = K.signals(T.hourly(spark, sf_dir), {"ma_cross": K.ma_cross, "pattern_reference": K.pattern_reference})
    out = K.compare_strategies(signals, "buy_and_hold", CONFIG)
    return out.select("symbol", "strategy", F.round("total_return", 4).alias("total_return"), "trade_count", F.round("total_return_delta", 4).alias("total_return_delta"), F.round("sharpe_ratio_delta", 4).alias("sharpe_ratio_delta"))


FOLDS = f"""{HOUR}, {CROSS}, nn AS (SELECT *, row_number() OVER ({W}) - 1 AS n, count(*) OVER (PARTITION BY symbol) AS total FROM sig), fo AS (
  SELECT nn.*, k, 60 + (k - 1) * ((total - 60) // 3) AS first FROM nn, range(1, 4) r(k) WHERE n >= (k - 1) * ((total - 60) // 3) AND n < CASE WHEN k = 3 THEN total ELSE 60 + k * ((total - 60) // 3) END), fs AS (
  SELECT symbol || '#' || k AS symbol, ts, open, high, low, close, volume, CASE WHEN n < first THEN 0 ELSE signal END AS signal, n >= first AS is_test FROM fo), {curve_sql('fs')}, {trade_sql()}, ct AS (SELECT * FROM cur WHERE is_test), {metric_sql('ct')},
  wf AS (SELECT split_part(symbol, '#', 1) AS series, split_part(symbol, '#', 2)::INT AS fold, * EXCLUDE (symbol) FROM met)"""


@query("walk_forward", f"WITH {FOLDS} {metric_pick('wf', 'series, fold')}")
def walk_forward(spark, sf_dir):
    return metric_show(K.walk_forward(crossed(spark, sf_dir), CONFIG), "series", "fold")


@query("walk_forward_stability", f"""WITH {FOLDS}, a AS (SELECT series, avg(total_return) AS mean, avg(CASE WHEN total_return > 0 THEN 1.0 ELSE 0.0 END) AS share, sum(trade_count)::BIGINT AS trade_count FROM wf GROUP BY series)
SELECT series, round(mean, 6) AS mean_total_return, round(share, 6) AS profitable_fold_ratio, trade_count, CASE WHEN share >= 2.0 / 3 AND mean > 0 THEN 'consistent_positive' WHEN share <= 1.0 / 3 AND mean < 0 THEN 'consistent_negative' ELSE 'mixed' END AS stability FROM a""")
def walk_forward_stability(spark, sf_dir):
    return K.stability(K.walk_forward(crossed(spark, sf_dir), CONFIG)).select("series", "mean_total_return", "profitable_fold_ratio", "trade_count", "stability")


EVENT_CONFIG = K.Config(initial_capital=5_000.0, participation=0.5)
C, X, L = EVENT_CONFIG.commission, EVENT_CONFIG.tax, EVENT_CONFIG.slippage
EVENT = f"""{DAY}, {CROSS}, en AS (SELECT *, row_number() OVER ({W}) AS n, count(*) OVER (PARTITION BY symbol) AS total FROM sig), ev AS (
  SELECT symbol, n, ts, {EVENT_CONFIG.initial_capital}::DOUBLE AS cash, 0::BIGINT AS held, CASE WHEN signal = 1 AND total > 1 THEN 1 ELSE 0 END AS pending, {EVENT_CONFIG.initial_capital}::DOUBLE AS equity, 0::BIGINT AS wanted, 0::BIGINT AS filled, 0 AS act, 0 AS forced FROM en WHERE n = 1
  UNION ALL
  SELECT symbol, n, ts, cash3, held3, CASE WHEN signal != CASE WHEN held2 > 0 THEN 1 ELSE 0 END AND n < total THEN CASE WHEN signal = 1 THEN 1 ELSE -1 END ELSE 0 END, cash3 + held3 * close, wanted, filled, pending, forced FROM (
    SELECT *, CASE WHEN n = total AND held2 > 0 THEN 1 ELSE 0 END AS forced, CASE WHEN n = total AND held2 > 0 THEN cash2 + held2 * close * {1 - L}::DOUBLE * {1 - C - X}::DOUBLE ELSE cash2 END AS cash3, CASE WHEN n = total THEN 0 ELSE held2 END AS held3 FROM (
      SELECT *, CASE pending WHEN 1 THEN held + filled WHEN -1 THEN held - filled ELSE held END AS held2,
             CASE pending WHEN 1 THEN cash - filled * open * {1 + L}::DOUBLE * {1 + C}::DOUBLE WHEN -1 THEN cash + filled * open * {1 - L}::DOUBLE * {1 - C - X}::DOUBLE ELSE cash END AS cash2 FROM (
        SELECT *, least(wanted, floor(volume * {EVENT_CONFIG.participation}::DOUBLE)::BIGINT) AS filled FROM (
          SELECT en.symbol, en.n, en.ts, en.open, en.close, en.volume, en.signal, en.total, ev.cash, ev.held, ev.pending,
                 CASE ev.pending WHEN 1 THEN floor(ev.cash / (en.open * {1 + L}::DOUBLE * {1 + C}::DOUBLE))::BIGINT WHEN -1 THEN ev.held ELSE 0 END AS wanted
          FROM ev JOIN en ON en.symbol = ev.symbol AND en.n = ev.n + 1)))))"""


def event_curve(spark, sf_dir):
    return K.event_driven(crossed(spark, sf_dir, T.daily(spark, sf_dir)), EVENT_CONFIG)


@query("bt_event", f"WITH RECURSIVE {EVENT} SELECT symbol, {STAMP}, round(equity, 4) AS equity, CASE WHEN held > 0 THEN 1 ELSE 0 END AS position FROM ev")
def bt_event(spark, sf_dir):
    return show(event_curve(spark, sf_dir), F.round("equity", 4).alias("equity"), "position")


@query("bt_event_counts", f"""WITH RECURSIVE {EVENT} SELECT symbol, sum(CASE WHEN act != 0 AND filled > 0 THEN 1 ELSE 0 END + forced)::BIGINT AS fills, count(*) FILTER (act != 0 AND filled > 0 AND filled < wanted) AS partial_fills, count(*) FILTER (act != 0 AND filled <= 0) AS rejected FROM ev GROUP BY symbol""")
def bt_event_counts(spark, sf_dir):
    kind = lambda k: F.count_if(F.exists("events", lambda e: e.event_type == k))
    fills = F.sum(F.size(F.filter("events", lambda e: e.event_type == "fill"))).cast("bigint")
    return event_curve(spark, sf_dir).groupBy("symbol").agg(fills.alias("fills"), kind("partial_fill").alias("partial_fills"), kind("rejected").alias("rejected"))


@query("engine_compare", f"""WITH RECURSIVE {EVENT}, {curve_sql().replace(str(CONFIG.initial_capital), str(EVENT_CONFIG.initial_capital))}
SELECT e.symbol, round(e.equity, 3) AS event_equity, round(v.equity, 3) AS vectorized_equity, round(e.equity - v.equity, 3) AS difference
FROM (SELECT symbol, last(equity ORDER BY ts) AS equity FROM ev GROUP BY symbol) e JOIN (SELECT symbol, last(equity ORDER BY ts) AS equity FROM cur GROUP BY symbol) v USING (symbol)""")
def engine_compare(spark, sf_dir):
    signals = crossed(spark, sf_dir, T.daily(spark, sf_dir))
    last = lambda df, name: df.groupBy("symbol").agg(F.max_by("equity", "ts").alias(name))
    both = last(K.event_driven(signals, EVENT_CONFIG), "e").join(last(K.vectorized(signals, EVENT_CONFIG), "v"), "symbol")
    return both.select("symbol", F.round("e", 3).alias("event_equity"), F.round("v", 3).alias("vectorized_equity"), F.round(F.col("e") - F.col("v"), 3).alias("difference"))


TECH = f"""{BASE}, sc AS (SELECT symbol, ts, close, [CASE WHEN rsi_14 IS NOT NULL THEN greatest(least(CASE WHEN rsi_14 BETWEEN 30 AND 70 THEN 50 + (rsi_14 - 50) * 1.25 WHEN rsi_14 > 70 THEN 75 - (rsi_14 - 70) * 2 ELSE 25 + rsi_14 / 30 * 12.5 END, 80), 20) END,
  CASE WHEN macd_histogram IS NOT NULL AND close > 0 THEN 50 + 30 * tanh(macd_histogram / (close * 0.005)) END,
  CASE WHEN ma_5 IS NOT NULL AND ma_20 IS NOT NULL THEN CASE WHEN close > ma_5 AND ma_5 > ma_20 THEN 80 WHEN close < ma_5 AND ma_5 < ma_20 THEN 20 ELSE 50 END END,
  CASE WHEN adx_14 IS NOT NULL AND plus_di_14 IS NOT NULL AND minus_di_14 IS NOT NULL THEN CASE WHEN adx_14 < 25 THEN 50 WHEN plus_di_14 > minus_di_14 THEN 75 ELSE 25 END END,
  CASE WHEN mfi_14 IS NOT NULL THEN CASE WHEN mfi_14 BETWEEN 45 AND 70 THEN 65 WHEN mfi_14 > 80 OR mfi_14 < 20 THEN 35 ELSE 50 END END,
  CASE WHEN supertrend_direction IS NOT NULL THEN CASE WHEN supertrend_direction > 0 THEN 70 ELSE 30 END END]::DOUBLE[] AS parts FROM ind), scored AS (SELECT *, round(list_avg(parts), 4) AS technical_score FROM sc)"""


@query("technical_score", f"WITH RECURSIVE {TECH} SELECT symbol, {STAMP}, round(technical_score, 3) AS technical_score FROM scored")
def technical_score(spark, sf_dir):
    return show(S.technical(I.with_indicators(T.daily(spark, sf_dir))), F.round("technical_score", 3).alias("technical_score"))


@query("technical_strategy", f"WITH RECURSIVE {TECH} SELECT symbol, {STAMP}, CASE WHEN technical_score >= 65 THEN 1 ELSE 0 END AS signal FROM scored")
def technical_strategy(spark, sf_dir):
    return show(K.technical_score(S.technical(I.with_indicators(T.daily(spark, sf_dir)))), "signal")


AS_OF = datetime(2024, 1, 21)
ACTIONS = """ca0 AS (SELECT user_id::VARCHAR AS symbol, 'feed' AS source, event_id::VARCHAR AS event_id, 1 AS revision, date_trunc('day', ts)::TIMESTAMP AS effective_at, (date_trunc('day', ts) - to_days((1 + event_id % 5)::INT))::TIMESTAMP AS known_at,
    (CASE event_id % 3 WHEN 0 THEN 0.999 WHEN 1 THEN 0.998 ELSE 1.002 END)::DECIMAL(24,12) AS price_factor, (CASE event_id % 3 WHEN 0 THEN 1.001 WHEN 1 THEN 1.002 ELSE 0.998 END)::DECIMAL(24,12) AS volume_factor, 'confirmed' AS status, event_id AS k FROM events), ca AS (
  SELECT * EXCLUDE (k) FROM ca0 UNION ALL SELECT symbol, source, event_id, 2, effective_at, known_at + INTERVAL 2 DAY, (price_factor * 1.1)::DECIMAL(24,12), volume_factor, CASE WHEN k % 8 = 0 THEN 'cancelled' ELSE 'confirmed' END FROM ca0 WHERE k % 4 = 0),
  vis AS (SELECT * FROM ca WHERE known_at <= TIMESTAMP '2024-01-21' AND effective_at <= TIMESTAMP '2024-01-21'), lat AS (SELECT * FROM vis QUALIFY row_number() OVER (PARTITION BY symbol, source, event_id ORDER BY known_at DESC, revision DESC) = 1), con AS (SELECT * FROM lat WHERE status = 'confirmed')"""
FACTOR = "round(price_factor::DOUBLE, 6) AS price_factor"


@query("latest_revision", f"WITH {ACTIONS} SELECT symbol, event_id, revision, status, {FACTOR} FROM con")
def latest_revision(spark, sf_dir):
    return A.as_of(T.corporate_actions(spark, sf_dir), AS_OF).select("symbol", "event_id", "revision", "status", F.round(F.col("price_factor").cast("double"), 6).alias("price_factor"))


USER_DAY = bars_sql("day", "user_id")


@query("actions_asof", f"WITH {USER_DAY}, {ACTIONS} SELECT symbol, event_id, strftime(effective_at, '%Y-%m-%d') AS effective_on FROM con WHERE EXISTS (SELECT 1 FROM b WHERE b.symbol = con.symbol AND b.ts < con.effective_at)")
def actions_asof(spark, sf_dir):
    return A.affecting(T.corporate_actions(spark, sf_dir), T.user_daily(spark, sf_dir), AS_OF).select("symbol", "event_id", F.date_format("effective_at", "yyyy-MM-dd").alias("effective_on"))


def adjust_sql(chosen: str, hit: str, inverse: bool) -> str:
    f = lambda c: f"(SELECT coalesce(product({'1 / ' if inverse else ''}{c}::DOUBLE), 1) FROM {chosen} c WHERE c.symbol = b.symbol AND {hit})"
    return f"""WITH {USER_DAY}, {ACTIONS}, bad AS (SELECT symbol, event_id FROM vis GROUP BY ALL HAVING count(*) > 1 OR max((known_at > effective_at)::INT) = 1), fwd AS (SELECT * FROM vis WHERE status = 'confirmed' AND (symbol, event_id) NOT IN (SELECT (symbol, event_id) FROM bad)),
  j AS (SELECT b.*, {f('price_factor')} AS pf, {f('volume_factor')} AS vf FROM b)
SELECT symbol, {STAMP}, round(close * pf, 4) AS close, round(volume * vf, 0)::BIGINT AS volume FROM j"""


def adjusted_show(df):
    return show(df, F.round(F.col("close").cast("double"), 4).alias("close"), "volume")


def near_bars(spark, sf_dir):
    return T.user_daily(spark, sf_dir).withColumn("price_basis", F.lit("unadjusted"))


@query("adjust_backward", adjust_sql("con", "b.ts < c.effective_at", False))
def adjust_backward(spark, sf_dir):
    return adjusted_show(A.adjust_backward(near_bars(spark, sf_dir), T.corporate_actions(spark, sf_dir), AS_OF))


@query("adjust_forward", adjust_sql("fwd", "b.ts >= c.effective_at", True))
def adjust_forward(spark, sf_dir):
    return adjusted_show(A.adjust_forward(near_bars(spark, sf_dir), T.corporate_actions(spark, sf_dir), AS_OF, strict=False))


@query("rejected_actions", f"WITH {ACTIONS} SELECT symbol, event_id, count(*) AS revisions FROM vis GROUP BY ALL HAVING count(*) > 1 OR max((known_at > effective_at)::INT) = 1")
def rejected_actions(spark, sf_dir):
    return A.revised_or_late(T.corporate_actions(spark, sf_dir), AS_OF).select("symbol", "event_id", "revisions")


@query("candidate_factors", """SELECT p_partkey AS id, round(1 / (1 + p_size / 10.0::DOUBLE), 9) AS bonus_price_factor, round(1 + p_size / 10.0::DOUBLE, 9) AS bonus_volume_factor,
  CASE WHEN p_size % 7 > 0 AND p_size % 7 < p_size THEN round(p_size / (p_size % 7)::DOUBLE, 9) END AS reduction_price_factor FROM part""")
def candidate_factors(spark, sf_dir):
    part = T.table(spark, sf_dir, "part")
    ratio = (F.col("p_size").cast("decimal(10,2)") / F.lit(10).cast("decimal(4,1)")).cast("decimal(20,10)")
    price, volume = A.bonus_factors(ratio)
    reduced, _ = A.reduction_factors(F.col("p_size").cast("decimal(20,6)"), (F.col("p_size") % 7).cast("decimal(20,6)"))
    return part.select(F.col("p_partkey").alias("id"), *[F.round(c.cast("double"), 9).alias(n) for c, n in ((price, "bonus_price_factor"), (volume, "bonus_volume_factor"), (reduced, "reduction_price_factor"))])


@query("revision_groups", r"""WITH c AS (SELECT 'feed' AS source, c_nationkey::VARCHAR AS symbol, 'split' AS action_type, o_orderdate::DATE AS anchor, CASE WHEN o_orderkey % 3 = 0 THEN '[기재정정] ' ELSE '' END || 'Report  ' || o_orderpriority AS report_name, o_orderkey::VARCHAR AS receipt_no, (o_orderdate + to_days((o_orderkey % 9)::INT))::DATE AS filed_on,
  o_orderkey % 5 = 0 AS superseded_hint, o_orderkey % 3 = 0 AS correction_hint FROM orders JOIN customer ON o_custkey = c_custkey), k AS (
  SELECT *, lower(regexp_replace(regexp_replace(report_name, '^\s*(?:\[[^\]]*정정[^\]]*\]\s*)+', ''), '\s+', '', 'g')) AS title FROM c), g AS (
  SELECT source, symbol, action_type, title, anchor, list(receipt_no ORDER BY filed_on, receipt_no) AS r, bool_or(superseded_hint) AS s, bool_or(correction_hint) AS c FROM k GROUP BY ALL)
SELECT 'candidate:' || substr(sha256(concat_ws('|', source, symbol, action_type, title, anchor::VARCHAR)), 1, 20) AS group_hint, symbol, strftime(anchor, '%Y-%m-%d') AS anchor_date, array_to_string(r, ',') AS receipts, CASE WHEN len(r) = 1 THEN 'isolated' WHEN s AND c THEN 'likely_correction' ELSE 'ambiguous_multiple_receipts' END AS confidence FROM g""")
def revision_groups(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").join(T.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    candidates = orders.select(F.lit("feed").alias("source"), F.col("c_nationkey").cast("string").alias("symbol"), F.lit("split").alias("action_type"), F.to_date("o_orderdate").alias("decision_date"), F.lit(None).cast("date").alias("record_date"),
                               F.concat(F.when(key % 3 == 0, "[기재정정] ").otherwise(""), F.lit("Report  "), F.col("o_orderpriority")).alias("report_name"), key.cast("string").alias("receipt_no"), F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 9 as int))").alias("filed_on"), (key % 5 == 0).alias("superseded_hint"), (key % 3 == 0).alias("correction_hint"))
    return A.revision_groups(candidates).select("group_hint", "symbol", F.date_format("anchor_date", "yyyy-MM-dd").alias("anchor_date"), F.array_join("receipt_nos", ",").alias("receipts"), "confidence")
