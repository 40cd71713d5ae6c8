"""Queries on bars, indicators and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import indicators as I
from quantloom.operators import patterns as P
from quantloom.plans.registry import query
from quantloom.sources import tables as T

STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def bars_sql(unit: str, key: str = "event_type") -> str:
    return f"""b AS (
  SELECT e.{key}::VARCHAR AS symbol, date_trunc('{unit}', e.ts)::TIMESTAMP AS ts, first(e.value ORDER BY e.ts, e.event_id) AS open, max(e.value) AS high,
         min(e.value) AS low, last(e.value ORDER BY e.ts, e.event_id) AS close, count(*) AS volume
  FROM events e GROUP BY 1, 2)"""


ORDER_BARS = """b AS (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, count(*) AS volume
  FROM orders GROUP BY 1, 2)"""
DAY, HOUR = bars_sql("day"), bars_sql("hour")
RAW = HOUR + """, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM b), raw AS (
  SELECT symbol, ts, open, CASE WHEN n % 23 = 0 THEN low - 1 ELSE high END AS high, low, close, CASE WHEN n % 29 = 0 THEN -volume ELSE volume END AS volume,
         n * 10 + CASE WHEN n % 11 = 0 THEN 25 ELSE 0 END AS seq FROM n
  UNION ALL
  SELECT symbol, ts, open, CASE WHEN n % 23 = 0 THEN low - 1 ELSE high END, low, close + 0.5, CASE WHEN n % 29 = 0 THEN -volume ELSE volume END, n * 10 + 1 FROM n WHERE n % 13 = 0)"""
W = "PARTITION BY symbol ORDER BY ts"


def show(df, *columns):
    return df.select("symbol", T.stamp("ts").alias("ts"), *columns)


BAR = ["open", "high", "low", "close", "volume"]


@query("bars_daily", f"WITH {DAY} SELECT symbol, {STAMP}, open, high, low, close, volume FROM b")
def bars_daily(spark, sf_dir):
    return show(T.daily(spark, sf_dir), *BAR)


@query("bars_hourly", f"WITH {HOUR} SELECT symbol, {STAMP}, open, high, low, close, volume FROM b")
def bars_hourly(spark, sf_dir):
    return show(T.hourly(spark, sf_dir), *BAR)


@query("bars_user", f"WITH {bars_sql('day', 'user_id')} SELECT symbol, {STAMP}, open, high, low, close, volume FROM b")
def bars_user(spark, sf_dir):
    return show(T.user_daily(spark, sf_dir), *BAR)


@query("flagship_trend_snapshot", f"""WITH {DAY}, w AS (
  SELECT symbol, ts, close, CASE WHEN count(close) OVER f5 = 5 THEN avg(close) OVER f5 END AS ma_5, CASE WHEN count(close) OVER f20 = 20 THEN avg(close) OVER f20 END AS ma_20,
         row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back
  FROM b WINDOW f5 AS ({W} ROWS 4 PRECEDING), f20 AS ({W} ROWS 19 PRECEDING))
SELECT symbol, {STAMP}, round(close, 6) AS close, round(ma_5, 6) AS ma_5, round(ma_20, 6) AS ma_20,
       CASE WHEN close > ma_5 AND ma_5 > ma_20 THEN 'up' WHEN close < ma_5 AND ma_5 < ma_20 THEN 'down' ELSE 'mixed' END AS trend FROM w WHERE back = 1""")
def flagship(spark, sf_dir):
    df = T.daily(spark, sf_dir).where(B.is_valid())
    df = B.last_n(df.select("symbol", "ts", "close", I.sma("close", 5).alias("ma_5"), I.sma("close", 20).alias("ma_20")), 1)
    trend = F.when((F.col("close") > F.col("ma_5")) & (F.col("ma_5") > F.col("ma_20")), "up").when((F.col("close") < F.col("ma_5")) & (F.col("ma_5") < F.col("ma_20")), "down").otherwise("mixed")
    return show(df, F.round("close", 6).alias("close"), F.round("ma_5", 6).alias("ma_5"), F.round("ma_20", 6).alias("ma_20"), trend.alias("trend"))


GAPS = """g AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM (SELECT DISTINCT symbol, ts FROM {0})), holes AS (
  SELECT symbol, ts, len(list_filter(range(before::DATE + 1, ts::DATE, INTERVAL 1 DAY), lambda d: isodow(d) < 6)) AS missing_days FROM g WHERE before IS NOT NULL)"""


@query("quality_logs", f"""WITH {RAW}, {GAPS.format('raw')}, s AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) AS copy, lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM raw), l AS (
  SELECT symbol, 'duplicate_timestamp' AS rule, ts FROM s WHERE copy > 1 UNION ALL
  SELECT symbol, 'invalid_ohlc', ts FROM s WHERE low > least(open, close) OR high < greatest(open, close) UNION ALL
  SELECT symbol, 'negative_volume', ts FROM s WHERE volume < 0 UNION ALL SELECT symbol, 'out_of_order', ts FROM s WHERE ts <= before)
SELECT symbol, rule, 'error' AS severity, {STAMP} FROM l UNION ALL SELECT symbol, 'missing_daily_candles', 'warning', {STAMP} FROM holes WHERE missing_days >= 5""")
def quality_logs(spark, sf_dir):
    return B.quality_logs(T.raw_hourly(spark, sf_dir)).select("symbol", "rule", "severity", T.stamp("ts").alias("ts"))


CLEAN = RAW + """, c AS (SELECT * FROM raw WHERE low <= least(open, close) AND high >= greatest(open, close) AND volume >= 0
  QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) = 1)"""


@query("bars_clean", f"WITH {CLEAN} SELECT symbol, {STAMP}, open, high, low, close, volume FROM c")
def bars_clean(spark, sf_dir):
    return show(B.clean(T.raw_hourly(spark, sf_dir)), *BAR)


@query("gap_detection", f"WITH {ORDER_BARS}, {GAPS.format('b')} SELECT symbol, {STAMP}, missing_days::INT AS missing_days FROM holes WHERE missing_days >= 2")
def gap_detection(spark, sf_dir):
    return show(B.gaps(T.order_daily(spark, sf_dir), 2), "missing_days")


def resample_sql(keys: str) -> str:
    return f"""WITH {DAY}, r AS (SELECT symbol, min(b.ts) AS ts, first(open ORDER BY b.ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY b.ts) AS close, sum(volume)::BIGINT AS volume FROM b GROUP BY symbol, {keys})
SELECT symbol, {STAMP}, open, high, low, close, volume FROM r"""


@query("resample_week", resample_sql("isoyear(b.ts), weekofyear(b.ts)"))
def resample_week(spark, sf_dir):
    return show(B.resample(T.daily(spark, sf_dir), "1w"), *BAR)


@query("resample_month", resample_sql("year(b.ts), month(b.ts)"))
def resample_month(spark, sf_dir):
    return show(B.resample(T.daily(spark, sf_dir), "1M"), *BAR)


@query("price_basis_guard", f"""WITH {DAY}, m AS (SELECT *, CASE WHEN symbol IN ('click', 'view') AND day(ts) % 7 = 0 THEN 'provider_adjusted' ELSE 'unadjusted' END AS price_basis FROM b)
SELECT symbol, count(DISTINCT price_basis) > 1 AS is_mixed, CASE WHEN count(DISTINCT price_basis) > 1 THEN 0 ELSE count(*) END AS usable_bars FROM m GROUP BY symbol""")
def price_basis_guard(spark, sf_dir):
    basis = F.when(F.col("symbol").isin("click", "view") & (F.dayofmonth("ts") % 7 == 0), "provider_adjusted").otherwise("unadjusted")
    raw = T.daily(spark, sf_dir).withColumns({"price_basis": basis, "seq": F.lit(0)})
    usable = B.clean(raw).groupBy("symbol").agg(F.count("*").alias("usable_bars"))
    mixed = B.mixed_bases(raw).withColumn("is_mixed", F.lit(True))
    return raw.select("symbol").distinct().join(mixed, "symbol", "left").join(usable, "symbol", "left").select("symbol", F.coalesce("is_mixed", F.lit(False)).alias("is_mixed"), F.coalesce("usable_bars", F.lit(0)).alias("usable_bars"))


BASE = DAY.replace("b AS", "b0 AS", 1) + f""", b AS (SELECT *, row_number() OVER ({W}) AS n FROM b0), d AS (
  SELECT *, close - lag(close) OVER w AS change, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, (high + low + close) / 3 AS tp,
         high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM b WINDOW w AS ({W})), x AS (
  SELECT *, greatest(change, 0.0) AS gain, greatest(-change, 0.0) AS loss, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS mdm,
         tp - lag(tp) OVER ({W}) AS dtp FROM d), s AS (
  SELECT *, avg(gain) OVER f14 AS sg, avg(loss) OVER f14 AS sl, avg(tr) OVER f14 AS st, avg(pdm) OVER f14 AS sp, avg(mdm) OVER f14 AS sm, avg(tr) OVER f10 AS s10,
         CASE WHEN n >= 5 THEN avg(close) OVER f5 END AS ma_5, CASE WHEN n >= 20 THEN avg(close) OVER f20 END AS ma_20, CASE WHEN n >= 20 THEN stddev_pop(close) OVER f20 END AS sd,
         CASE WHEN n >= 14 THEN sum(CASE WHEN dtp > 0 THEN tp * volume ELSE 0.0 END) OVER f14 END AS pos, CASE WHEN n >= 14 THEN sum(CASE WHEN dtp < 0 THEN tp * volume ELSE 0.0 END) OVER f14 END AS neg,
         sum(tp * volume) OVER fa / nullif(sum(volume) OVER fa, 0) AS vwap, sum(coalesce(sign(change), 0.0) * volume) OVER fa AS obv
  FROM x WINDOW f5 AS ({W} ROWS 4 PRECEDING), f10 AS ({W} ROWS 9 PRECEDING), f14 AS ({W} ROWS 13 PRECEDING), f20 AS ({W} ROWS 19 PRECEDING), fa AS ({W} ROWS UNBOUNDED PRECEDING)), r AS (
  SELECT symbol, n, close::DOUBLE AS fast, close::DOUBLE AS slow, NULL::DOUBLE AS g, NULL::DOUBLE AS l, NULL::DOUBLE AS t, NULL::DOUBLE AS p, NULL::DOUBLE AS m, NULL::DOUBLE AS t10 FROM s WHERE n = 1
  UNION ALL
  SELECT s.symbol, s.n, r.fast * (1 - 2.0 / 13) + s.close * (2.0 / 13), r.slow * (1 - 2.0 / 27) + s.close * (2.0 / 27),
         CASE WHEN s.n = 15 THEN s.sg WHEN s.n > 15 THEN (r.g * 13 + s.gain) / 14 END, CASE WHEN s.n = 15 THEN s.sl WHEN s.n > 15 THEN (r.l * 13 + s.loss) / 14 END,
         CASE WHEN s.n = 14 THEN s.st WHEN s.n > 14 THEN (r.t * 13 + s.tr) / 14 END, CASE WHEN s.n = 14 THEN s.sp WHEN s.n > 14 THEN (r.p * 13 + s.pdm) / 14 END,
         CASE WHEN s.n = 14 THEN s.sm WHEN s.n > 14 THEN (r.m * 13 + s.mdm) / 14 END, CASE WHEN s.n = 10 THEN s.s10 WHEN s.n > 10 THEN (r.t10 * 9 + s.tr) / 10 END
  FROM r JOIN s ON s.symbol = r.symbol AND s.n = r.n + 1), y AS (
  SELECT s.*, r.t AS atr_14, fast - slow AS macd, 100 * p / t AS plus_di_14, 100 * m / t AS minus_di_14, CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END AS rsi_14,
         100 * abs(p / t - m / t) / nullif(p / t + m / t, 0) AS dx, (high + low) / 2 + 3 * t10 AS ub, (high + low) / 2 - 3 * t10 AS lb, (high + low) / 2 AS mid, t10, g FROM s JOIN r USING (symbol, n)), z AS (
  SELECT *, avg(dx) OVER ({W} ROWS 13 PRECEDING) AS sdx FROM y), q AS (
  SELECT symbol, n, macd AS sig, NULL::DOUBLE AS adx, NULL::DOUBLE AS fu, NULL::DOUBLE AS fl, 0 AS dir, close AS pc FROM z WHERE n = 1
  UNION ALL
  SELECT symbol, n, sig, adx, fu, fl, CASE WHEN t10 IS NULL THEN 0 WHEN pdir = 0 THEN CASE WHEN close >= mid THEN 1 ELSE -1 END WHEN pdir = 1 THEN CASE WHEN close < fl THEN -1 ELSE 1 END ELSE CASE WHEN close > fu THEN 1 ELSE -1 END END, close FROM (
    SELECT z.symbol, z.n, q.sig * 0.8 + z.macd * 0.2 AS sig, CASE WHEN z.n = 27 THEN z.sdx WHEN z.n > 27 THEN (q.adx * 13 + z.dx) / 14 END AS adx,
           CASE WHEN q.fu IS NOT NULL AND q.pc <= q.fu THEN least(z.ub, q.fu) ELSE z.ub END AS fu, CASE WHEN q.fl IS NOT NULL AND q.pc >= q.fl THEN greatest(z.lb, q.fl) ELSE z.lb END AS fl, q.dir AS pdir, z.t10, z.close, z.mid
    FROM q JOIN z ON z.symbol = q.symbol AND z.n = q.n + 1)), ind AS (
  SELECT symbol, ts, n, open, high, low, close, volume, round(ma_5, 6) AS ma_5, round(ma_20, 6) AS ma_20, CASE WHEN g IS NOT NULL THEN round(rsi_14, 6) END AS rsi_14, round(macd, 6) AS macd, round(sig, 6) AS macd_signal, round(macd - sig, 6) AS macd_histogram,
         round(ma_20, 6) AS bb_middle, round(ma_20 + 2 * sd, 6) AS bb_upper, round(ma_20 - 2 * sd, 6) AS bb_lower, round(atr_14, 6) AS atr_14, round(plus_di_14, 6) AS plus_di_14, round(minus_di_14, 6) AS minus_di_14, round(adx, 6) AS adx_14,
         round(CASE WHEN neg = 0 THEN CASE WHEN pos > 0 THEN 100.0 END ELSE 100 - 100 / (1 + pos / neg) END, 6) AS mfi_14, round(vwap, 6) AS vwap, round(obv, 6) AS obv, round(tr, 6) AS true_range,
         round(CASE WHEN dir = 1 THEN fl WHEN dir = -1 THEN fu END, 6) AS supertrend_10_3, nullif(dir, 0)::DOUBLE AS supertrend_direction
  FROM z JOIN q USING (symbol, n))"""


def picked(*columns: str) -> str:
    return f"WITH RECURSIVE {BASE} SELECT symbol, {STAMP}, {', '.join(columns)} FROM ind"


def indicator_query(name: str, *columns: str) -> None:
    @query(name, picked(*columns))
    def run(spark, sf_dir):
        found = I.with_indicators(T.daily(spark, sf_dir))
        return show(found.withColumn("supertrend_direction", F.col("supertrend_direction").cast("double")), *columns)


for _name, _columns in {
    "macd": ["macd", "macd_signal", "macd_histogram"], "wilder_rsi": ["rsi_14"], "atr": ["atr_14"], "adx_di": ["plus_di_14", "minus_di_14", "adx_14"], "supertrend": ["supertrend_10_3", "supertrend_direction"], "indicators_all": I.INDICATORS,
}.items():
    indicator_query(_name, *_columns)


def window_query(name: str, *columns: str) -> None:
    @query(name, picked(*columns))
    def run(spark, sf_dir):
        df = I.windows(T.daily(spark, sf_dir)).withColumnRenamed("tr", "true_range")
        return show(df, *[F.round(c, 6).alias(c) for c in columns])


for _name, _columns in {"ma": ["ma_5", "ma_20"], "bollinger": ["bb_middle", "bb_upper", "bb_lower"], "true_range": ["true_range"], "mfi": ["mfi_14"], "vwap": ["vwap"], "obv": ["obv"]}.items():
    window_query(_name, *_columns)


@query("support_resistance", f"WITH {DAY} SELECT symbol, min(low) AS support, max(high) AS resistance FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b) WHERE k <= 20 GROUP BY symbol")
def support_resistance(spark, sf_dir):
    return I.support_resistance(T.daily(spark, sf_dir))


EXTREMA = f"""e AS (SELECT *, coalesce(high >= greatest(lag(high) OVER w, lag(high, 2) OVER w, lead(high) OVER w, lead(high, 2) OVER w) AND lag(high, 2) OVER w IS NOT NULL AND lead(high, 2) OVER w IS NOT NULL, false) AS is_top,
  coalesce(low <= least(lag(low) OVER w, lag(low, 2) OVER w, lead(low) OVER w, lead(low, 2) OVER w) AND lag(low, 2) OVER w IS NOT NULL AND lead(low, 2) OVER w IS NOT NULL, false) AS is_bottom, row_number() OVER w - 1 AS i FROM b WINDOW w AS ({W}))"""


@query("local_extrema", f"WITH {HOUR}, {EXTREMA} SELECT symbol, {STAMP}, is_top, is_bottom FROM e")
def local_extrema(spark, sf_dir):
    return show(I.local_extrema(T.hourly(spark, sf_dir)), "is_top", "is_bottom")


PRIOR = f"p AS (SELECT *, CASE WHEN count(close) OVER f = 20 THEN max(high) OVER f END AS prior_high, CASE WHEN count(close) OVER f = 20 THEN min(low) OVER f END AS prior_low FROM b WINDOW f AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"


@query("prior_range", f"WITH {HOUR}, {PRIOR} SELECT symbol, {STAMP}, prior_high, prior_low FROM p")
def prior_range(spark, sf_dir):
    return show(I.prior_range(T.hourly(spark, sf_dir)), "prior_high", "prior_low")


PATTERNS = f"""{HOUR}, {EXTREMA}, {PRIOR}, c AS (
  SELECT *, high - low AS span, abs(close - open) AS body, greatest(abs(close - open), 0.02 * (high - low)) AS eb, high - greatest(open, close) AS above, least(open, close) - low AS below,
         lag(open) OVER ({W}) AS po, lag(close) OVER ({W}) AS pc FROM p), k AS (
  SELECT symbol, ts, 'candlestick' AS family, 'doji' AS name, 'neutral' AS direction, 0.68 AS confidence FROM c WHERE span > 0 AND body / span <= 0.10 UNION ALL
  SELECT symbol, ts, 'candlestick', 'hammer', 'upward', 0.72 FROM c WHERE span > 0 AND body / span BETWEEN 0.05 AND 0.35 AND below >= 2 * eb AND above <= eb AND greatest(open, close) >= low + 0.6 * span UNION ALL
  SELECT symbol, ts, 'candlestick', 'shooting_star', 'downward', 0.72 FROM c WHERE span > 0 AND body / span BETWEEN 0.05 AND 0.35 AND above >= 2 * eb AND below <= eb AND least(open, close) <= low + 0.4 * span UNION ALL
  SELECT symbol, ts, 'candlestick', 'bullish_engulfing', 'upward', 0.78 FROM c WHERE span > 0 AND pc < po AND close > open AND open <= pc AND close >= po UNION ALL
  SELECT symbol, ts, 'candlestick', 'bearish_engulfing', 'downward', 0.78 FROM c WHERE span > 0 AND pc > po AND close < open AND open >= pc AND close <= po), o AS (
  SELECT symbol, ts, 'chart' AS family, 'range_breakout_up' AS name, 'upward' AS direction, round(least(0.9, 0.68 + (close - prior_high) / greatest(prior_high - prior_low, abs(close) * 0.001) * 2), 4) AS confidence FROM c WHERE close > prior_high UNION ALL
  SELECT symbol, ts, 'chart', 'range_breakout_down', 'downward', round(least(0.9, 0.68 + (prior_low - close) / greatest(prior_high - prior_low, abs(close) * 0.001) * 2), 4) FROM c WHERE close < prior_low), t AS (
  SELECT r.symbol, l.i AS li, r.i AS ri, true AS top, abs(l.high - r.high) / ((l.high + r.high) / 2) AS diff, (SELECT min(m.low) FROM e m WHERE m.symbol = r.symbol AND m.i > l.i AND m.i < r.i) AS neck
  FROM e r JOIN e l ON l.symbol = r.symbol AND r.i - l.i BETWEEN 5 AND 35 AND l.is_top AND r.is_top UNION ALL
  SELECT r.symbol, l.i, r.i, false, abs(l.low - r.low) / ((l.low + r.low) / 2), (SELECT max(m.high) FROM e m WHERE m.symbol = r.symbol AND m.i > l.i AND m.i < r.i)
  FROM e r JOIN e l ON l.symbol = r.symbol AND r.i - l.i BETWEEN 5 AND 35 AND l.is_bottom AND r.is_bottom), u AS (
  SELECT e.symbol, e.ts, t.top, diff FROM t JOIN e ON e.symbol = t.symbol AND e.i BETWEEN t.ri + 2 AND t.li + 57 AND e.i >= 11 AND diff <= 0.03 AND CASE WHEN t.top THEN e.close < neck ELSE e.close > neck END
  QUALIFY row_number() OVER (PARTITION BY e.symbol, e.ts, t.top ORDER BY t.ri DESC, t.li DESC) = 1), v AS (
  SELECT symbol, ts, 'chart' AS family, CASE WHEN top THEN 'double_top_confirmed' ELSE 'double_bottom_confirmed' END AS name, CASE WHEN top THEN 'downward' ELSE 'upward' END AS direction, round(least(0.9, 0.76 + (0.03 - diff) * 3), 4) AS confidence FROM u), every AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY confidence DESC, name)::INT AS rank FROM (SELECT * FROM k UNION ALL SELECT * FROM o UNION ALL SELECT * FROM v))"""
PATTERN = ["name", "direction", "confidence"]


def pattern_sql(source: str) -> str:
    return f"WITH {PATTERNS} SELECT symbol, {STAMP}, name, direction, confidence::DOUBLE AS confidence FROM {source}"


def pattern_query(name: str, sql: str, keep: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        return show(P.patterns(T.hourly(spark, sf_dir)).where(keep), *PATTERN)


pattern_query("candlestick_patterns", pattern_sql("k"), "family = 'candlestick'")
pattern_query("range_breakout", pattern_sql("o"), "name like 'range%'")
pattern_query("double_top_bottom", pattern_sql("v"), "name like 'double%'")


@query("pattern_rank", f"WITH {PATTERNS} SELECT symbol, {STAMP}, rank, name, direction, confidence::DOUBLE AS confidence FROM every")
def pattern_rank(spark, sf_dir):
    return show(P.patterns(T.hourly(spark, sf_dir)), "rank", *PATTERN)
