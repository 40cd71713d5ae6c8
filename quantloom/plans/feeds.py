"""Queries on feed payloads and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import text as X
from quantloom.plans.market import HOUR, STAMP, show
from quantloom.plans.registry import query
from quantloom.sources import feeds as D
from quantloom.sources import tables as T
from quantloom.streaming import quotes as Q


def raw_frames(spark, sf_dir):
    """Tick frames of two layouts; every 50th is cut short."""
    e = T.table(spark, sf_dir, "events")
    v, k = F.col("value").cast("decimal(20,2)").cast("string"), F.col("event_id")
    day, time = F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HHmmss")
    cells = lambda n, put: F.array(*[put.get(i, F.lit("")) for i in range(n)])
    home = cells(46, {0: F.col("event_type"), 1: time, 2: v, 3: F.when(k % 2 == 0, "5").otherwise("2"), 4: v, 5: F.lit("1.5"), 13: (k % 1000).cast("string"), 33: day})
    away = cells(25, {0: F.concat(F.lit("D"), F.col("event_type")), 3: day, 4: time, 10: v, 11: F.when(k % 2 == 0, "4").otherwise("2"), 12: v, 13: F.lit("2.5"), 19: (k % 1000).cast("string")})
    domestic = k % 3 != 0
    body = F.when(domestic, F.array_join(F.slice(home, 1, F.when(k % 50 == 0, 20).otherwise(46)), "^")).otherwise(F.array_join(away, "^"))
    return e.select("event_id", F.concat(F.lit("0|"), F.when(domestic, D.DOMESTIC).otherwise(D.OVERSEAS), F.lit("|001|"), body).alias("frame"))


TICKS = """SELECT event_id, event_type AS symbol, round(value, 2) AS price, CASE WHEN event_id % 2 = 0 THEN -round(value, 2) ELSE round(value, 2) END AS change, event_id % 1000 AS volume,
  strftime(timezone('UTC', timezone(CASE WHEN event_id % 3 != 0 THEN 'Asia/Seoul' ELSE 'America/New_York' END, date_trunc('second', ts))), '%Y-%m-%d %H:%M:%S') AS as_of FROM events WHERE NOT (event_id % 50 = 0 AND event_id % 3 != 0)"""


@query("tick_parse", TICKS)
def tick_parse(spark, sf_dir):
    rows = D.ticks(D.frames(raw_frames(spark, sf_dir)), ["event_id"])
    symbols = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    home = symbols.select(F.lit(D.DOMESTIC).alias("feed"), F.col("symbol").alias("key"), "symbol")
    away = symbols.select(F.lit(D.OVERSEAS).alias("feed"), F.concat(F.lit("X"), F.col("symbol")).alias("key"), "symbol")
    subs = home.unionByName(away).withColumn("ordinal", F.xxhash64("symbol"))
    return D.subscribed(rows, subs).select("event_id", "symbol", F.col("price").cast("double").alias("price"), F.col("change").cast("double").alias("change"), "volume", T.stamp("as_of").alias("as_of"))


@query("frame_errors", "SELECT CASE WHEN event_id % 50 = 0 AND event_id % 3 != 0 THEN 'too few fields' ELSE 'none' END AS error, count(*) AS frames FROM events GROUP BY 1")
def frame_errors(spark, sf_dir):
    return D.frames(raw_frames(spark, sf_dir)).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("frames"))


@query("json_quotes", "SELECT event_id, event_type AS symbol, round(value, 2) AS price, CASE WHEN event_id % 10 = 0 THEN 'fractional volume' ELSE 'none' END AS error FROM events")
def json_quotes(spark, sf_dir):
    volume = F.when(F.col("event_id") % 10 == 0, "1.5").otherwise("3")
    e = T.table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("symbol"), F.col("value").cast("decimal(20,2)").cast("string").alias("lastPrice"), F.lit("0").alias("change"), volume.alias("volume"), F.col("ts").cast("string").alias("timestamp"))).alias("payload"))
    return D.quotes(e, "payload", ["event_id"]).select("event_id", "symbol", F.col("price").cast("double").alias("price"), F.coalesce("error", F.lit("none")).alias("error"))


@query("order_book", "WITH q AS (SELECT event_type AS symbol, max(value) AS price FROM events GROUP BY 1) SELECT symbol, l::INT AS level, side, round(price + s * l * 0.5::DOUBLE, 2) AS level_price FROM q, range(1, 6) r(l), (VALUES ('ask', 1), ('bid', -1)) v(side, s)")
def order_book(spark, sf_dir):
    q = T.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.max("value").alias("price"))
    return D.order_book(q, 0.5)


def quotes(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("seq"))


@query("latest_quote", "SELECT event_type AS symbol, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, last(value ORDER BY e.ts, event_id) AS price, count(*) AS ticks FROM events e GROUP BY 1")
def latest_quote(spark, sf_dir):
    return show(Q.latest(quotes(spark, sf_dir)), "price", "ticks")


ALERTS = "a AS (SELECT c_custkey AS alert_id, (SELECT list(DISTINCT event_type ORDER BY event_type) FROM events)[c_custkey % 5 + 1] AS symbol, CASE WHEN c_custkey % 2 = 0 THEN 'above' ELSE 'below' END AS condition, (c_acctbal + 1000) / 50 AS target_price, CASE WHEN c_custkey % 9 = 0 THEN 'disabled' ELSE 'active' END AS status FROM customer)"


def alerts(spark, sf_dir):
    names = T.table(spark, sf_dir, "events").agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    k = F.col("c_custkey")
    return T.table(spark, sf_dir, "customer").join(F.broadcast(names)).select(k.alias("alert_id"), F.get("names", (k % 5).cast("int")).alias("symbol"), F.when(k % 2 == 0, "above").otherwise("below").alias("condition"), ((F.col("c_acctbal") + 1000) / 50).alias("target_price"), F.when(k % 9 == 0, "disabled").otherwise("active").alias("status"))


@query("alert_eval", f"WITH {ALERTS}, q AS (SELECT event_type AS symbol, last(value ORDER BY ts, event_id) AS p FROM events GROUP BY 1) SELECT alert_id, CASE WHEN status = 'active' AND CASE WHEN condition = 'above' THEN p >= target_price ELSE p <= target_price END THEN 'triggered' ELSE status END AS status FROM a LEFT JOIN q USING (symbol)")
def alert_eval(spark, sf_dir):
    return Q.evaluate_alerts(alerts(spark, sf_dir), Q.latest(quotes(spark, sf_dir))).select("alert_id", "status")


@query("sliding_limiter", """WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (
  SELECT key, n, event_id, [t] AS held, true AS allowed FROM e WHERE n = 1 UNION ALL
  SELECT key, n, event_id, CASE WHEN len(h) < 2 THEN h || [t] ELSE h END, len(h) < 2 FROM (SELECT e.key, e.n, e.event_id, e.t, [x FOR x IN f.held IF x > e.t - 86400000000] AS h FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1))
SELECT event_id, allowed FROM f""")
def sliding_limiter(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"))
    return Q.sliding_limit(e, 2, 86_400).select(F.col("seq").alias("event_id"), "allowed")


@query("token_bucket")
def token_bucket(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"))
    return Q.token_bucket(e, 1.0 / 3600 + 1).select(F.col("seq").alias("event_id"), F.round("wait_seconds", 3).alias("wait_seconds"))


@query("stream_candles", f"WITH {HOUR} SELECT symbol, {STAMP}, open, high, low, close, volume FROM b")
def stream_candles(spark, sf_dir):
    return show(Q.bars(quotes(spark, sf_dir)), "open", "high", "low", "close", "volume")


@query("http_slo", "SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS from_ts, count(*) AS requests, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_ratio, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1")
def http_slo(spark, sf_dir):
    requests = T.table(spark, sf_dir, "events").select("ts", F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("duration"))
    return X.http_quality(requests).select(T.stamp("from_ts").alias("from_ts"), "requests", F.round("error_ratio", 6).alias("error_ratio"), F.round("p95", 4).alias("p95"))
