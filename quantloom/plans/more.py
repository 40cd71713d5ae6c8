"""Queries on guards, payloads, reports and small registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import guards as G
from quantloom.operators import history as H
from quantloom.operators import scoring as S
from quantloom.plans.registry import query
from quantloom.sources import feeds as D
from quantloom.sources import sinks
from quantloom.sources import tables as T


@query("symbol_guard", r"SELECT c_custkey AS id, upper(trim(c_mktsegment)) AS symbol, regexp_full_match(upper(trim(c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '!' ELSE '' END)), '[A-Z0-9.-]{1,16}') AS is_valid FROM customer")
def symbol_guard(spark, sf_dir):
    odd = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "!").otherwise(""))
    return T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), G.symbol_of(F.col("c_mktsegment")).alias("symbol"), G.symbol_is_valid(odd).alias("is_valid"))


@query("provenance_guard", "SELECT p_partkey AS id, length(repeat(p_type, (1 + p_partkey % 3)::INT)) BETWEEN 1 AND 32 AND p_partkey % 7 != 0 AS is_valid FROM part")
def provenance_guard(spark, sf_dir):
    k = F.col("p_partkey")
    return T.table(spark, sf_dir, "part").select(k.alias("id"), G.provenance_is_valid(F.repeat("p_type", (1 + k % 3).cast("int")), F.when(k % 7 != 0, F.col("p_brand"))).alias("is_valid"))


@query("report_fields", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'high' WHEN c_custkey % 3 = 0 THEN 'medium' ELSE 'low' END AS downside_risk, CASE WHEN c_nationkey <= 3 THEN 'high' WHEN c_nationkey <= 6 THEN 'medium' ELSE 'low' END AS confidence FROM customer")
def report_fields(spark, sf_dir):
    k = F.col("c_custkey")
    df = T.table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 4 == 0, 1).otherwise(0).alias("warning_count"), F.when(k % 3 == 0, 1).otherwise(0).alias("missing_count"), F.lit(0.0).alias("confidence_lower"), (F.col("c_nationkey") * 0.05 - 0.0001).alias("confidence_upper"))
    return S.report_fields(df).select("id", "downside_risk", "confidence")


@query("rss_items", "SELECT event_id, 1 AS seq, 'News ' || event_type AS title, 'http://n/' || event_id AS url, strftime(date_trunc('second', ts) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS published_at FROM events WHERE event_id % 4 != 0")
def rss_items(spark, sf_dir):
    k = F.col("event_id").cast("string")
    title = F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.concat(F.lit("News "), "event_type"))
    xml = F.concat(F.lit("<rss><channel><title>x</title><item><title> lead </title><link> </link><pubDate>x</pubDate></item><item><title>"), title, F.lit("</title><link>http://n/"), k, F.lit("</link><pubDate>Mon, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" +0900</pubDate></item></channel></rss>"))
    raw = T.table(spark, sf_dir, "events").select("event_id", xml.alias("xml"))
    return D.rss_items(raw, "xml", ["event_id"]).select("event_id", "seq", "title", "url", T.stamp("published_at").alias("published_at"))


@query("json_holdings", "SELECT c_custkey AS account, 'S' || i AS symbol, round(c_acctbal * i, 2) AS market_value FROM customer, range(1, 3) r(i)")
def json_holdings(spark, sf_dir):
    one = lambda i: F.struct(F.lit(f"S{i}").alias("symbol"), F.lit("KRW").alias("currency"), F.lit("1").alias("quantity"), F.struct((F.col("c_acctbal").cast("decimal(20,2)") * i).cast("string").alias("amount"), F.lit("0").alias("profit")).alias("marketValue"))
    raw = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), F.to_json(F.array(one(1), one(2))).alias("payload"))
    return D.holdings(raw, "payload", ["account"]).select("account", "symbol", F.col("market_value").cast("double").alias("market_value"))


@query("snapshot_totals", "SELECT c_nationkey AS provider, round(sum(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 2) AS krw, round(sum(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 2) AS usd FROM customer GROUP BY 1")
def snapshot_totals(spark, sf_dir):
    wide = G.totals_by(T.table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal", {"BUILDING": "krw", "MACHINERY": "usd"})
    return wide.select(F.col("c_nationkey").alias("provider"), F.round("krw", 2).alias("krw"), F.round("usd", 2).alias("usd"))


@query("candidate_lookup", "SELECT o_orderkey AS receipt_no, coalesce(c_name, 'none') AS report_name FROM orders LEFT JOIN customer ON o_custkey + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1000000000 END = c_custkey")
def candidate_lookup(spark, sf_dir):
    """Each order is looked up, every second one under a key that no customer has."""
    orders = T.table(spark, sf_dir, "orders").withColumn("key", F.col("o_custkey") + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(1_000_000_000))
    return orders.join(T.table(spark, sf_dir, "customer"), F.col("key") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("receipt_no"), F.coalesce("c_name", F.lit("none")).alias("report_name"))


@query("unknown_symbols", "SELECT DISTINCT o_custkey + CASE WHEN o_custkey % 10 = 0 THEN 1000000000 ELSE 0 END AS symbol FROM orders WHERE o_custkey % 10 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
def unknown_symbols(spark, sf_dir):
    k = F.col("o_custkey")
    asked = T.table(spark, sf_dir, "orders").select((k + F.when(k % 10 == 0, 1_000_000_000).otherwise(0)).alias("symbol"))
    return G.missing(asked, T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol")), "symbol")


@query("active_symbols", "SELECT symbol, subscribers FROM (SELECT o_custkey AS symbol, count(*) AS subscribers FROM orders GROUP BY 1) ORDER BY subscribers DESC, symbol LIMIT 40")
def active_symbols(spark, sf_dir):
    return G.most_subscribed(T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol")), 40)


@query("recent_symbols", "WITH r AS (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY last DESC) FILTER (k <= 3) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS k FROM r) GROUP BY user_id")
def recent_symbols(spark, sf_dir):
    return G.recent(T.table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", 3).select("user_id", F.array_join("items", ",").alias("recent"))


@query("chart_scale", "SELECT round(min(value) - (max(value) - min(value)) * 0.08, 4) AS low, round(max(value) + (max(value) - min(value)) * 0.08, 4) AS high FROM events")
def chart_scale(spark, sf_dir):
    return G.chart_scale(T.table(spark, sf_dir, "events"), "value").select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("url_check", r"SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, starts_with(url, 'https://') AS is_https, regexp_matches(url, '^https://[^?#]*$') AS is_plain FROM pages")
def url_check(spark, sf_dir):
    url = F.col("url")
    return T.table(spark, sf_dir, "pages").select("page_id", G.host(url).alias("host"), G.is_https(url).alias("is_https"), G.is_plain_https(url).alias("is_plain"))


@query("data_as_of", "SELECT u.user_id, strftime(greatest(u.a, v.a), '%Y-%m-%d %H:%M:%S') AS data_as_of FROM (SELECT user_id, max(ts) AS a FROM events WHERE event_type = 'click' GROUP BY 1) u LEFT JOIN (SELECT user_id, max(ts) AS a FROM events WHERE event_type != 'click' GROUP BY 1) v USING (user_id)")
def data_as_of(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    found = G.latest_of({"a": e.where("event_type = 'click'"), "b": e.where("event_type != 'click'")}, "user_id", "ts")
    return found.select("user_id", T.stamp("data_as_of").alias("data_as_of"))


@query("weight_activation", "SELECT s_suppkey AS version, s_suppkey = 3 AS active FROM supplier")
def weight_activation(spark, sf_dir):
    return H.activate(T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("version")), 3)


@query("alert_removal", "SELECT c_custkey AS alert_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'disabled' WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'triggered' END AS status FROM customer WHERE c_custkey % 11 != 0")
def alert_removal(spark, sf_dir):
    k = F.col("c_custkey")
    stored = T.table(spark, sf_dir, "customer").select(k.alias("alert_id"), F.when(k % 2 == 0, "active").otherwise("triggered").alias("status"))
    return G.disable(G.removed(stored, F.col("alert_id") % 11 == 0), F.col("alert_id") % 3 == 0).select("alert_id", "status")


@query("agent_findings", "SELECT event_type AS symbol, count(*) FILTER (value > 100) > 0 AS has_spike, 'bars: ' || count(*) || '; spikes: ' || count(*) FILTER (value > 100) AS summary FROM events GROUP BY 1")
def agent_findings(spark, sf_dir):
    n = T.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("s"))
    return n.select("symbol", (F.col("s") > 0).alias("has_spike"), F.format_string("bars: %d; spikes: %d", "n", "s").alias("summary"))


@query("report_payloads")
def report_payloads(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(20,6)").alias("score"), "o_orderstatus")
    return sinks.json_rows(orders, ["o_orderkey"])


@query("mock_feed")
def mock_feed(spark, sf_dir):
    from quantloom.sources import connectors

    connectors.register(spark)
    return spark.read.format("mock_bars").option("symbols", "AAA,BBB,CCC").option("count", "60").load()
