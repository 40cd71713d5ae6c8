"""Queries on payload scans, guards of reports, searches and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import actions as A
from quantloom.operators import guards as G
from quantloom.operators import history as H
from quantloom.operators import patterns as P
from quantloom.operators import text as X
from quantloom.plans.analysis import LOGS, STORED, logs, stored
from quantloom.plans.market import PATTERNS, STAMP, show
from quantloom.plans.registry import query
from quantloom.plans.trading import ACTIONS, AS_OF, USER_DAY
from quantloom.sources import feeds as D
from quantloom.sources import tables as T


@query("rss_incomplete_items", """SELECT event_id, 2 * s AS seq, 'T' || (event_id + s) AS title, 'http://n/' || event_id || '/' || s AS url, CASE WHEN (event_id + s) % 2 = 0 THEN strftime(date_trunc('second', ts) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') END AS published_at,
  CASE WHEN (event_id + s) % 4 = 0 THEN 'Paper ' || s ELSE 'RSS' END AS publisher, CASE WHEN (event_id + s) % 5 = 0 THEN 'sum ' || event_id END AS summary FROM events, range(3) r(s)""")
def rss_incomplete_items(spark, sf_dir):
    k = F.col("event_id")

    def items(s):
        n = k + s
        text = lambda x: F.lit(x)
        date = F.when(n % 2 == 0, F.concat(text("<pubDate>Mon, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), text(" +0900</pubDate>"))).otherwise("")
        source = F.when(n % 4 == 0, text(f'<source url="http://p">Paper {s}</source>')).otherwise("")
        summary = F.when(n % 5 == 0, F.concat(text("<description> sum "), k.cast("string"), text("</description>"))).otherwise("")
        whole = F.concat(text("<item><title>T"), n.cast("string"), text("</title><link>http://n/"), k.cast("string"), text(f"/{s}</link>"), date, source, summary, text("</item>"))
        return F.concat(whole, text("<item><link>http://lacks/title</link><pubDate>Mon, 1 Jan 2024 00:00:00 +0900</pubDate></item>"))

    xml = F.concat(F.lit("<rss><channel><title>c</title>"), *[items(s) for s in range(3)], F.lit("</channel></rss>"))
    raw = T.table(spark, sf_dir, "events").select("event_id", xml.alias("xml"))
    return D.rss_items(raw, "xml", ["event_id"]).select("event_id", "seq", "title", "url", T.stamp("published_at").alias("published_at"), "publisher", "summary")


@query("disclosure_scan", """SELECT o_custkey AS customer, o_orderkey AS order_key, lpad(o_orderkey::VARCHAR, 14, '0') AS receipt_no, 'Report ' || o_orderpriority AS report_name,
  CASE WHEN o_orderkey % 7 != 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS filed_on, CASE WHEN o_orderkey % 7 = 0 THEN 'disclosure date' ELSE 'none' END AS error FROM orders WHERE o_orderkey % 5 NOT IN (0, 1)
UNION ALL SELECT o_custkey, o_orderkey, NULL, NULL, NULL, '020' FROM orders WHERE o_orderkey % 5 = 1""")
def disclosure_scan(spark, sf_dir):
    k = F.col("o_orderkey")
    day = F.when(k % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    row = F.struct(F.lpad(k.cast("string"), 14, "0").alias("rcept_no"), day.alias("rcept_dt"), F.concat(F.lit("Report "), "o_orderpriority").alias("report_nm"))
    status = F.when(k % 5 == 0, "013").when(k % 5 == 1, "020").otherwise("000")
    raw = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), k.alias("order_key"), F.to_json(F.struct(status.alias("status"), F.when(status == "000", F.array(row)).alias("list"))).alias("payload"))
    return D.disclosures(raw, "payload", ["customer", "order_key"]).select("customer", "order_key", "receipt_no", "report_name", F.date_format("filed_at", "yyyy-MM-dd").alias("filed_on"), F.coalesce("error", F.lit("none")).alias("error"))


@query("statement_scan", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN 'none' WHEN o_orderkey % 4 = 2 THEN 'none' WHEN o_orderkey % 4 = 0 THEN 'CFS' ELSE 'OFS' END AS statement_type,
  CASE WHEN o_orderkey % 4 IN (0, 1) THEN CASE WHEN o_orderkey % 3 = 0 THEN 'KRW' ELSE 'USD' END END AS currency, CASE o_orderkey % 4 WHEN 2 THEN 'not found' WHEN 3 THEN '900' ELSE 'none' END AS error,
  CASE WHEN o_orderkey % 4 IN (0, 1) THEN (CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END * o_orderkey * 1000)::DOUBLE END AS revenue FROM orders""")
def statement_scan(spark, sf_dir):
    k = F.col("o_orderkey")

    def payload(kind):
        status = F.when(k % 4 == 2, "013").when(k % 4 == 3, "900" if kind == "CFS" else "000").otherwise(F.when((k % 4 == 0) | F.lit(kind == "OFS"), "000").otherwise("013"))
        value = F.format_number(k * 1000, 0)
        value = F.concat(F.lit("("), value, F.lit(")")) if kind == "CFS" else value
        empty = F.struct(F.lit("other").alias("account_id"), F.lit("").alias("account_nm"), F.lit("-").alias("thstrm_amount"), F.lit("").alias("currency"))
        row = F.struct(F.lit("ifrs-full_Revenue").alias("account_id"), F.lit("").alias("account_nm"), value.alias("thstrm_amount"), F.when(k % 3 != 0, "USD").otherwise("").alias("currency"))
        return F.struct(F.lit(kind).alias("kind"), F.to_json(F.struct(status.alias("status"), F.array(empty, row).alias("list"))).alias("payload"))

    raw = T.table(spark, sf_dir, "orders").select(k.alias("id"), F.explode(F.array(payload("CFS"), payload("OFS"))).alias("p")).select("id", "p.*")
    found = D.statements(raw, "payload", "kind", ["id"])
    revenue = X.first_match(D.statement_rows(found, ["id"]), {"revenue": ["ifrs-full_Revenue"]}, ["id"])
    return found.join(revenue, "id", "left").select("id", F.coalesce("statement_type", F.lit("none")).alias("statement_type"), "currency", F.coalesce("error", F.lit("none")).alias("error"), F.col("revenue").cast("double").alias("revenue"))


@query("flow_scan", """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'omitted orgn_ntby_qty' WHEN 1 THEN 'no such symbol' WHEN 2 THEN 'invalid frgn_hldn_rate' ELSE 'none' END AS error,
  CASE WHEN c_custkey % 4 != 1 THEN (c_custkey * 1234)::DOUBLE END AS foreign_net_quantity, CASE WHEN c_custkey % 4 = 3 THEN 12.5::DOUBLE END AS foreign_holding_rate FROM customer""")
def flow_scan(spark, sf_dir):
    k = F.col("c_custkey")
    rate = F.when(k % 4 == 2, "1.2.3").when(k % 4 == 3, " 12.5 ")
    body = F.struct(F.format_number(k * 1234, 0).alias("frgn_ntby_qty"), F.when(k % 4 == 0, " ").otherwise("-5").alias("orgn_ntby_qty"), F.lit("0").alias("prsn_ntby_qty"), rate.alias("frgn_hldn_rate"))
    payload = F.to_json(F.struct(F.when(k % 4 == 1, "7").otherwise("0").alias("rt_cd"), F.lit("no such symbol").alias("msg1"), F.when(k % 4 != 1, body).alias("output")))
    found = D.investor_flow(T.table(spark, sf_dir, "customer").select(k.alias("id"), payload.alias("payload")), "payload", ["id"])
    return found.select("id", F.coalesce("error", F.lit("none")).alias("error"), *[F.col(c).cast("double").alias(c) for c in ("foreign_net_quantity", "foreign_holding_rate")])


@query("candidate_scan", """WITH c AS (SELECT o_custkey AS symbol, strftime(o_orderdate, '%Y%m%d') || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS receipt_no, o_orderkey % 2 = 0 AS bonus, o_orderkey % 5 AS ratio, (o_orderkey % 7) * 100 AS before, (o_orderkey % 3) * 100 AS after, o_orderkey % 3 = 0 AS fixed, o_orderkey % 4 = 0 AS later, o_orderkey % 8 = 1 AS gone FROM orders)
SELECT symbol, receipt_no, CASE WHEN bonus THEN 'stock_dividend' ELSE 'reverse_split' END AS action_type, round(CASE WHEN bonus THEN CASE WHEN ratio > 0 THEN 1 / (1 + ratio::DOUBLE) END ELSE CASE WHEN before > 0 AND after > 0 AND after < before THEN before / after::DOUBLE END END, 9) AS price_factor,
  fixed AS correction_hint, later AS superseded_hint, (2 + fixed::INT + later::INT + gone::INT + CASE WHEN bonus THEN (ratio <= 0)::INT ELSE 1 + (NOT (before > 0 AND after > 0 AND after < before))::INT END)::INT AS warnings,
  row_number() OVER (PARTITION BY symbol ORDER BY receipt_no[1:8] DESC, receipt_no DESC)::INT AS place FROM c""")
def candidate_scan(spark, sf_dir):
    """Each order's candidate. Receipt numbers hold the last six digits of a key, so
    large tables have some more than once: order and filing share the key too."""
    k = F.col("o_orderkey")
    receipt = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((k % 1000000).cast("string"), 6, "0"))
    d = lambda c: c.cast("decimal(20,6)")
    rows = T.table(spark, sf_dir, "orders").select(
        k, F.col("o_custkey").alias("symbol"), F.when(k % 2 == 0, "bonus_issue").otherwise("capital_reduction").alias("kind"), receipt.alias("receipt_no"), (k % 5).cast("decimal(20,10)").alias("ratio"), d(k % 7 * 100).alias("before"), d(k % 3 * 100).alias("after"), F.to_date("o_orderdate").alias("decision_date"), F.lit(None).cast("date").alias("record_date"))
    remarks = F.when(k % 4 == 0, "정").when(k % 8 == 1, "철")
    filings = T.table(spark, sf_dir, "orders").select(k, receipt.alias("receipt_no"), F.when(k % 3 == 0, "[기재정정] 보고서").otherwise("보고서").alias("report_name"), remarks.alias("remarks"))
    found = A.candidates(rows, filings, by=["receipt_no", "o_orderkey"])
    return found.select("symbol", "receipt_no", "action_type", F.round(F.col("price_factor").cast("double"), 9).alias("price_factor"), "correction_hint", "superseded_hint", F.size("warnings").alias("warnings"), "place")


@query("page_total", f"WITH {LOGS} SELECT id, (SELECT count(*) FROM lg WHERE severity = 'error') AS total FROM lg WHERE severity = 'error' ORDER BY lg.created_at DESC, id DESC LIMIT 20 OFFSET 40")
def page_total(spark, sf_dir):
    return H.page_with_total(logs(spark, sf_dir), [F.desc("created_at"), F.desc("id")], 20, 40, severity="error").select("id", "total")


@query("inventory_review", f"""WITH {STORED}, g AS (SELECT source_provider, price_basis, rule, stage, count(*) AS n, CASE WHEN source_provider = 'legacy_unknown' OR price_basis = 'unknown' OR rule = 'legacy_unknown' THEN 0 ELSE 1 END AS ready FROM st GROUP BY ALL), f AS (SELECT * FROM g ORDER BY source_provider, price_basis, rule, stage LIMIT 10)
SELECT (SELECT sum(n) FROM g)::BIGINT AS total_candles, (SELECT sum(n) FILTER (rule = 'legacy_unknown') FROM g)::BIGINT AS legacy_rule_candles, (SELECT count(*) FROM g) AS total_groups, (SELECT sum(ready) FROM f)::BIGINT AS review_ready_groups, (SELECT count(*) - sum(ready) FROM f)::BIGINT AS blocked_review_groups, (SELECT count(*) FROM g) > (SELECT count(*) FROM f) AS groups_truncated, 3 AS blockers""")
def inventory_review(spark, sf_dir):
    return H.inventory_review(stored(spark, sf_dir), 10).select("total_candles", "legacy_rule_candles", "total_groups", "review_ready_groups", "blocked_review_groups", "groups_truncated", F.size("classification_blockers").alias("blockers"))


NAMES = "n AS (SELECT p_partkey AS seq, p_brand AS symbol, p_name AS name, ['RE' || p_partkey, 'zz'] AS aliases, upper(regexp_replace(p_brand, '\\s+', '', 'g')) AS s, upper(regexp_replace(p_name, '\\s+', '', 'g')) AS t FROM part)"


def named(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("symbol"), F.col("p_name").alias("name"), F.array(F.concat(F.lit("RE"), F.col("p_partkey").cast("string")), F.lit("zz")).alias("aliases"))


@query("symbol_search_alias", f"""WITH {NAMES}, a AS (SELECT *, 'RE' || seq AS u FROM n) SELECT symbol, name, CASE WHEN contains(s, 'RE1') THEN CASE WHEN s = 'RE1' THEN 0 WHEN starts_with(s, 'RE1') THEN 1 ELSE 3 END WHEN contains(t, 'RE1') THEN CASE WHEN t = 'RE1' THEN 0 WHEN starts_with(t, 'RE1') THEN 2 ELSE 4 END
  ELSE CASE WHEN u = 'RE1' THEN 0 WHEN starts_with(u, 'RE1') THEN 2 ELSE 5 END END AS rank FROM a WHERE contains(s, 'RE1') OR contains(t, 'RE1') OR contains(u, 'RE1') ORDER BY rank, seq LIMIT 6""")
def symbol_search_alias(spark, sf_dir):
    return X.symbol_search(named(spark, sf_dir), "r e1")


@query("symbol_search_empty", "SELECT p_brand AS symbol, p_name AS name, 0 AS rank FROM part WHERE false")
def symbol_search_empty(spark, sf_dir):
    return X.symbol_search(named(spark, sf_dir), "  ")


@query("symbol_exact", f"WITH {NAMES} SELECT symbol, name FROM n WHERE list_contains(aliases, 'RE7') OR s = 'RE7' OR t = 'RE7' ORDER BY seq LIMIT 1")
def symbol_exact(spark, sf_dir):
    return X.symbol_exact(named(spark, sf_dir), "re 7")


@query("symbol_filter", f"WITH {NAMES} SELECT symbol, name FROM n ORDER BY seq LIMIT 5")
def symbol_filter(spark, sf_dir):
    return X.symbol_filter(named(spark, sf_dir), "Z Z")


@query("report_compliance", """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'report-compliance-metadata-missing' WHEN c_custkey % 5 = 1 THEN 'report-investment-advice-forbidden' WHEN c_custkey % 5 = 2 THEN 'report-reference-signal-invalid' WHEN c_custkey % 5 = 3 THEN 'report-compliance-blocked' ELSE 'none' END AS error FROM customer""")
def report_compliance(spark, sf_dir):
    k = F.col("c_custkey")
    report = T.table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 5 == 0, "").otherwise("No advice").alias("disclaimer"), F.lit("2024-01-01").cast("timestamp_ntz").alias("data_as_of"), (k % 5 == 1).alias("is_investment_advice"), F.when(k % 5 == 2, "hold").otherwise("risk_aware").alias("reference_signal"), F.when(k % 5 == 3, "You MUST Sell now").otherwise("calm").alias("summary"))
    return X.report_error(report, [F.col("disclaimer"), F.col("summary")]).select("id", F.coalesce("error", F.lit("none")).alias("error"))


@query("trade_scan", """SELECT o_orderkey AS id, s AS seq, CASE WHEN (o_orderkey + s) % 5 != 0 THEN round(o_totalprice + s, 2) END AS price, CASE WHEN (o_orderkey + s) % 5 = 0 THEN 'price' WHEN s = 1 AND o_orderkey % 3 = 0 THEN 'timestamp' ELSE 'none' END AS error FROM orders, range(2) r(s)""")
def trade_scan(spark, sf_dir):
    k = F.col("o_orderkey")

    def one(s):
        price = F.when((k + s) % 5 == 0, "n/a").otherwise((F.col("o_totalprice") + s).cast("decimal(20,2)").cast("string"))
        return F.struct(price.alias("price"), F.lit("3").alias("volume"), F.when((k % 3 == 0) & F.lit(s == 1), "soon").otherwise("2024-01-01T00:00:00+09:00").alias("timestamp"))

    raw = T.table(spark, sf_dir, "orders").select(k.alias("id"), F.to_json(F.array(one(0), one(1), one(2))).alias("payload"))
    found = D.trades(raw, "payload", ["id"], limit=2)
    return found.select("id", F.col("seq").cast("bigint").alias("seq"), F.round(F.col("price").cast("double"), 2).alias("price"), F.coalesce("error", F.lit("none")).alias("error"))


@query("stock_info_scan", """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 != 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 != 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'KRW' ELSE 'USD' END END AS currency, CASE WHEN c_custkey % 4 = 0 THEN 'not found' ELSE 'none' END AS error FROM customer""")
def stock_info_scan(spark, sf_dir):
    k = F.col("c_custkey")
    entry = lambda symbol, name: F.struct(symbol.alias("symbol"), name.alias("name"), F.lit("KOSPI").alias("market"), F.when(k % 2 == 0, "").otherwise("USD").alias("currency"))
    own = F.when(k % 4 != 0, F.concat(F.lit("S"), k.cast("string"))).otherwise("other")
    raw = T.table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("S"), k.cast("string")).alias("symbol"), F.to_json(F.array(entry(F.lit("first"), F.lit("x")), entry(own, F.col("c_name")))).alias("payload"))
    return D.stock_info(raw, "payload", "symbol", ["id"]).select("id", "name", "currency", F.coalesce("error", F.lit("none")).alias("error"))


@query("stock_warning_scan", """SELECT s_suppkey AS id, 'overheated' AS warning_type, CASE WHEN s_suppkey % 2 = 0 THEN 'KRX' END AS exchange, CASE WHEN s_suppkey % 3 = 0 THEN '2024-02-29' END AS start_date FROM supplier""")
def stock_warning_scan(spark, sf_dir):
    k = F.col("s_suppkey")
    one = F.struct(F.lit("overheated").alias("warningType"), F.when(k % 2 == 0, "KRX").otherwise("").alias("exchange"), F.when(k % 3 == 0, "2024-02-29").otherwise("never").alias("startDate"))
    raw = T.table(spark, sf_dir, "supplier").select(k.alias("id"), F.to_json(F.array(one)).alias("payload"))
    return D.stock_warnings(raw, "payload", ["id"]).select("id", "warning_type", "exchange", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"))


@query("holding_currency_totals", "SELECT c_nationkey AS account, round(sum(c_acctbal) FILTER (c_custkey % 2 = 0), 2) AS krw, round(sum(c_acctbal) FILTER (c_custkey % 2 = 1), 2) AS usd FROM customer GROUP BY 1")
def holding_currency_totals(spark, sf_dir):
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("account"), F.when(F.col("c_custkey") % 2 == 0, "KRW").otherwise("USD").alias("currency"), F.col("c_acctbal").cast("decimal(24,2)").alias("amount"))
    found = D.currency_totals(rows, ["account"], "amount")
    return found.select("account", *[F.round(F.try_element_at("totals", F.lit(c.upper())).cast("double"), 2).alias(c) for c in ("krw", "usd")])


@query("quote_change_percent", "SELECT event_id, round(coalesce((value / 10) / nullif(value - value / 10, 0) * 100, 0.0), 2) AS change_percent FROM events")
def quote_change_percent(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select("event_id", D.change_percent(F.col("value"), F.col("value") / 10).alias("change_percent"))


@query("corp_code_lookup", "SELECT o_orderkey AS id, lpad(c_custkey::VARCHAR, 8, '0') AS corp_code FROM orders JOIN customer ON o_custkey = c_custkey")
def corp_code_lookup(spark, sf_dir):
    codes = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("corp_code"))
    return G.looked_up(T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("symbol")), codes, "symbol", "corp_code").select("id", "corp_code")


@query("ingestion_guard", """SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 0 AND count(*) OVER (PARTITION BY o_custkey) > 1 THEN 'batch limit' WHEN o_orderkey % 5 = 0 THEN 'provenance' WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'effective_at' WHEN o_orderkey % 7 = 0 THEN 'known_at' ELSE 'none' END AS error FROM orders""")
def ingestion_guard(spark, sf_dir):
    k = F.col("o_orderkey")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    actions = T.table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("batch_id"), F.when(k % 5 == 0, "other").otherwise("feed").alias("source"), F.lit("s").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("effective_at"), F.when(k % 7 == 0, at("2031-01-01")).otherwise(at("2000-01-01")).alias("known_at"))
    batch = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id")).distinct()
    batch = batch.select("batch_id", F.lit("feed").alias("source"), F.lit(" S ").alias("symbol"), at("1995-01-01").alias("start"), at("2030-01-01").alias("end"), at("2030-06-01").alias("fetched_at"), F.when(F.col("batch_id") % 10 == 0, 1).otherwise(500).alias("limit"))
    found = G.ingestion_errors(actions, batch)
    return found.select("id", F.coalesce("error", F.lit("none")).alias("error"))


@query("unknown_datasets", "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'bars' || s_suppkey ELSE '' END AS missing FROM supplier")
def unknown_datasets(spark, sf_dir):
    k = F.col("s_suppkey")
    asked = F.array(F.lit("quotes"), F.when(k % 3 == 0, F.concat(F.lit("bars"), k.cast("string"))).otherwise("news"))
    return T.table(spark, sf_dir, "supplier").select(k.alias("id"), F.array_join(G.unknown(asked, ["quotes", "news"]), ",").alias("missing"))


@query("basis_metadata", f"WITH {USER_DAY}, {ACTIONS}, n AS (SELECT symbol, count(*) AS n FROM con WHERE EXISTS (SELECT 1 FROM b WHERE b.symbol = con.symbol AND b.ts < con.effective_at) GROUP BY symbol) SELECT b.symbol, 'unadjusted' AS bases, coalesce(max(n), 0) AS applied_actions FROM b LEFT JOIN n USING (symbol) GROUP BY b.symbol")
def basis_metadata(spark, sf_dir):
    bars = T.user_daily(spark, sf_dir).withColumn("price_basis", F.lit("unadjusted"))
    return A.basis_metadata(bars, T.corporate_actions(spark, sf_dir), "forward_point_in_time", AS_OF).select("symbol", F.array_join("input_price_bases", ",").alias("bases"), "applied_actions")


@query("pattern_evidence", f"""WITH {PATTERNS} SELECT symbol, {STAMP}, 'doji' AS name, printf('body/range=%.3f', body / span) AS evidence FROM c WHERE span > 0 AND body / span <= 0.10
UNION ALL SELECT symbol, {STAMP}, 'range_breakout_up', printf('close=%.4f above prior_20_high=%.4f', close, prior_high) FROM c WHERE close > prior_high""")
def pattern_evidence(spark, sf_dir):
    found = P.patterns(T.hourly(spark, sf_dir)).where(F.col("name").isin("doji", "range_breakout_up"))
    return show(found, "name", F.array_join("evidence", "; ").alias("evidence"))


@query("payload_sanitize", r"""SELECT page_id, '{"api_key":"[REDACTED]","page":' || page_id || ',"note":"token=[REDACTED]","list":[1,[2]]}' AS clean FROM pages""")
def payload_sanitize(spark, sf_dir):
    raw = F.concat(F.lit('{"api_key": "k", "page": '), F.col("page_id").cast("string"), F.lit(', "note": "token: abc", "list": [1, [2]]}'))
    return T.table(spark, sf_dir, "pages").select("page_id", X.sanitize(raw).alias("clean"))


@query("model_page", "SELECT s_suppkey AS version, s_nationkey AS created FROM supplier ORDER BY s_nationkey DESC, s_suppkey LIMIT 20")
def model_page(spark, sf_dir):
    rows = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("version"), F.col("s_nationkey").alias("created"))
    return H.page(rows, [F.desc("created"), F.asc("version")], G.within("limit", 20))
