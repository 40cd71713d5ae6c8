"""Queries on scores, portfolios, predictions, history and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.numeric import amount, mask
from quantloom.operators import history as H
from quantloom.operators import scoring as S
from quantloom.operators import text as X
from quantloom.plans.market import DAY, HOUR, STAMP, W, show
from quantloom.plans.registry import query
from quantloom.sources import tables as T

AXES = """ax AS (SELECT c_custkey AS id, c_acctbal, c_nationkey, [CASE WHEN c_custkey % 4 = 0 THEN 'trading risk' END, CASE WHEN c_custkey % 6 = 0 THEN 'overheated' END] AS w,
    CASE WHEN c_nationkey = 0 THEN NULL ELSE 50 + 30 * tanh((c_acctbal / 1e4) / (c_nationkey / 20.0::DOUBLE) / 0.15) END AS m1, 50 + ((c_acctbal + 1000) / 12000 - 0.5) * 60 AS m2 FROM customer), axes AS (
  SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE (c_acctbal + 1000) / 110 END AS technical, round(list_avg([CASE WHEN m1 IS NOT NULL THEN greatest(least(m1, 100), 0) END, greatest(least(m2, 100), 0)]), 4) AS financial, round(50 + 25 * tanh(c_nationkey / 12.0::DOUBLE - 1), 4) AS news,
         round(50 - least(40, (id % 4) * 20.0::DOUBLE), 4) AS disclosure, round(CASE WHEN id % 3 = 0 THEN CASE WHEN c_acctbal > 0 THEN 60.0 WHEN c_acctbal < 0 THEN 40.0 ELSE 50.0 END ELSE 50 + 30 * tanh(c_acctbal / 1e7 / 0.001) END, 4) AS investor_flow,
         50 - least(40.0, list_sum(list_transform([x FOR x IN w IF x IS NOT NULL] || [''], lambda v: CASE WHEN v = '' THEN 0.0 WHEN contains(v, 'risk') THEN 25.0 ELSE 15.0 END)))::DOUBLE AS market_risk FROM ax), agg AS (
  SELECT *, (coalesce(technical * 0.3, 0) + financial * 0.2 + news * 0.1 + disclosure * 0.1 + investor_flow * 0.15 + market_risk * 0.15)::DOUBLE / (CASE WHEN technical IS NULL THEN 0.7 ELSE 1.0 END)::DOUBLE AS o, CASE WHEN technical IS NULL THEN 0.7 ELSE 1.0 END AS cov FROM axes)"""


def axes(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    bal, n, k = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey")
    financial = S.financial_axis(n / F.lit(20.0), bal / 1e4, F.lit(None).cast("double"), F.lit(12000.0), bal + 1000)
    flow = S.flow_axis(bal, F.when(k % 3 != 0, F.lit(1e7)))
    warnings = F.array_compact(F.array(F.when(k % 4 == 0, F.lit("trading risk")), F.when(k % 6 == 0, F.lit("overheated"))))
    return c.select(k.alias("id"), F.when(k % 5 != 0, (bal + 1000) / 110).alias("technical"), financial.alias("financial"), S.news_axis(n / F.lit(12.0) - 1).alias("news"), S.disclosure_axis((k % 4).cast("double")).alias("disclosure"), flow.alias("investor_flow"), S.risk_axis(warnings).alias("market_risk"))


AXIS = ["technical", "financial", "news", "disclosure", "investor_flow", "market_risk"]


@query("axis_scores", f"WITH {AXES} SELECT id, {', '.join(f'round({a}::DOUBLE + 1e-7, 2) AS {a}' for a in AXIS)} FROM axes")
def axis_scores(spark, sf_dir):
    return axes(spark, sf_dir).select("id", *[F.round(F.col(a) + 1e-7, 2).alias(a) for a in AXIS])


@query("score_aggregate", f"WITH {AXES} SELECT id, round(round(o, 4) + 1e-7, 2) AS overall_score, cov::DOUBLE AS coverage, CASE WHEN round(o, 4) >= 65 THEN 'positive' WHEN round(o, 4) <= 35 THEN 'negative' ELSE 'neutral' END AS label FROM agg")
def score_aggregate(spark, sf_dir):
    return S.aggregate(axes(spark, sf_dir)).select("id", F.round(F.col("overall_score") + 1e-7, 2).alias("overall_score"), "coverage", "label")


SIGNAL = """sg AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_acctbal + 1000) / 110 END AS s, c_nationkey / 25.0::DOUBLE AS p, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS w FROM customer), sh AS (
  SELECT *, greatest(-1, least(1, (s - 50) / 50 * 0.55::DOUBLE + (p - 0.5) * 2 * 0.45::DOUBLE)) AS c FROM sg)"""


@query("reference_signal", f"WITH {SIGNAL} SELECT id, CASE WHEN w > 0 THEN 'risk_aware' WHEN s IS NULL THEN 'data_insufficient' WHEN c >= 0.12 THEN 'positive_watch' WHEN c <= -0.12 THEN 'defensive_watch' ELSE 'neutral_watch' END AS signal, CASE WHEN w > 0 THEN 100.0 WHEN s IS NULL THEN 0.0 ELSE round(abs(c) * 100, 2) END AS strength FROM sh")
def reference_signal(spark, sf_dir):
    k = F.col("c_custkey")
    df = T.table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 7 != 0, (F.col("c_acctbal") + 1000) / 110).alias("overall_score"), (F.col("c_nationkey") / F.lit(25.0)).alias("rise_probability"), F.when(k % 11 == 0, 1).otherwise(0).alias("warning_count"))
    return S.reference_signal(df).select("id", "signal", "strength")


HOLDINGS = "h AS (SELECT c_mktsegment AS currency, c_custkey::VARCHAR AS symbol, sum(o_totalprice) AS market_value, sum(o_totalprice) - c_acctbal AS purchase_amount, c_acctbal AS profit FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey, c_acctbal), al AS (SELECT *, market_value / sum(market_value) OVER (PARTITION BY currency) AS a FROM h)"


def holdings(spark, sf_dir):
    joined = T.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("market_value")).join(T.table(spark, sf_dir, "customer"), "c_custkey")
    return joined.select(F.col("c_mktsegment").alias("currency"), F.col("c_custkey").cast("string").alias("symbol"), "market_value", (F.col("market_value") - F.col("c_acctbal")).alias("purchase_amount"), F.col("c_acctbal").alias("profit_loss_after_cost"))


@query("holding_allocation", f"WITH {HOLDINGS} SELECT currency, symbol, round(a, 8) AS allocation FROM al")
def holding_allocation(spark, sf_dir):
    return S.allocations(holdings(spark, sf_dir)).select("currency", "symbol", F.round("allocation", 8).alias("allocation"))


PORTFOLIO = f"""{HOLDINGS}, po AS (SELECT currency, count(*) AS holding_count, sum(market_value) AS market_value, sum(purchase_amount) AS purchase_amount, sum(profit) AS profit, count(*) FILTER (profit >= 0) AS profitable_count, count(*) FILTER (profit < 0) AS loss_making_count,
  first(symbol ORDER BY a DESC, symbol) AS largest_symbol, max(a) AS largest, sum(a * a) AS hhi, coalesce(sum(market_value) FILTER (profit < 0), 0) / sum(market_value) AS loss_exposure FROM al GROUP BY currency), pf AS (
  SELECT *, CASE WHEN largest >= 0.5 OR hhi >= 0.35 THEN 'high' WHEN largest >= 0.3 OR hhi >= 0.2 THEN 'moderate' ELSE 'balanced' END AS level FROM po)"""


@query("portfolio_currency", f"""WITH {PORTFOLIO} SELECT currency, holding_count, round(market_value, 2) AS market_value, round(profit, 2) AS profit_loss_after_cost, profitable_count, loss_making_count, largest_symbol, round(largest, 8) AS largest_allocation, round(hhi, 8) AS concentration_index,
  round(profit / purchase_amount, 6) AS profit_rate_after_cost, round(1 / hhi, 4) AS effective_holding_count, round(loss_exposure, 6) AS loss_exposure, level AS concentration_level,
  array_to_string([x FOR x IN [CASE WHEN level = 'high' THEN 'high_concentration' END, CASE WHEN loss_exposure >= 0.25 THEN 'loss_concentration' END, CASE WHEN profit < 0 THEN 'negative_after_cost_return' END] IF x IS NOT NULL], ',') AS risk_flags FROM pf""")
def portfolio_currency(spark, sf_dir):
    r = lambda c, n: F.round(c, n).alias(c)
    return S.portfolio(holdings(spark, sf_dir)).select("currency", "holding_count", r("market_value", 2), r("profit_loss_after_cost", 2), "profitable_count", "loss_making_count", "largest_symbol", r("largest_allocation", 8), r("concentration_index", 8), r("profit_rate_after_cost", 6), r("effective_holding_count", 4), r("loss_exposure", 6), "concentration_level", F.array_join("risk_flags", ",").alias("risk_flags"))


@query("portfolio_signal", f"WITH {PORTFOLIO} SELECT CASE WHEN bool_or(loss_exposure >= 0.25) THEN 'loss_watch' WHEN bool_or(level = 'high') THEN 'concentration_watch' ELSE 'balanced_monitor' END AS reference_signal FROM pf")
def portfolio_signal(spark, sf_dir):
    return S.portfolio_signal(S.portfolio(holdings(spark, sf_dir)))


@query("flow_signal", "SELECT c_custkey AS id, CASE WHEN c_acctbal - 3000 > 0 THEN 'net_inflow' WHEN c_acctbal - 3000 < 0 THEN 'net_outflow' ELSE 'balanced' END AS signal FROM customer")
def flow_signal(spark, sf_dir):
    return T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), S.flow_signal(F.col("c_acctbal"), F.lit(-3000.0)).alias("signal"))


@query("light_prediction", f"""WITH {DAY}, r AS (SELECT symbol, ts, ln(close / lag(close) OVER ({W})) AS ret, count(*) OVER (PARTITION BY symbol) AS bars, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b), a AS (
  SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS s, count(*) AS n FROM r WHERE bars >= 30 AND k <= 20 AND ret IS NOT NULL GROUP BY symbol), p AS (
  SELECT *, 1 / (1 + exp(-greatest(-6, least(6, m * 5 / greatest(s * sqrt(5.0::DOUBLE), 1e-6))))) AS p, least(0.25, greatest(0.08, 1 / sqrt(n))) AS w FROM a)
SELECT symbol, round(p, 6) AS rise_probability, round(greatest(0, p - w), 6) AS confidence_lower, round(least(1, p + w), 6) AS confidence_upper, n AS observations FROM p""")
def light_prediction(spark, sf_dir):
    return S.light_prediction(T.daily(spark, sf_dir))


FEATURES = f"""fe0 AS (SELECT *, row_number() OVER w - 1 AS n, close - lag(close) OVER w AS change, close / lag(close) OVER w - 1 AS ret, lag(close, 5) OVER w AS c5, lead(close, 5) OVER w AS ahead FROM b WINDOW w AS ({W})), fe AS (
  SELECT symbol, ts, n, ret AS return_1, close / c5 - 1 AS return_5, close / avg(close) OVER f5 - 1 AS sma_5_gap, close / avg(close) OVER f20 - 1 AS sma_20_gap, stddev_pop(ret) OVER f20 AS volatility_20, volume / greatest(avg(volume) OVER f20, 1.0) AS volume_ratio,
         CASE WHEN avg(greatest(-change, 0)) OVER f14 = 0 THEN 1.0 ELSE 1 - 1 / (1 + avg(greatest(change, 0)) OVER f14 / avg(greatest(-change, 0)) OVER f14) END AS rsi_14, CASE WHEN ahead IS NOT NULL THEN CASE WHEN ahead > close THEN 1.0 ELSE 0.0 END END::DOUBLE AS label
  FROM fe0 WINDOW f5 AS ({W} ROWS 4 PRECEDING), f20 AS ({W} ROWS 19 PRECEDING), f14 AS ({W} ROWS 13 PRECEDING))"""


@query("features", f"WITH {HOUR}, {FEATURES} SELECT symbol, {STAMP}, {', '.join(f'round({c}, 6) AS {c}' for c in S.FEATURES)} FROM fe WHERE n >= 20")
def features(spark, sf_dir):
    return show(S.features(T.hourly(spark, sf_dir)), *[F.round(c, 6).alias(c) for c in S.FEATURES])


@query("labels", f"WITH {HOUR}, {FEATURES} SELECT symbol, {STAMP}, label FROM fe WHERE n >= 20 AND label IS NOT NULL")
def labels(spark, sf_dir):
    return show(S.features(T.hourly(spark, sf_dir)).where("label is not null"), F.col("label").cast("double").alias("label"))


@query("purged_split", f"""WITH {HOUR}, c AS (SELECT symbol, count(*) AS n FROM b GROUP BY symbol), s AS (SELECT symbol, n, k, greatest(10, (n - 65) // 3) AS size, 65 + (k - 1) * greatest(10, (n - 65) // 3) AS start FROM c, range(1, 4) r(k))
SELECT symbol, k::INT AS fold, (start - 5)::INT AS train_end, start::INT AS test_start, least(n, start + size)::INT AS test_end FROM s WHERE start < n""")
def purged_split(spark, sf_dir):
    return S.purged_splits(T.hourly(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n")), 5)


@query("accuracy_brier", f"WITH {HOUR}, {FEATURES}, p AS (SELECT symbol, 1 / (1 + exp(-20 * return_1)) AS p, label AS y FROM fe WHERE n >= 20 AND label IS NOT NULL) SELECT symbol, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg((p - y) * (p - y)), 6) AS brier, count(*) AS n FROM p GROUP BY symbol")
def accuracy_brier(spark, sf_dir):
    df = S.features(T.hourly(spark, sf_dir)).withColumn("p", 1 / (1 + F.exp(-20 * F.col("return_1"))))
    return S.accuracy_brier(df, "p", "label", ["symbol"]).select("symbol", F.round("accuracy", 6).alias("accuracy"), F.round("brier", 6).alias("brier"), "n")


@query("gbt_prediction")
def gbt_prediction(spark, sf_dir):
    return S.gbt_prediction(S.features(T.hourly(spark, sf_dir)))


LOGS = "lg AS (SELECT event_id AS id, event_type AS symbol, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 3 = 0 THEN 'warning' ELSE 'info' END AS severity, ts AS created_at FROM events)"


def logs(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 3 == 0, "warning").otherwise("info")
    return T.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), severity.alias("severity"), F.col("ts").alias("created_at"))


@query("log_page", f"WITH {LOGS} SELECT id, symbol, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM lg WHERE severity = 'warning' ORDER BY lg.created_at DESC, id DESC LIMIT 50 OFFSET 100")
def log_page(spark, sf_dir):
    return H.page(logs(spark, sf_dir), [F.desc("created_at"), F.desc("id")], 50, 100, severity="warning").select("id", "symbol", T.stamp("created_at").alias("created_at"))


@query("severity_counts", f"WITH {LOGS} SELECT symbol, count(*) AS total, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM lg GROUP BY symbol")
def severity_counts(spark, sf_dir):
    return H.severity_counts(logs(spark, sf_dir))


STORED = "st AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'legacy_unknown' ELSE 'feed' || o_orderkey % 3 END AS source_provider, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE 'unadjusted' END AS price_basis, CASE WHEN o_orderkey % 5 = 0 THEN 'legacy_unknown' ELSE 'v1' END AS rule, o_orderstatus AS stage, o_orderdate AS ts FROM orders)"


def stored(spark, sf_dir):
    k = F.col("o_orderkey")
    return T.table(spark, sf_dir, "orders").select(F.when(k % 5 == 0, "legacy_unknown").otherwise(F.concat(F.lit("feed"), (k % 3).cast("string"))).alias("source_provider"), F.when(k % 4 == 0, "unknown").otherwise("unadjusted").alias("price_basis"), F.when(k % 5 == 0, "legacy_unknown").otherwise("v1").alias("price_basis_rule_version"), F.col("o_orderstatus").alias("data_stage"), F.lit("1d").alias("interval"), F.lit("v1").alias("aggregation_version"), F.col("o_orderdate").alias("ts"))


@query("inventory", f"""WITH {STORED} SELECT source_provider, price_basis, rule AS price_basis_rule_version, stage AS data_stage, count(*) AS candle_count, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day,
  CASE WHEN source_provider = 'legacy_unknown' OR price_basis = 'unknown' OR rule = 'legacy_unknown' THEN 'evidence_required' ELSE 'evidence_recorded' END AS review_status,
  (CASE WHEN source_provider = 'legacy_unknown' THEN 2 ELSE 0 END + CASE WHEN price_basis = 'unknown' THEN 2 ELSE 0 END + CASE WHEN rule = 'legacy_unknown' THEN 1 ELSE 0 END)::INT AS evidence_items FROM st GROUP BY ALL""")
def inventory(spark, sf_dir):
    return H.inventory(stored(spark, sf_dir)).select("source_provider", "price_basis", "price_basis_rule_version", "data_stage", "candle_count", F.date_format("first_ts", "yyyy-MM-dd").alias("first_day"), F.date_format("last_ts", "yyyy-MM-dd").alias("last_day"), "review_status", F.size("required_evidence").alias("evidence_items"))


@query("inventory_totals", f"WITH {STORED} SELECT count(*) AS total_candles, count(*) FILTER (price_basis = 'unknown') AS unknown_candles, count(*) FILTER (source_provider = 'legacy_unknown') AS legacy_unknown_candles, count(DISTINCT (source_provider, price_basis, rule, stage)) AS total_groups FROM st")
def inventory_totals(spark, sf_dir):
    return H.inventory_totals(stored(spark, sf_dir))


@query("run_history_join", "SELECT o_orderkey AS run_id, o_orderstatus AS status, count(*) AS results, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def run_history_join(spark, sf_dir):
    lines = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("results"), F.sum("l_extendedprice").alias("total"))
    return T.table(spark, sf_dir, "orders").join(lines, "o_orderkey").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), "results", F.round("total", 2).alias("total"))


@query("upsert_latest", "WITH o AS (SELECT o_custkey AS k, o_orderkey AS seq, o_totalprice AS v, 0 AS gen FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderkey % 2 = 1) SELECT k, seq, v FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY gen DESC, seq DESC) = 1")
def upsert_latest(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("v"))
    return H.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ["k"], [F.desc("seq")])


@query("retention_count", "SELECT count(*) FILTER (o_orderdate < TIMESTAMP '1997-01-01') AS expired, count(*) AS total FROM orders")
def retention_count(spark, sf_dir):
    return H.retention(T.table(spark, sf_dir, "orders"), "o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz"))[1]


@query("champion_promotion", "SELECT s_suppkey AS version, CASE WHEN s_suppkey = 8 THEN 'champion' WHEN s_nationkey % 5 = (SELECT s_nationkey % 5 FROM supplier WHERE s_suppkey = 8) AND s_suppkey % 2 = 0 AND s_suppkey % 7 = 0 THEN 'challenger' ELSE CASE WHEN s_suppkey % 7 = 0 THEN 'champion' ELSE 'shadow' END END AS registry_stage FROM supplier")
def champion_promotion(spark, sf_dir):
    k = F.col("s_suppkey")
    models = T.table(spark, sf_dir, "supplier").select(k.cast("string").alias("version"), (F.col("s_nationkey") % 5).cast("string").alias("scope_symbol"), F.when(k % 2 == 0, "gbt").otherwise("light").alias("algorithm"), F.lit(5).alias("horizon_days"), F.when(k % 7 == 0, "champion").otherwise("shadow").alias("registry_stage"))
    return H.promote(models, "8").select(F.col("version").cast("bigint").alias("version"), "registry_stage")


@query("revision_insert", "SELECT o_orderkey AS k, round(o_totalprice / 7, 6) AS factor FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 6 != 0")
def revision_insert(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.bround(F.col("o_totalprice").cast("decimal(20,4)") / 7, 12).cast("decimal(24,12)").alias("factor"))
    fresh, _ = H.insert_revisions(rows.where("k % 6 = 0 or k % 3 != 0"), rows.where("k % 3 = 0"), ["k"], ["factor"])
    return fresh.select("k", F.round(F.col("factor").cast("double"), 6).alias("factor"))


@query("partition_plan", "SELECT 'bars_' || strftime(m, '%Y_%m') AS name, strftime(m, '%Y-%m-%d') AS starts_on, strftime(m + INTERVAL 1 MONTH, '%Y-%m-%d') AS ends_before FROM (SELECT date_trunc('month', max(o_orderdate))::DATE + to_months(i::INT) AS m FROM orders, range(1, 7) r(i) GROUP BY i)")
def partition_plan(spark, sf_dir):
    now = T.table(spark, sf_dir, "orders").agg(F.max("o_orderdate").cast("date").alias("day"))
    return H.partition_plan(now, 6).select("name", F.date_format("starts_on", "yyyy-MM-dd").alias("starts_on"), F.date_format("ends_before", "yyyy-MM-dd").alias("ends_before"))


@query("archive_candidates", "SELECT DISTINCT 'bars_' || strftime(o_orderdate, '%Y_%m') AS name FROM orders WHERE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH <= DATE '1998-03-01'")
def archive_candidates(spark, sf_dir):
    names = T.table(spark, sf_dir, "orders").select(F.concat(F.lit("bars_"), F.date_format("o_orderdate", "yyyy_MM")).alias("name")).distinct()
    return H.archive_candidates(names, F.lit("1998-03-01").cast("date")).select("name")


@query("approvals", "SELECT o_custkey AS event_id, count(*)::INT AS added, (1 + count(*))::INT AS last_revision FROM orders GROUP BY 1")
def approvals(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").cast("string").alias("receipt"))
    old = rows.select("event_id").distinct().withColumns({"revision": F.lit(1), "evidence_hash": F.sha2(F.concat(F.lit("old"), F.col("event_id").cast("string")), 256)})
    return H.approvals(old, rows, ["event_id", "receipt"]).groupBy("event_id").agg(F.count("*").cast("int").alias("added"), F.max("revision").alias("last_revision"))


def terms_sql(column: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({column}), '{t}')::INT" for t in terms) + ")"


@query("news_sentiment", f"WITH s AS (SELECT source, round(avg({terms_sql('text', X.POSITIVE)} - {terms_sql('text', X.NEGATIVE)}), 3) AS sentiment_score, count(*) AS articles FROM documents GROUP BY source) SELECT *, CASE WHEN sentiment_score > 0.1 THEN 'positive' WHEN sentiment_score < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM s")
def news_sentiment(spark, sf_dir):
    return X.sentiment_by(T.table(spark, sf_dir, "documents"), "source", "text")


@query("filing_risk", f"SELECT doc_id, CASE WHEN {terms_sql('text', X.HIGH_RISK)} > 0 THEN 'high' ELSE 'normal' END AS risk FROM documents")
def filing_risk(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", X.filing_risk(F.col("text")).alias("risk"))


@query("compliance_scan", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN {i}" for i, p in enumerate(X.FORBIDDEN, 1)) + " ELSE 0 END AS pattern FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || ' Must sell now' WHEN 1 THEN text || ' strong  BUY' WHEN 2 THEN text || ' 매수하세요' ELSE text END AS t FROM documents)")
def compliance_scan(spark, sf_dir):
    extra = F.when(F.col("doc_id") % 5 == 0, " Must sell now").when(F.col("doc_id") % 5 == 1, " strong  BUY").when(F.col("doc_id") % 5 == 2, " 매수하세요").otherwise("")
    return T.table(spark, sf_dir, "documents").select("doc_id", X.blocked(F.concat("text", extra)).alias("pattern"))


@query("redaction", r"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace('api_key=' || md5(doc_id::VARCHAR) || '; Bearer abc' || doc_id || ' ' || text, '(?i)\bbearer\s+[a-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'g'), '(?i)\b(token|secret|password|api[_-]?key|client[_-]?id)\s*[:=]\s*[^\s,;&]+', '\1=[REDACTED]', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '…' ELSE t END AS clean FROM r""")
def redaction(spark, sf_dir):
    dirty = F.concat(F.lit("api_key="), F.md5(F.col("doc_id").cast("string")), F.lit("; Bearer abc"), F.col("doc_id").cast("string"), F.lit(" "), F.col("text"))
    return T.table(spark, sf_dir, "documents").select("doc_id", X.redact(dirty).alias("clean"))


RAW_AMOUNT = "CASE o_orderkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '(' || format('{:,}', o_orderkey * 977) || ')' WHEN 2 THEN ' ' || format('{:,}', o_orderkey * 31) || ' ' WHEN 3 THEN 'n/a' ELSE o_totalprice::DECIMAL(20,2)::VARCHAR END"


def raw_amount():
    k = F.col("o_orderkey")
    return F.when(k % 5 == 0, "-").when(k % 5 == 1, F.concat(F.lit("("), F.format_number(k * 977, 0), F.lit(")"))).when(k % 5 == 2, F.concat(F.lit(" "), F.format_number(k * 31, 0), F.lit(" "))).when(k % 5 == 3, "n/a").otherwise(F.col("o_totalprice").cast("decimal(20,2)").cast("string"))


PARSED = "CASE o_orderkey % 5 WHEN 1 THEN -(o_orderkey * 977)::DOUBLE WHEN 2 THEN (o_orderkey * 31)::DOUBLE WHEN 4 THEN round(o_totalprice, 2) END"


@query("amount_parse", f"SELECT o_orderkey AS id, {PARSED} AS amount FROM orders")
def amount_parse(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), amount(raw_amount()).cast("double").alias("amount"))


@query("account_pivot", f"WITH a AS (SELECT o_custkey AS k, o_orderkey AS seq, o_orderpriority AS p, {PARSED} AS v FROM orders) SELECT k, first(v ORDER BY seq) FILTER (p = '1-URGENT' AND v IS NOT NULL) AS revenue, first(v ORDER BY seq) FILTER (p IN ('2-HIGH', '3-MEDIUM') AND v IS NOT NULL) AS net_income FROM a GROUP BY k")
def account_pivot(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("account_id"), F.lit("").alias("account_nm"), amount(raw_amount()).cast("double").alias("amount"))
    return X.first_match(rows, {"revenue": ["1-URGENT"], "net_income": ["2-HIGH", "3-MEDIUM"]}, ["k"])


@query("symbol_search", """WITH n AS (SELECT p_name AS name, p_brand AS symbol, p_partkey AS seq, upper(regexp_replace(p_brand, '\\s+', '', 'g')) AS s, upper(regexp_replace(p_name, '\\s+', '', 'g')) AS t FROM part)
SELECT symbol, name, CASE WHEN contains(s, 'RE') THEN CASE WHEN s = 'RE' THEN 0 WHEN starts_with(s, 'RE') THEN 1 ELSE 3 END ELSE CASE WHEN t = 'RE' THEN 0 WHEN starts_with(t, 'RE') THEN 2 ELSE 4 END END AS rank FROM n WHERE contains(s, 'RE') OR contains(t, 'RE') ORDER BY rank, seq LIMIT 6""")
def symbol_search(spark, sf_dir):
    return X.symbol_search(T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq")), "r e")


@query("mask_account", "SELECT c_custkey AS id, repeat('*', greatest(0, length(c_name) - 4)) || right(c_name, 4) AS masked FROM customer")
def mask_account(spark, sf_dir):
    return T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), mask(F.col("c_name")).alias("masked"))
