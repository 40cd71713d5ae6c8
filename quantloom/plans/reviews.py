"""Queries on artifacts, verification, approval, latency, payloads and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import actions as A
from quantloom.operators import approval as AP
from quantloom.operators import backtest as K
from quantloom.operators import bars as B
from quantloom.operators import boosting as BO
from quantloom.operators import history as H
from quantloom.operators import latency as L
from quantloom.operators import requests as R
from quantloom.operators import scoring as S
from quantloom.operators import text as X
from quantloom.operators import verification as V
from quantloom.operators.actions import candidates, revision_groups
from quantloom.plans.registry import query
from quantloom.sources import artifacts, sinks
from quantloom.sources import tables as T
from quantloom.sources.shared import scratch


@query("artifact_pointers", """SELECT 'S' || s_suppkey AS symbol, 'v' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 != 0 THEN '-2' ELSE '-1' END AS version,
  CASE WHEN s_suppkey % 4 = 0 THEN 'v' || s_suppkey || '-2' WHEN s_suppkey % 2 = 0 THEN 'v' || s_suppkey || '-1' END AS previous_version,
  sha256(s_name || ':' || CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 != 0 THEN 2 ELSE 1 END) AS sha256, 'sound' AS error FROM supplier""")
def artifact_pointers(spark, sf_dir):
    """Two versions of a model a supplier: the first active for all, the second for
    the even ones, and rolled back for each fourth."""
    root, k = scratch(spark, "artifacts"), F.col("s_suppkey")
    supplier = T.table(spark, sf_dir, "supplier")
    scope = [F.concat(F.lit("S"), k.cast("string")).alias("symbol"), F.lit("gbt").alias("algorithm"), F.lit(5).alias("horizon_days")]
    version = lambda n: F.concat(F.lit("v"), k.cast("string"), F.lit(f"-{n}")).alias("version")
    model = lambda n: supplier.select(version(n), *scope, F.concat("s_name", F.lit(f":{n}")).cast("binary").alias("payload"), F.lit("experimental").alias("validation_status"), F.create_map(F.lit("accuracy"), F.lit(0.5)).alias("metrics"))
    artifacts.stage(spark, root, model(1).unionByName(model(2)))
    artifacts.activate(spark, root, supplier.select(version(1), *scope))
    artifacts.activate(spark, root, supplier.where(k % 2 == 0).select(version(2), *scope))
    artifacts.rollback(spark, root, supplier.where(k % 4 == 0).select(*scope))
    return artifacts.current(spark, root).select("symbol", "version", "previous_version", "sha256", F.coalesce("error", F.lit("sound")).alias("error"))


REASON = """WITH s AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey = 3 THEN 1 WHEN n_nationkey % 11 = 0 THEN 2 WHEN n_nationkey % 5 != 0 AND n_nationkey % 7 = 0 THEN 3 ELSE 0 END AS fault, n_nationkey % 5 = 0 AS contract FROM nation),
r AS (SELECT o_orderkey AS k, o_custkey % 10 AS m, CASE WHEN o_orderkey % 17 = 0 THEN 'effective_at_missing' WHEN s.n IS NULL THEN 'source_not_found' WHEN fault > 0 THEN 'source_at_fault' WHEN contract THEN 'source_not_verified'
  ELSE [NULL, 'no_result', 'ambiguous_result', 'result_time_missing', 'mismatched_provenance', 'inconsistent_match_flag', 'invalid_evidence', 'invalid_evidence', 'invalid_evidence', NULL][(o_custkey % 10 + 1)::INT] END AS reason FROM orders LEFT JOIN s ON s.n = o_orderkey % 27)"""


@query("source_verification", f"{REASON} SELECT k AS request_id, coalesce(reason, 'verified') AS reason, reason IS NULL AND m = 0 AS exact_match, CASE WHEN reason IS NULL THEN 'E' || k END AS evidence_id FROM r")
def source_verification(spark, sf_dir):
    """Nations as sources, orders as requests and answers with every kind of fault."""
    n, k, m = F.col("n_nationkey"), F.col("o_orderkey"), F.col("o_custkey") % 10
    text = lambda c: c.cast("string")
    sources = T.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("source-"), text(n)).alias("name"), F.col("n_name").alias("authority"), F.array(F.lit("US")).alias("markets"), F.when(n % 5 == 0, "requires_contract").otherwise("verified").alias("integration_status"), (n % 7 != 0).alias("corporate_action_data"),
        F.lit("verified").alias("effective_date_field_status"), F.lit("primary").alias("verification_role"), F.concat(F.when(n % 11 == 0, "http").otherwise("https"), F.lit("://n"), text(n), F.lit(".example/about")).alias("reference_url"))
    sources = sources.unionByName(sources.where("name = 'source-3'"))
    orders = T.table(spark, sf_dir, "orders")
    day, of = F.col("o_orderdate").cast("timestamp"), F.concat(F.lit("source-"), text(k % 27))
    requests = orders.select(k.alias("request_id"), of.alias("source"), F.concat(F.lit(" s"), text(F.col("o_custkey"))).alias("symbol"), F.lit("split").alias("action_type"), F.when(k % 17 != 0, day).alias("effective_at"))
    exact = m == 0
    host = F.when(m == 7, "other.example").when(m == 8, F.concat(F.lit("n"), text(k % 27), F.lit(".example:8443"))).otherwise(F.concat(F.lit("n"), text(k % 27), F.lit(".example")))
    results = orders.where(m != 1).select(
        k.alias("request_id"), of.alias("source"), F.concat(F.when(m == 4, "X").otherwise("S"), text(F.col("o_custkey"))).alias("symbol"), F.lit("split").alias("action_type"), day.alias("requested_effective_at"), F.when(exact, day).otherwise(day + F.expr("interval 1 day")).alias("matched_effective_at"),
        F.when(m != 3, day).alias("fetched_at"), F.when(m == 5, ~exact).otherwise(exact).alias("exact_match"), F.when(m == 6, " ").otherwise(F.concat(F.lit("E"), text(k))).alias("evidence_id"), F.concat(F.lit("https://"), host, F.lit("/e")).alias("evidence_url"))
    found = V.verify(requests, sources, results.unionByName(results.where(F.substring("symbol", 2, 20).cast("long") % 10 == 2)))
    return found.select("request_id", F.coalesce("reason", F.lit("verified")).alias("reason"), F.coalesce("exact_match", F.lit(False)).alias("exact_match"), "evidence_id")


@query("approval_workflow", """WITH c AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS bonus, o_orderkey % 5 AS ratio, (o_orderkey % 7) * 100 AS before, (o_orderkey % 3) * 100 AS after, o_custkey % 10 AS m FROM orders),
e AS (SELECT k, CASE WHEN m = 0 THEN 'confirmation' WHEN m = 1 THEN 'source' WHEN m = 2 THEN 'effective_at' WHEN m = 3 THEN 'exchange_evidence' WHEN m = 4 THEN 'group_changed' WHEN NOT CASE WHEN bonus THEN ratio > 0 ELSE before > 0 AND after > 0 AND after < before END THEN 'factors_incomplete' WHEN m = 5 THEN 'filing_evidence' END AS error FROM c)
SELECT k AS request_id, coalesce(error, 'none') AS error, error IS NULL AND k % 4 != 0 AS created, error IS NULL AND k % 4 = 0 AS already FROM e""")
def approval_workflow(spark, sf_dir):
    """Each order's candidate is asked for; those of each fourth order were approved
    by a call before. A receipt number names one order, however many there are: a
    million of a day, then those of the next."""
    root, k, m = scratch(spark, "approvals"), F.col("o_orderkey"), F.col("o_custkey") % 10
    orders = T.table(spark, sf_dir, "orders")
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.floor(k / 1000000).cast("int"))
    receipt = F.concat(F.date_format(day, "yyyyMMdd"), F.lpad((k % 1000000).cast("string"), 6, "0"))
    d = lambda c: c.cast("decimal(20,6)")
    symbol = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))

    def shown():
        rows = orders.select(symbol.alias("symbol"), F.when(k % 2 == 0, "bonus_issue").otherwise("capital_reduction").alias("kind"), receipt.alias("receipt_no"), (k % 5).cast("decimal(20,10)").alias("ratio"), d(k % 7 * 100).alias("before"), d(k % 3 * 100).alias("after"), F.to_date("o_orderdate").alias("decision_date"), F.lit(None).cast("date").alias("record_date"))
        filings = orders.select(receipt.alias("receipt_no"), F.concat(F.lit("Report "), k.cast("string")).alias("report_name"), F.lit(None).cast("string").alias("remarks"))
        wrong = F.substring("symbol", 2, 20).cast("long") % 10 == 5
        url = F.concat(F.lit("https://dart.fss.or.kr/dsaf001/main.do?rcpNo="), F.when(wrong, "x").otherwise(""), F.col("receipt_no"))
        return candidates(rows, filings).select("*", F.lit("dart").alias("source"), url.alias("evidence_url"))

    hints = revision_groups(shown()).select("symbol", "group_hint", F.explode("receipt_nos").alias("receipt_no"))
    asked = orders.select(k.alias("request_id"), F.when(m == 1, "krx").otherwise("dart").alias("source"), symbol.alias("symbol"), receipt.alias("receipt_no"), F.when(m != 2, F.col("o_orderdate").cast("timestamp")).alias("effective_at"),
                          F.when(m == 3, "https://kind.krx.co.kr.evil.example/").otherwise("https://kind.krx.co.kr/a?b=1").alias("exchange_evidence_url"), F.when(m == 0, "yes").otherwise(AP.CONFIRMATION).alias("confirmation"), m.alias("m"))
    requests = asked.join(hints, ["symbol", "receipt_no"]).withColumn("group_hint", F.when(F.col("m") == 4, "candidate:gone").otherwise(F.col("group_hint"))).drop("m")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    AP.approve(spark, root, requests.where("request_id % 4 = 0"), shown, now)
    told = AP.approve(spark, root, requests, shown, now)
    ok = F.col("error").isNull()
    return told.select("request_id", F.coalesce("error", F.lit("none")).alias("error"), "created", (ok & ~F.col("created")).alias("already"))


@query("revision_conflicts", """WITH n AS (SELECT o_orderkey AS k, o_custkey % 50 AS batch, o_orderkey % 3 = 0 AS known, o_orderkey % 97 = 0 AND o_orderkey % 3 = 0 AS differs FROM orders), b AS (SELECT DISTINCT batch FROM n WHERE differs)
SELECT batch, count(*) FILTER (NOT known AND batch NOT IN (SELECT batch FROM b)) AS created, count(*) FILTER (known AND NOT differs) AS unchanged, count(*) FILTER (differs) AS conflict, count(*) FILTER (NOT known AND batch IN (SELECT batch FROM b)) AS rejected FROM n GROUP BY batch""")
def revision_conflicts(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = T.table(spark, sf_dir, "orders").select(k.alias("k"), F.col("o_totalprice").cast("decimal(24,12)").alias("factor"), (F.col("o_custkey") % 50).alias("batch"))
    changed = rows.withColumn("factor", F.when(F.col("k") % 97 == 0, F.col("factor") + 1).otherwise(F.col("factor")).cast("decimal(24,12)"))
    told = H.insert_outcomes(rows.where("k % 3 = 0").select("k", "factor"), changed, ["k"], ["factor"], "batch")
    return H.insert_counts(told, "batch")


@query("payload_shapes", r"""SELECT event_id, CASE event_id % 8
  WHEN 0 THEN '{"Authorization":"[REDACTED]","user":{"id":' || user_id || ',"tags":["' || event_type || '",null,true,1.25]}}'
  WHEN 1 THEN '{"a":{"b":{"c":{"d":{"e":"[TRUNCATED]","my_token":"[REDACTED]"}}}}}'
  WHEN 2 THEN '{' || (SELECT string_agg('"k' || i || '":' || (event_id + i), ',' ORDER BY i DESC) FROM range(6, 36) r(i)) || ',"_truncated":true}'
  WHEN 3 THEN '[' || (SELECT string_agg((event_id * i)::VARCHAR, ',' ORDER BY i) FROM range(0, 20) r(i)) || ',"[TRUNCATED]"]'
  WHEN 4 THEN NULL
  WHEN 5 THEN '"Bearer [REDACTED] said \"' || event_type || '\""'
  WHEN 6 THEN '{"note":"' || repeat('x', 500) || '…","list":[[{"cookie":"[REDACTED]"}],{"text":"api_key=[REDACTED], ok"}]}'
  ELSE event_id::VARCHAR END AS clean FROM events""")
def payload_shapes(spark, sf_dir):
    """Nested, deep, wide, long, broken and plain payloads, with secrets in each."""
    k, kind = F.col("event_id"), F.col("event_id") % 8
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    wide = F.array_join(F.transform(F.sequence(F.lit(35), F.lit(0), F.lit(-1)), lambda i: F.concat(F.lit('"k'), i.cast("string"), F.lit('": '), (k + i).cast("string"))), ", ")
    many = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: (k * i).cast("string")), ",")
    raw = (
        F.when(kind == 0, text('{"Authorization": {"x": 1}, "user": {"id": ', F.col("user_id"), ', "tags": ["', F.col("event_type"), '", null, true, 1.25]}}'))
        .when(kind == 1, text('{"a": {"b": {"c": {"d": {"e": {"f": [', k, ']}, "my_token": 1}}}}}')).when(kind == 2, text("{", wide, "}")).when(kind == 3, text("[", many, "]"))
        .when(kind == 4, text('{"token": "', k, '"')).when(kind == 5, text('"bearer abc.', k, ' said \\"', F.col("event_type"), '\\""'))
        .when(kind == 6, text('{"note": "', F.repeat(F.lit("x"), F.lit(600)), '", "list": [[{"cookie": [1]}], {"text": "api_key: ', k, ', ok"}]}')).otherwise(text(" ", k))
    )
    return T.table(spark, sf_dir, "events").select("event_id", X.sanitize(raw).alias("clean"))


#: Hourly samples of counters by event type that begin anew each day, and the rates
#: of five hours, in SQL.
RATES = """WITH RECURSIVE le AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, 'inf'::DOUBLE])::DOUBLE AS le),
e AS (SELECT event_type AS route, epoch(date_trunc('hour', ts) + INTERVAL 1 HOUR)::DOUBLE AS t, date_trunc('day', ts) AS day, value / 20 AS duration FROM events),
n AS (SELECT route, day, t, le, count(*) AS n FROM e JOIN le ON duration <= le GROUP BY ALL),
v AS (SELECT route, le, t, (sum(n) OVER (PARTITION BY route, le, day ORDER BY t))::DOUBLE AS v FROM n),
m AS (SELECT route, le, t, max(v) AS v FROM v GROUP BY ALL),
d AS (SELECT *, coalesce(CASE WHEN v >= lag(v) OVER w THEN v - lag(v) OVER w WHEN lag(v) OVER w IS NOT NULL THEN v END, v - v + CASE WHEN lag(v) OVER w IS NULL THEN v ELSE 0 END) AS d FROM m WINDOW w AS (PARTITION BY route, le ORDER BY t)),
x AS (SELECT *, unnest(range(ceil(t / 3600)::BIGINT, ceil((t + 18000) / 3600)::BIGINT)) AS step FROM d),
y AS (SELECT route, le, step, min(t) AS a, max(t) AS b, count(*) AS n, sum(d) - arg_min(d, t) AS grown, arg_min(v, t) AS f FROM x GROUP BY ALL HAVING count(*) > 1),
z AS (SELECT route, le, step, grown, b - a AS width, CASE WHEN a - (step * 3600 - 18000) < (b - a) / (n - 1) * 1.1::DOUBLE THEN a - (step * 3600 - 18000) ELSE (b - a) / (n - 1) / 2 END AS front, CASE WHEN step * 3600 - b < (b - a) / (n - 1) * 1.1::DOUBLE THEN step * 3600 - b ELSE (b - a) / (n - 1) / 2 END AS back, CASE WHEN grown > 0 THEN (b - a) * f / grown END AS zero FROM y),
r AS (SELECT route, le, step, grown * (width + least(front, coalesce(zero, front)) + back) / width / 18000 AS rate FROM z)"""


def samples(spark, sf_dir):
    hour = (F.date_trunc("hour", "ts") + F.expr("interval 1 hour")).cast("timestamp")
    requests = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), "ts", (F.col("value") / 20).alias("duration"), F.date_trunc("day", "ts").alias("day"))
    return L.cumulative(L.bucketed(requests, ["route", "day"], "duration", hour), ["route", "le"], "n", ["day"])


@query("latency_quantile", f"""{RATES}, s AS (SELECT step, le, sum(rate) AS v FROM r GROUP BY ALL), l AS (SELECT step, le, max(v) OVER w AS v, row_number() OVER w AS k, max(v) OVER (PARTITION BY step) AS total, count(*) OVER (PARTITION BY step) AS size, max(le) OVER (PARTITION BY step) AS top FROM s WINDOW w AS (PARTITION BY step ORDER BY le)),
p AS (SELECT *, lag(le) OVER w AS below, lag(v) OVER w AS under FROM l WINDOW w AS (PARTITION BY step ORDER BY k)), q AS (SELECT * FROM p WHERE v >= 0.95::DOUBLE * total QUALIFY row_number() OVER (PARTITION BY step ORDER BY k) = 1)
SELECT step * 3600 AS at, round(CASE WHEN size < 2 OR top != 'inf'::DOUBLE OR total <= 0 THEN NULL WHEN k = size THEN below ELSE coalesce(below, 0) + (le - coalesce(below, 0)) * (0.95::DOUBLE * total - coalesce(under, 0)) / (v - coalesce(under, 0)) END, 8) AS p95 FROM q""")
def latency_quantile(spark, sf_dir):
    """The 95th percentile of durations from rates of bucket counters."""
    found = L.slow_share(samples(spark, sf_dir), ["route", "le"], "n", L.QUANTILE, 5 * 3600, 3600)
    return found.select(F.unix_seconds("at").alias("at"), F.round("quantile", 8).alias("p95"))


@query("counter_rates", f"{RATES} SELECT route, step * 3600 AS at, round(rate, 9) AS rate FROM r WHERE le = 'inf'::DOUBLE")
def counter_rates(spark, sf_dir):
    every = samples(spark, sf_dir).where(F.col("le") == float("inf"))
    return L.rates(every, ["route"], "n", 5 * 3600, 3600).select("route", F.unix_seconds("at").alias("at"), F.round("rate", 9).alias("rate"))


@query("gbt_by_symbol")
def gbt_by_symbol(spark, sf_dir):
    """A model a symbol on hourly bars, tried in three purged folds; ten trees each,
    of the model's forty, since each is some jobs whatever the table. No SQL: trees
    aren't expressible; the tests hold them against trees grown plainly."""
    return BO.predicted(S.features(T.hourly(spark, sf_dir)), p=BO.Boosting(trees=10))


@query("request_bounds", """SELECT o_orderkey AS id, CASE o_custkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN CASE WHEN o_orderkey % 400 BETWEEN 30 AND 365 THEN 'none' ELSE 'limit' END WHEN 2 THEN 'symbol,strategy' WHEN 3 THEN 'initial_capital,tax_rate' WHEN 4 THEN 'payload' ELSE 'fast_period,max_volume_participation' END AS errors,
  CASE o_custkey % 6 WHEN 0 THEN 240 WHEN 1 THEN CASE WHEN o_orderkey % 400 BETWEEN 30 AND 365 THEN o_orderkey % 400 ELSE 0 END ELSE 0 END AS limit FROM orders""")
def request_bounds(spark, sf_dir):
    k, kind = F.col("o_orderkey"), F.col("o_custkey") % 6
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    payload = (
        F.when(kind == 0, text('{"symbol": "S', k, '", "tax_rate": 0, "other": [1]}')).when(kind == 1, text('{"symbol": "S1", "limit": ', k % 400, "}")).when(kind == 2, text('{"symbol": "s', k, '", "strategy": "sell_all"}'))
        .when(kind == 3, text('{"symbol": "S1", "initial_capital": 0, "tax_rate": 1}')).when(kind == 4, text('{"symbol": "S', k)).otherwise(text('{"symbol": "S1", "fast_period": true, "max_volume_participation": 1.', k, "1}"))
    )
    found = R.checked(T.table(spark, sf_dir, "orders").select(k.alias("id"), payload.alias("payload")), "backtest")
    return found.select("id", F.when(F.size("errors") > 0, F.array_join("errors", ",")).otherwise("none").alias("errors"), F.coalesce("request.limit", F.lit(0)).alias("limit"))


@query("report_gate", """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'report-compliance-metadata-missing' WHEN 2 THEN 'report-investment-advice-forbidden' WHEN 3 THEN 'report-reference-signal-invalid'
  WHEN 4 THEN 'report-data-as-of-invalid' WHEN 5 THEN 'report-compliance-blocked' WHEN 6 THEN 'none' ELSE 'report-compliance-metadata-missing' END AS fault FROM pages""")
def report_gate(spark, sf_dir):
    """Reports with nested parts; a forbidden phrase deep inside blocks, one in a key
    doesn't."""
    k = F.col("page_id") % 8
    part = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    body = F.concat_ws(
        ", ", F.when(k != 1, part("disclaimer", F.lit('"for reference"'))), part("data_as_of", F.when(k == 4, F.lit("20260101")).otherwise(F.lit('"2026-01-01T00:00:00+00:00"'))), part("is_investment_advice", F.when(k == 2, F.lit("true")).when(k == 7, F.lit("null")).otherwise(F.lit("false"))),
        part("reference_signal", F.when(k == 3, F.lit('"buy_now"')).otherwise(F.lit('"risk_aware"'))), part("parts", F.concat(F.lit('[{"strong buy": 1, "notes": ["a \\"quoted\\" note", {"deep": "'), F.when(k == 5, F.lit("you Must\\tSell")).otherwise(F.lit("held")), F.lit('"}]}]'))))
    payload = F.concat(F.lit("{"), body, F.lit("}"))
    return T.table(spark, sf_dir, "pages").select("page_id", F.coalesce(X.report_fault(payload), F.lit("none")).alias("fault"))


@query("mapped_actions", """WITH r AS (SELECT o_orderkey AS k, o_custkey % 9 AS m, o_orderkey % 2 = 0 AS bonus, strftime(o_orderdate::DATE::TIMESTAMP - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS announced FROM orders),
e AS (SELECT *, CASE WHEN m = 1 THEN 'kind' WHEN m = 2 AND NOT bonus THEN 'proportional_consolidation' WHEN m = 3 THEN CASE WHEN bonus THEN 'ratio' ELSE 'outstanding_shares' END WHEN m = 4 AND NOT bonus THEN 'no_reduction' WHEN m = 5 THEN 'decision_date' WHEN m = 6 THEN 'times' WHEN m = 7 THEN 'identity' WHEN m = 8 THEN 'status' END AS reason FROM r)
SELECT k AS id, coalesce(reason, 'none') AS reason, CASE WHEN reason IS NULL THEN CASE WHEN bonus THEN 0.8 ELSE 1.25 END::DOUBLE END AS price_factor, CASE WHEN reason IS NULL AND m != 2 THEN announced END AS announced_at FROM e""")
def mapped_actions(spark, sf_dir):
    k, m = F.col("o_orderkey"), F.col("o_custkey") % 9
    day = F.date_format("o_orderdate", "yyyy.MM.dd")
    rows = T.table(spark, sf_dir, "orders").select(
        F.when(m == 1, "other").when(k % 2 == 0, "bonus_issue").otherwise("capital_reduction").alias("kind"), F.concat(F.lit("s"), k.cast("string")).alias("symbol"), k.cast("string").alias("event_id"), F.when(m == 7, 0).otherwise(1).alias("revision"),
        F.when(m != 6, F.col("o_orderdate").cast("timestamp")).alias("known_at"), F.col("o_orderdate").cast("timestamp").alias("effective_at"), F.when(m == 8, "odd").otherwise("confirmed").alias("status"), F.when(m == 3, "-").otherwise(" 0.25").alias("ratio"),
        F.when(m == 3, "0").otherwise("1,000").alias("before"), F.when(m == 4, "1,000").otherwise("800").alias("after"), F.when(m == 5, "soon").when(m == 2, " ").otherwise(day).alias("decided"), (m != 2).alias("proportional"))
    sound, bad = A.mapped_actions(rows, strict=False)
    good = sound.select(F.col("event_id").cast("long").alias("id"), F.lit("none").alias("reason"), F.col("price_factor").cast("double").alias("price_factor"), T.stamp("announced_at").alias("announced_at"))
    return good.unionByName(bad.select(F.col("event_id").cast("long").alias("id"), "reason"), allowMissingColumns=True)


@query("guarded_bars", "WITH b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, min(value) AS low FROM events GROUP BY 1, 2) SELECT symbol, count(*) AS bars, min(low) AS low FROM b GROUP BY 1")
def guarded_bars(spark, sf_dir):
    """Bars that pass the guards of their ranges and times; the guards run though no
    price but the low is read. Values of events may be 0 or less, so the guard of
    positive prices, which an order needs, isn't for them."""
    sound = B.require_sound(B.require_unique(T.hourly(spark, sf_dir)))
    return sound.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("low").alias("low"))


@query("snapshot_replace", "SELECT c_nationkey AS nation, count(*) AS rows, round(sum(CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE c_acctbal END), 2) AS total FROM customer GROUP BY 1")
def snapshot_replace(spark, sf_dir):
    """Holdings by nation stored whole; every third nation's are then replaced by
    another snapshot, the others stay."""
    root = scratch(spark, "snapshots")
    rows = T.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("amount"), F.col("c_nationkey").alias("nation"))
    sinks.replace_snapshot(rows, root, ["nation"])
    sinks.replace_snapshot(rows.where("nation % 3 = 0").withColumn("amount", F.lit(1.0)), root, ["nation"])
    return spark.read.parquet(root).groupBy("nation").agg(F.count("*").alias("rows"), F.round(F.sum("amount"), 2).alias("total")).select(F.col("nation").cast("int").alias("nation"), "rows", "total")


RUN = "WITH b AS (SELECT event_type AS symbol, date_trunc('day', ts) AS ts FROM events GROUP BY event_type, date_trunc('day', ts))"


@query("run_payloads", f"""{RUN} SELECT symbol, count(*) AS points, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, 2 AS trades, 'buy' AS first_side, TRUE AS has_return FROM b GROUP BY symbol""")
def run_payloads(spark, sf_dir):
    """Runs of a strategy with their curves and trades as JSON, read back from it."""
    config = K.Config()
    curve = K.vectorized(K.buy_and_hold(T.daily(spark, sf_dir)), config)
    made = K.trades(curve, config)
    points = curve.select("symbol", "ts", "equity", "daily_return", "position")
    stored = H.result_payloads(K.metrics(curve, made, config), {"equity_curve": points, "trades": made}, ["symbol"], ["ts"])
    lists = {c: F.from_json(c, f"array<struct<{kinds}>>") for c, kinds in (("equity_curve", "ts:string,equity:double"), ("trades", "ts:string,side:string"))}
    read = stored.select("symbol", F.from_json("metrics", "total_return double").alias("m"), *[x.alias(c) for c, x in lists.items()])
    return read.select(
        "symbol", F.size("equity_curve").cast("long").alias("points"), F.col("equity_curve")[0]["ts"].alias("first_ts"), F.size("trades").alias("trades"), F.col("trades")[0]["side"].alias("first_side"), F.col("m.total_return").isNotNull().alias("has_return"))


@query("isolated_axes", "SELECT c_custkey AS symbol, round(c_acctbal, 2) AS technical, CASE WHEN c_custkey % 2 = 0 THEN 50.0 END AS news, 'available,unavailable,available,failed,unavailable,unavailable' AS status FROM customer")
def isolated_axes(spark, sf_dir):
    """Two axes that load, one that fails when it is planned, three without a loader."""
    root = scratch(spark, "axes")
    customer = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_acctbal").cast("double").alias("score"))

    def keep(df, name):
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    loaders = {
        "technical": lambda: customer, "news": lambda: customer.where("symbol % 2 = 0").withColumn("score", F.lit(50.0)),
        "disclosure": lambda: customer.select("no_such_column")}
    found, status = S.isolated_axes(customer.select("symbol"), loaders, keep)
    told = ",".join(s.split(":")[0] for s in status.values())
    return found.select("symbol", F.round("technical", 2).alias("technical"), "news", F.lit(told).alias("status"))
