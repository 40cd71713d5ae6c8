"""Feeds with missing parts, guards, searches, sinks and streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quantloom.operators import actions as A
from quantloom.operators import bars as B
from quantloom.operators import history as H
from quantloom.operators import patterns as P
from quantloom.operators import text as X
from quantloom.sources import feeds as D
from quantloom.sources import sinks
from quantloom.streaming import quotes as Q

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint"


def bars(spark, rows, more=""):
    return spark.createDataFrame(rows, BARS + more)


def day(n):
    return datetime(2024, 1, n)


def test_rss_items_keep_to_themselves(spark):
    xml = """<rss version="2.0"><channel><title>c</title>
      <item><title>A</title><link>http://a</link></item>
      <item><title>B</title><link>http://b</link><pubDate>Mon, 1 Jan 2024 09:00:00 +0900</pubDate><source url="http://p">Paper</source></item>
      <item><link>http://c</link><pubDate>Tue, 2 Jan 2024 09:00:00 +0900</pubDate></item>
      <item><title> D </title><link>http://d</link><pubDate>soon</pubDate><description> text </description></item>
      <item><title>E</title><link> </link></item></channel></rss>"""
    raw = spark.createDataFrame([(1, xml), (2, "<rss><channel><item><title>x</title><link>y</link></item></channel></rss>"), (3, "<rss><channel/></rss>"), (4, "no xml"), (5, None)], "id int, xml string")
    got = {(r.id, r.title): (r.url, r.published_at, r.publisher, r.summary) for r in D.rss_items(raw, "xml", ["id"]).collect()}
    assert got == {
        (1, "A"): ("http://a", None, "RSS", None), (1, "B"): ("http://b", datetime(2024, 1, 1), "Paper", None), (1, "D"): ("http://d", None, "RSS", "text"), (2, "x"): ("y", None, "RSS", None)}
    assert D.rss_items(raw, "xml", ["id"], limit=1).count() == 2


def test_subscribed_symbols(spark):
    rows = spark.createDataFrame([(1, 0, "f", "ABC"), (1, 1, "f", "DNASAAPL"), (2, 0, "f", "none"), (2, 1, "g", "ABC"), (3, 0, "h", "X")], "id int, record int, feed string, key string")
    subs = spark.createDataFrame([("f", "ABC", "ABC", 2), ("f", "k", "AAPL", 1), ("f", "k2", "L", 5), ("f", "k3", "PL", 0), ("g", "Q", "C", 3)], "feed string, key string, symbol string, ordinal long")
    got = {(r.id, r.record): r.symbol for r in D.subscribed(rows, subs).collect()}
    assert got == {(1, 0): "ABC", (1, 1): "PL", (2, 0): None, (2, 1): "C", (3, 0): None}


def test_search(spark):
    names = spark.createDataFrame([(1, "AB", "Alpha Beta", ["first"]), (2, "B", "ab", None), (3, "ZZ", "x ab", ["ABZ"])], "seq int, symbol string, name string, aliases array<string>")
    assert [(r.symbol, r["rank"]) for r in X.symbol_search(names, "a b").collect()] == [("AB", 0), ("B", 0), ("ZZ", 4)]
    assert [(r.symbol, r["rank"]) for r in X.symbol_search(names, "FIR").collect()] == [("AB", 2)]
    assert X.symbol_search(names, " \t").count() == 0 and X.symbol_search(names, "ab", 0).count() == 0
    assert [r.symbol for r in X.symbol_exact(names, "abz").collect()] == ["ZZ"] and X.symbol_exact(names, "").count() == 0
    assert [r.symbol for r in X.symbol_filter(names, "").collect()] == ["AB", "B", "ZZ"]


def test_guards_fail_the_job(spark):
    good = [("a", day(n), 2.0, 3.0, 1.0, 2.0, 5) for n in range(1, 25)]
    assert P.patterns(bars(spark, good)).count() >= 1
    with pytest.raises(Exception, match="invalid OHLC bar"):
        P.patterns(bars(spark, [*good, ("a", day(26), 5.0, 3.0, 1.0, 2.0, 5)])).collect()
    with pytest.raises(Exception, match="prices must be positive"):
        B.require_positive(bars(spark, [("a", day(1), 0.0, 1.0, 0.0, 1.0, 1)])).collect()
    with pytest.raises(Exception, match="times must be unique"):
        B.require_positive(bars(spark, [good[0], good[0]])).collect()
    assert B.require_positive(bars(spark, good)).count() == 24
    based = [(*r, "unadjusted") for r in good]
    assert B.resample(bars(spark, based, ", price_basis string"), "1M").count() == 1
    mixed = B.resample(bars(spark, [*based, ("a", day(27), 2.0, 3.0, 1.0, 2.0, 5, "adjusted")], ", price_basis string"), "1w")
    crooked = bars(spark, [*good, ("a", day(26), 5.0, 3.0, 1.0, 2.0, 5)])
    twice = bars(spark, [good[0], good[0]])
    for guarded, message in ((mixed, "mixed price bases"), (B.require_sound(crooked), "invalid OHLC bar"), (B.require_positive(twice), "times must be unique")):
        # the guard holds whichever columns are read, none too
        for read in (guarded, guarded.select("symbol", "volume"), guarded.select("volume").groupBy().sum(), guarded.groupBy("symbol").count()):
            with pytest.raises(Exception, match=message):
                read.collect()
        with pytest.raises(Exception, match=message):
            guarded.count()


def test_candidates_past_the_limit_fail(spark):
    rows = spark.createDataFrame([("S", "bonus_issue", f"2024010{i}000001", None, None, None, None, None) for i in range(1, 4)], "symbol string, kind string, receipt_no string, ratio decimal(20,10), before decimal(20,6), after decimal(20,6), decision_date date, record_date date")
    filings = spark.createDataFrame([("20240102000001", "x", "철")], "receipt_no string, report_name string, remarks string")
    assert [r.receipt_no[:8] for r in A.candidates(rows, filings, 3).orderBy("place").collect()] == ["20240103", "20240102", "20240101"]
    assert "withdrawal_report_reference_required" in {w for r in A.candidates(rows, filings).collect() for w in r.warnings}
    with pytest.raises(Exception, match="more candidates"):
        A.candidates(rows, filings, 2).collect()
    with pytest.raises(Exception, match="invalid receipt number"):
        A.candidates(rows.withColumn("receipt_no", F.lit("2024")), filings).collect()


def test_reviewed_rows(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", "s", "e", 1, t, t, 0.5, 2.0, "confirmed"), ("", "s", "e", 1, t, t, 0.5, 2.0, "confirmed"), ("a", "s", "e", 0, t, t, 0.5, 2.0, "confirmed"), ("a", "s", "e", 1, t, t, 0.0, 2.0, "confirmed"), ("a", "s", "e", 1, t, t, 0.5, None, "confirmed"), ("a", "s", "e", 1, t, t, 0.5, 2.0, "odd"), ("a", "s", "e", 1, None, t, 0.5, 2.0, "confirmed")]
    good, bad = A.reviewed_actions(spark.createDataFrame(rows, "symbol string, source string, event_id string, revision int, effective_at timestamp_ntz, known_at timestamp_ntz, price_factor double, volume_factor double, status string"))
    assert [r.symbol for r in good.collect()] == ["A"]
    assert sorted(r.reason for r in bad.collect()) == ["factors", "factors", "identity", "revision", "status", "times"]


def test_revision_conflicts(spark):
    schema = "k int, factor decimal(24,12)"
    from decimal import Decimal

    old = spark.createDataFrame([(1, Decimal("0.5")), (2, Decimal("0.25"))], schema)
    new = spark.createDataFrame([(1, Decimal("0.5")), (2, Decimal("0.3")), (3, Decimal("1"))], schema)
    fresh, conflicts = H.insert_revisions(old, new, ["k"], ["factor"])
    assert fresh.count() == 0 and [r.k for r in conflicts.collect()] == [2]
    fresh, conflicts = H.insert_revisions(old, new.where("k != 2"), ["k"], ["factor"])
    assert [r.k for r in fresh.collect()] == [3] and conflicts.count() == 0
    schema = "k int, factor decimal(30,15), note string, batch string"
    rows = [(1, "0.5", None, "a"), (3, "1.0000000000005", "x", "a"), (3, "1.0000000000015", "x", "a"), (4, "1.0000000000005", None, "b"), (4, "1", None, "c"), (5, "2", None, "b"), (6, "2", None, "c"), (6, "3", None, "d"), (7, "1", None, "d"), (8, "1", None, None)]
    new = spark.createDataFrame([(k, Decimal(f), n, b) for k, f, n, b in rows], schema)
    old = spark.createDataFrame([(1, Decimal("0.5"), None), (8, Decimal("1"), "other")], "k int, factor decimal(24,12), note string")
    told = H.insert_outcomes(old, new, ["k"], ["factor"], "batch")
    got = sorted((r.k, r.batch or "", r.outcome) for r in told.collect())
    assert got == [(1, "a", "unchanged"), (3, "a", "conflict"), (3, "a", "conflict"), (4, "b", "created"), (4, "c", "unchanged"), (5, "b", "created"), (6, "c", "conflict"), (6, "d", "conflict"), (7, "d", "rejected"), (8, "", "conflict")]
    assert {r.batch: tuple(r)[1:] for r in H.insert_counts(told, "batch").collect()} == {"a": (0, 1, 2, 0), "b": (2, 0, 0, 0), "c": (0, 1, 1, 0), "d": (0, 0, 1, 1), None: (0, 0, 1, 0)}
    fresh, _ = H.insert_revisions(old, new, ["k"], ["factor"], "batch")
    assert sorted(r.k for r in fresh.collect()) == [4, 5] and fresh.columns == old.columns


def test_runs_and_results_go_together(spark):
    runs = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    results = spark.createDataFrame([("r1", 1), ("r3", 2)], "run_id string, value int")
    a, b = H.insert_run(runs, results, "run_id")
    assert [r.run_id for r in a.collect()] == ["r1"] and [r.run_id for r in b.collect()] == ["r1"]


def test_published_versions(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one = lambda n: {"a": spark.range(n), "b": spark.range(n + 1)}
    first = sinks.publish(spark, one(2), root)
    held = sinks.published(spark, root, "a")
    second = sinks.publish(spark, one(5), root)
    assert first != second
    assert sinks.published(spark, root, "a").count() == 5 and sinks.published(spark, root, "b").count() == 6
    assert held.count() == 2  # what a reader has taken stays


def test_appends_and_snapshots(spark, tmp_path):
    sinks.append(spark.range(3), f"{tmp_path}/log")
    sinks.append(spark.range(2), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 5
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "v int, p string")
    sinks.replace_snapshot(df, f"{tmp_path}/snap", ["p"])
    sinks.replace_snapshot(df.where("p = 'x'").withColumn("v", F.col("v") + 10), f"{tmp_path}/snap", ["p"])
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/snap").collect()) == [3, 11, 12]
    rows = sinks.json_rows(spark.createDataFrame([(1, None)], "k int, v double"), ["k"]).collect()
    assert rows[0].k == 1


TICKS = "symbol string, ts timestamp_ntz, price double, seq long"


def stream(spark, tmp_path, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [("A", datetime(2024, 1, 1, h, m), 100.0 + h - m, h * 60 + m) for h in range(3) for m in (0, 20, 40)]
    source = stream(spark, tmp_path, [rows[:4], rows[4:]])
    batch = spark.createDataFrame(rows, TICKS)
    got = Q.run_dry(Q.latest(source), "latest_quotes", "complete", f"{tmp_path}/c1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, Q.latest(batch).collect()))
    got = Q.run_dry(Q.bars(source), "hour_bars", "complete", f"{tmp_path}/c2")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, Q.bars(batch).collect()))
    late = Q.run_dry(Q.bars(source, late="10 minutes"), "closed_bars", "append", f"{tmp_path}/c3")
    assert set(map(tuple, late.collect())) <= set(map(tuple, Q.bars(batch).collect()))
    assert Q.alive(Q.latest(batch), datetime(2024, 1, 1, 2, 40, 2)).count() == 1 and Q.alive(Q.latest(batch), datetime(2024, 1, 1, 2, 40, 4)).count() == 0


def test_alerts_fire_once_in_a_stream(spark, tmp_path):
    rows = [("A", datetime(2024, 1, 1, 0, m), 100.0 + m, m) for m in range(6)]
    alerts = spark.createDataFrame([(1, "A", "above", 102.0, "active"), (2, "A", "below", 50.0, "active"), (3, "A", "above", 101.0, "disabled")], "alert_id long, symbol string, condition string, target_price double, status string")
    got = Q.run_dry(Q.alert_stream(stream(spark, tmp_path, [rows[:3], rows[3:]]), alerts), "fired", "append", f"{tmp_path}/c")
    fired = [(r.alert_id, r.price) for r in got.collect()]
    assert [x[0] for x in fired] == [1] and fired[0][1] >= 102.0


def test_predictions_are_validated(spark):
    from datetime import timedelta

    from quantloom.operators import scoring as S

    rows = [(s, datetime(2024, 1, 1) + timedelta(days=i), 100.0 + (i * (3 + k)) % 17, 120.0 + (i * (3 + k)) % 17, 90.0, 101.0 + (i * (5 + k)) % 13, 10 + i % 7) for k, s in enumerate("AB") for i in range(150)]
    got = S.gbt_validated(S.features(bars(spark, rows)), trees=3).collect()
    assert {r.symbol for r in got} == {"A", "B"}
    for r in got:
        assert 0 <= r.confidence_lower <= r.rise_probability <= r.confidence_upper <= 1 and 0 <= r.accuracy <= 1 and r.validation_samples >= 30
    with pytest.raises(ValueError, match="too few rows"):
        S.gbt_validated(S.features(bars(spark, rows[:40])), trees=3)


def test_fingerprints_follow_content(spark):
    from quantloom.operators import scoring as S

    a = spark.createDataFrame([("x", 1, 2.0), ("x", 2, 3.0), ("y", 1, 2.0)], "symbol string, at int, close double")
    one = {r.symbol: r.fingerprint for r in S.content_fingerprint(a, ["symbol"], ["at", "close"]).collect()}
    again = {r.symbol: r.fingerprint for r in S.content_fingerprint(a.orderBy(F.desc("at")), ["symbol"], ["at", "close"]).collect()}
    other = {r.symbol: r.fingerprint for r in S.content_fingerprint(a.withColumn("close", F.col("close") + 1), ["symbol"], ["at", "close"]).collect()}
    assert one == again and one["x"] != other["x"] and one["x"] != one["y"] and len(one["x"]) == 64


def test_an_axis_that_fails_is_missing_alone(spark):
    from quantloom.operators import scoring as S

    symbols = spark.createDataFrame([("a",), ("b",)], "symbol string")
    axes = {"technical": spark.createDataFrame([("a", 60.0), ("b", float("nan"))], "symbol string, score double"), "news": spark.createDataFrame([("b", 40.0)], "symbol string, score double")}
    got = {r.symbol: r for r in S.joined_axes(symbols, axes).collect()}
    assert (got["a"].technical, got["a"].news, got["a"].risk) == (60.0, None, None) and (got["b"].technical, got["b"].news) == (None, 40.0)


def test_bounds_and_lookups(spark):
    from quantloom.operators import guards as G

    assert G.within("limit", 500) == 500
    with pytest.raises(ValueError):
        G.within("limit", 501)
    rows, table = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="not found: 2"):
        G.looked_up(rows, table, "k", "v").collect()
    with pytest.raises(Exception, match="not found: 2"):
        G.looked_up(rows, table, "k", "v").select("k").collect()
    assert [r.k for r in G.missing(rows, table, "k").collect()] == [2]


def test_sanitized_payloads(spark):
    import json

    deep = {"a": {"b": {"c": {"d": {"e": 1, "secret": 2}}}}, "Password": {"x": 1}, "n": list(range(25)), "text": "Bearer abc.def and secret=1, ok", "none": None, "f": 1.5, "yes": True, "z": "5", "obj": '{"token":1}'}
    wide = {f"k{39 - i}": i for i in range(40)}
    cases = {
        "deep": json.dumps(deep), "wide": json.dumps(wide), "text": '"token=abc ünï \\"q\\" \\n"', "number": " 12345678901234567890 ", "null": "null", "long": json.dumps("x" * 600), "empty": "{}", "none": "[]",
        "list": json.dumps([[[[[1, "a"]]]], {"cookie": "c", "k": [{"ssn": 1, "v": "password: p"}]}]), "broken": '{"a": 1', "words": "not json", "blank": "", "keys": json.dumps({"x" * 150: 1, "a token": 2, "k=secret=s": 3}),
    }
    df = spark.createDataFrame([*cases.items(), ("missing", None)], "id string, payload string")
    got = {r.id: r.clean for r in df.select("id", X.sanitize(F.col("payload")).alias("clean")).collect()}
    out = json.loads(got["deep"])
    assert out["a"]["b"]["c"]["d"] == {"e": "[TRUNCATED]", "secret": "[REDACTED]"} and out["Password"] == "[REDACTED]" and out["n"] == [*range(20), "[TRUNCATED]"]
    assert out["text"] == "Bearer [REDACTED] and secret=[REDACTED], ok" and out["none"] is None and out["f"] == 1.5 and out["yes"] is True and out["z"] == "5" and out["obj"] == '{"token":1}'
    assert list(out) == list(deep)
    assert json.loads(got["wide"]) == dict(list(wide.items())[:30]) | {"_truncated": True} and list(json.loads(got["wide"]))[:2] == ["k39", "k38"]
    assert json.loads(got["text"]) == 'token=[REDACTED] ünï "q" \n' and got["number"] == "12345678901234567890" and got["null"] == "null" and json.loads(got["long"]) == "x" * 500 + "…"
    assert got["empty"] == "{}" and got["none"] == "[]"
    assert json.loads(got["list"]) == [[[[["[TRUNCATED]", "[TRUNCATED]"]]]], {"cookie": "[REDACTED]", "k": [{"ssn": "[REDACTED]", "v": "password=[REDACTED]"}]}]
    assert json.loads(got["keys"]) == {"x" * 100 + "…": 1, "a token": "[REDACTED]", "k=secret=[REDACTED]": "[REDACTED]"}
    assert got["broken"] is None and got["words"] is None and got["blank"] is None and got["missing"] is None
