"""Artifacts, verification, approval, latency and boosted trees."""

import hashlib
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.operators import approval as AP
from quantloom.operators import boosting as BO
from quantloom.operators import latency as L
from quantloom.operators import verification as V
from quantloom.sources import artifacts, sinks

MODELS = "version string, symbol string, algorithm string, horizon_days int, payload binary, validation_status string, metrics map<string,double>"
WANTED = "version string, symbol string, algorithm string, horizon_days int"


def models(spark, rows):
    return spark.createDataFrame([(v, s, "gbt", 5, p, "experimental", {"accuracy": 0.5}) for v, s, p in rows], MODELS)


def wanted(spark, rows):
    return spark.createDataFrame([(v, s, "gbt", 5) for v, s in rows], WANTED)


def pointers(spark, root):
    return {r.symbol: (r.version, r.previous_version, r.error) for r in artifacts.current(spark, root).collect()}


def content(root, payload):
    digest = hashlib.sha256(payload).hexdigest()
    return f"{root}/content/{digest[:2]}/{digest}"


def test_artifacts_are_staged_activated_and_rolled_back(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(artifacts.ArtifactError, match="nothing is published"):
        artifacts.current(spark, root)
    artifacts.stage(spark, root, models(spark, [("v1", "A", b"one"), ("v2", "A", b"two"), ("w1", "B", b"one"), ("w1", "B", b"one")]))
    assert open(content(root, b"one"), "rb").read() == b"one"
    artifacts.activate(spark, root, wanted(spark, [("v1", "A"), ("w1", "B")]))
    assert pointers(spark, root) == {"A": ("v1", None, None), "B": ("w1", None, None)}
    artifacts.activate(spark, root, wanted(spark, [("v2", "A")]))
    assert pointers(spark, root) == {"A": ("v2", "v1", None), "B": ("w1", None, None)}
    artifacts.rollback(spark, root, wanted(spark, [("", "A")]))
    assert pointers(spark, root)["A"] == ("v1", "v2", None)
    artifacts.rollback(spark, root, wanted(spark, [("", "A")]))
    assert pointers(spark, root)["A"] == ("v2", "v1", None)
    manifests = sinks.published(spark, root, "manifests")
    assert {r.version: bytes(r.content) for r in artifacts.payloads(manifests, root).collect()} == {"v1": b"one", "v2": b"two", "w1": b"one"}
    # what is staged again stays as it is
    artifacts.stage(spark, root, models(spark, [("v1", "A", b"other")]))
    assert sinks.published(spark, root, "manifests").where("version = 'v1'").first().sha256 == hashlib.sha256(b"one").hexdigest()


def test_artifacts_that_are_refused_change_nothing(spark, tmp_path):
    root = str(tmp_path)
    artifacts.stage(spark, root, models(spark, [("v1", "A", b"one"), ("v2", "A", b"two"), ("w1", "B", b"three")]))
    artifacts.activate(spark, root, wanted(spark, [("v1", "A")]))
    before, number = pointers(spark, root), sinks.newest(spark, root)
    for rows, message in (([("v9", "A")], "unknown version"), ([("w1", "A")], "another scope"), ([("v1", "A"), ("v2", "A")], "wanted twice")):
        with pytest.raises(artifacts.ArtifactError, match=message):
            artifacts.activate(spark, root, wanted(spark, rows))
    with pytest.raises(artifacts.ArtifactError, match="without a version before"):
        artifacts.rollback(spark, root, wanted(spark, [("", "A"), ("", "B")]))
    bad = [[("../x", "A", b"1")], [("v", "a!", b"1")], [("v", "A", b"")], [("v", "A", None)], [("v", "A", b"1"), ("v", "A", b"2")], [("v1", "B", b"one")]]
    for rows in bad:
        with pytest.raises(artifacts.ArtifactError):
            artifacts.stage(spark, root, models(spark, rows))
    # a damaged content: one of two is enough for none to become active
    with open(content(root, b"two"), "wb") as f:
        f.write(b"tow")
    with pytest.raises(artifacts.ArtifactError, match="checksum"):
        artifacts.activate(spark, root, wanted(spark, [("v2", "A"), ("w1", "B")]))
    os.unlink(content(root, b"three"))
    with pytest.raises(artifacts.ArtifactError, match="missing"):
        artifacts.activate(spark, root, wanted(spark, [("w1", "B")]))
    with open(content(root, b"one"), "ab") as f:
        f.write(b"!")
    assert sinks.newest(spark, root) == number and pointers(spark, root) == {"A": (*before["A"][:2], "size")}


def test_a_writer_that_was_overtaken_starts_anew(spark, tmp_path):
    root, seen = f"file://{tmp_path}/store", []

    def add(value, meanwhile=None):
        def change(read):
            old = read("t", "v int")
            seen.append((value, sorted(r.v for r in old.collect())))
            if meanwhile and len(seen) == 1:
                meanwhile()
            return {"t": old.unionByName(spark.createDataFrame([(value,)], "v int"))}

        return change

    sinks.updated(spark, root, add(1, lambda: sinks.updated(spark, root, add(2))))
    assert seen == [(1, []), (2, []), (1, [2])]
    assert sorted(r.v for r in sinks.published(spark, root, "t").collect()) == [1, 2]
    with pytest.raises(sinks.Conflict):
        sinks.publish(spark, {"t": spark.range(1)}, root, after=0)
    assert sinks.newest(spark, root) == 2


SOURCES = "name string, authority string, markets array<string>, integration_status string, corporate_action_data boolean, effective_date_field_status string, verification_role string, reference_url string"
RESULTS = "request_id int, source string, symbol string, action_type string, requested_effective_at timestamp, matched_effective_at timestamp, fetched_at timestamp, exact_match boolean, evidence_id string, evidence_url string"
DAY, NEXT = datetime(2026, 1, 2), datetime(2026, 1, 3)


def test_verification_gives_every_reason(spark):
    good = ("ok", "Exchange", ["US"], "verified", True, "verified", "primary", "https://Ok.example/ref")
    change = lambda **c: tuple(c.get(n.split()[0], v) for n, v in zip(SOURCES.split(", "), good))
    sources = [good, change(name="twice"), change(name="twice"), change(name="Bad"), change(name="dateless", effective_date_field_status="absent"), change(name="paper", integration_status="requires_contract"), change(name="nowhere", markets=[]), change(name="odd", verification_role="x"), change(name="plain", reference_url="http://ok.example"), change(name="null", authority=None)]
    faults = [(r.name, r.fault) for r in V.source_faults(spark.createDataFrame(sources, SOURCES)).collect()]
    assert sorted(faults, key=repr) == sorted([("ok", None), ("twice", "duplicate_source"), ("twice", "duplicate_source"), ("Bad", "invalid_metadata"), ("dateless", "verified_without_effective_date"), ("paper", None), ("nowhere", "invalid_metadata"), ("odd", "invalid_metadata"), ("plain", "invalid_metadata"), ("null", "invalid_metadata")], key=repr)
    answer = {"source": "ok", "symbol": "S", "action_type": "split", "requested_effective_at": DAY, "matched_effective_at": DAY, "fetched_at": DAY, "exact_match": True, "evidence_id": "E", "evidence_url": "https://ok.example/e?x=1"}
    cases = [
        (None, "ok", DAY, {}), (None, "ok", DAY, {"matched_effective_at": NEXT, "exact_match": False}), ("effective_at_missing", "ok", None, {}), ("source_not_found", "none", DAY, {}), ("source_not_found", None, DAY, {}), ("source_at_fault", "twice", DAY, {"source": "twice"}), ("source_not_verified", "paper", DAY, {"source": "paper"}),
        ("no_result", "ok", DAY, None), ("ambiguous_result", "ok", DAY, [{}, {}]), ("result_time_missing", "ok", DAY, {"fetched_at": None}), ("result_time_missing", "ok", DAY, {"matched_effective_at": None}), ("mismatched_provenance", "ok", DAY, {"symbol": "T"}), ("mismatched_provenance", "ok", DAY, {"source": "paper"}),
        ("mismatched_provenance", "ok", DAY, {"action_type": None}), ("mismatched_provenance", "ok", DAY, {"requested_effective_at": NEXT}), ("inconsistent_match_flag", "ok", DAY, {"exact_match": False}), ("inconsistent_match_flag", "ok", DAY, {"exact_match": None}), ("inconsistent_match_flag", "ok", DAY, {"matched_effective_at": NEXT}),
        ("invalid_evidence", "ok", DAY, {"evidence_id": " "}), *[("invalid_evidence", "ok", DAY, {"evidence_url": u}) for u in (None, "http://ok.example/", "https://evil.example/", "https://ok.example.evil/", "https://u@ok.example/", "https://ok.example:444/", "https://ok.example/#f", "no address")], (None, "ok", DAY, {"evidence_url": "https://OK.example:443/x"}),
    ]
    requests = spark.createDataFrame([(k, s, " s ", "split", at) for k, (_, s, at, _) in enumerate(cases)], "request_id int, source string, symbol string, action_type string, effective_at timestamp")
    results = [(k, *(answer | more).values()) for k, (*_, given) in enumerate(cases) if given is not None for more in (given if isinstance(given, list) else [given])]
    got = {r.request_id: r for r in V.verify(requests, spark.createDataFrame(sources, SOURCES), spark.createDataFrame(results, RESULTS)).collect()}
    assert [got[k].reason for k in range(len(cases))] == [c[0] for c in cases]
    assert all((r.evidence_id is None) == (r.reason is not None) for r in got.values())
    status = V.registry_status(spark.createDataFrame(sources, SOURCES)).first()
    assert (status.registered, status.sound, status.verified, status.automatic_lookup) == (10, 2, 1, True)
    assert not V.registry_status(spark.createDataFrame([], SOURCES)).first().automatic_lookup


CANDIDATES = "symbol string, receipt_no string, action_type string, filed_on date, decision_date date, record_date date, price_factor decimal(24,12), volume_factor decimal(24,12), report_name string, remarks string, correction_hint boolean, superseded_hint boolean, source string, evidence_url string"
REQUESTS = "request_id int, source string, symbol string, group_hint string, receipt_no string, effective_at timestamp, exchange_evidence_url string, confirmation string"
NOW = datetime(2026, 2, 1)


def shown(spark, receipts=("20260105000001", "20260106000002"), wrong=False, factor="0.5"):
    from decimal import Decimal

    d = datetime(2026, 1, 4).date()
    f = None if factor is None else Decimal(factor)
    url = "https://dart.fss.or.kr/v?a=1&rcpNo="
    return spark.createDataFrame([("A", r, "stock_dividend", datetime.strptime(r[:8], "%Y%m%d").date(), d, None, f, Decimal(2), "report", None, False, False, "dart", url + ("9" if wrong else r)) for r in receipts], CANDIDATES)


def hint(spark, df):
    from quantloom.operators.actions import revision_groups

    return revision_groups(df).first().group_hint


def asked(spark, group, rows=((1, {}),)):
    base = {"source": "dart", "symbol": " a", "group_hint": group, "receipt_no": "20260105000001", "effective_at": DAY, "exchange_evidence_url": "https://kind.krx.co.kr/x?y=1", "confirmation": AP.CONFIRMATION}
    return spark.createDataFrame([(k, *(base | more).values()) for k, more in rows], REQUESTS)


def test_approval_errors_and_action(spark):
    group = hint(spark, shown(spark))
    rows = [(0, {}), (1, {"confirmation": "yes"}), (2, {"source": "krx"}), (3, {"effective_at": None}), (4, {"exchange_evidence_url": "https://evil.example/"}), (5, {"exchange_evidence_url": "https://kind.krx.co.kr/#x"}), (6, {"group_hint": "candidate:0"}), (7, {"receipt_no": "20260107000003"}), (8, {"receipt_no": "20260106000002"})]
    found = {r.request_id: r for r in AP.reviewed(asked(spark, group, rows), shown(spark), F.lit(NOW)).collect()}
    assert [found[k].error for k in range(9)] == [None, "confirmation", "source", "effective_at", "exchange_evidence", "exchange_evidence", "group_changed", "group_changed", None]
    assert found[0].announced_at == datetime(2026, 1, 4, 15) and found[0].known_at == NOW and found[0].event_id == "reviewed:" + group.removeprefix("candidate:")
    assert AP.reviewed(asked(spark, group), shown(spark, wrong=True), F.lit(NOW)).first().error == "filing_evidence"
    assert AP.reviewed(asked(spark, group), shown(spark, factor=None), F.lit(NOW)).first().error == "factors_incomplete"
    receipts = spark.createDataFrame([("https://dart.fss.or.kr/v?rcpNo=1&rcpNo=1",), ("https://dart.fss.or.kr/v?rcpNo=1",), ("https://dart.fss.or.kr/v?xrcpNo=1",)], "u string")
    assert [r[0] for r in receipts.select(AP.filing_of(F.col("u"), F.lit("1"))).collect()] == [False, True, False]


def test_approvals_are_made_once(spark, tmp_path):
    root, df = f"file://{tmp_path}/store", shown(spark)
    group = hint(spark, df)
    both = asked(spark, group, [(1, {}), (2, {}), (3, {"receipt_no": "20260106000002"}), (4, {"confirmation": None})])
    first = {r.request_id: (r.error, r.created) for r in AP.approve(spark, root, both, lambda: df, F.lit(NOW)).collect()}
    assert first == {1: (None, True), 2: (None, False), 3: (None, True), 4: ("confirmation", False)}
    again = AP.approve(spark, root, both, lambda: df, F.lit(NOW + timedelta(days=1))).collect()
    assert not any(r.created for r in again)
    stored = sinks.published(spark, root, "actions").collect()
    assert sorted((r.receipt_no, r.revision, r.known_at, r.source) for r in stored) == [("20260105000001", 1, NOW, "dart-reviewed"), ("20260106000002", 2, NOW, "dart-reviewed")]


def test_two_writers_approve_the_same_once(spark, tmp_path):
    """A second writer publishes between the first one's reading and writing, and
    one candidate is withdrawn meanwhile: the first starts anew on both."""
    root, whole = f"file://{tmp_path}/store", shown(spark)
    group, reads = hint(spark, whole), []

    def candidates():
        reads.append(1)
        if len(reads) == 1:
            AP.approve(spark, root, asked(spark, group), lambda: whole, F.lit(NOW))
            return whole
        return whole.where("receipt_no = '20260105000001'")

    got = {r.request_id: (r.error, r.created) for r in AP.approve(spark, root, asked(spark, group, [(1, {}), (3, {"receipt_no": "20260106000002"})]), candidates, F.lit(NOW)).collect()}
    assert len(reads) == 2 and got == {1: (None, False), 3: ("group_changed", False)}
    assert sinks.published(spark, root, "actions").count() == 1 and sinks.newest(spark, root) == 2


def t(seconds):
    return datetime(2026, 1, 1) + timedelta(seconds=seconds)


def test_rates_with_resets_and_gaps(spark):
    samples = [("a", t(s), v) for s, v in ((15, 0.0), (75, 60.0), (135, 120.0), (195, 10.0), (255, 70.0))] + [("b", t(0), 5.0), ("b", t(60), 5.0), ("c", t(10), 1.0), ("d", t(0), None)]
    got = {(r.k, r.at): r.rate for r in L.rates(spark.createDataFrame(samples, "k string, at timestamp, v double"), ["k"], "v", 300, 60).collect()}
    # 60 + 60 + 10 + 60 grown over 240 s, whose ends are near: front 15 s, but 0 is at the first sample; back 45 s
    assert got["a", t(300)] == pytest.approx(190 * (240 + 0 + 45) / 240 / 300)
    assert got["a", t(120)] == pytest.approx(60 * (60 + 0 + 45) / 60 / 300)
    assert got["b", t(60)] == 0.0 and ("c", t(60)) not in got and not any(k == "d" for k, _ in got)
    assert ("a", t(60)) not in got and ("a", t(540)) not in got


def test_quantiles_within_buckets(spark):
    inf = float("inf")
    rows = [("x", 0.1, 10.0), ("x", 0.5, 30.0), ("x", 1.0, 40.0), ("x", inf, 40.0), ("open", 0.1, 1.0), ("open", inf, 10.0), ("none", 0.1, 0.0), ("none", inf, 0.0), ("low", 0.1, 4.0), ("low", inf, 4.0), ("shut", 0.1, 1.0), ("shut", 0.5, 1.0), ("fall", 0.1, 8.0), ("fall", 0.5, 6.0), ("fall", inf, 10.0)]
    df = spark.createDataFrame(rows, "k string, le double, v double")
    got = {r.k: r.quantile for r in L.quantile(df, ["k"], "v", 0.5).collect()}
    assert got == {"x": pytest.approx(0.3), "open": 0.1, "none": None, "low": pytest.approx(0.05), "shut": None, "fall": pytest.approx(0.0625)}
    assert {r.k: r.quantile for r in L.quantile(df, ["k"], "v", 0.95).collect()}["x"] == pytest.approx(0.9)
    requests = spark.createDataFrame([("r", 0.0), ("r", 0.005), ("r", 0.3), ("r", 99.0), ("r", None), ("r", float("nan"))], "route string, d double")
    found = {r.le: r.n for r in L.bucketed(requests, ["route"], "d", F.lit(t(0))).collect()}
    assert found[0.005] == 2 and found[0.25] == 2 and found[0.5] == 3 and found[10.0] == 3 and found[inf] == 4 and len(found) == 15


def test_alerts_fire_after_their_time(spark):
    rows = [("a", t(60 * k), v) for k, v in enumerate([0.0, 1.0, 1.0, 1.0, None, 1.0, 1.0, 1.0, 1.0, 0.0])]
    got = [r.state for r in L.firing(spark.createDataFrame(rows, "k string, at timestamp, v double"), ["k"], F.col("v") > 0.5, 120).orderBy("at").collect()]
    assert got == ["inactive", "pending", "pending", "firing", "inactive", "pending", "pending", "firing", "firing", "inactive"]
    samples = [("200", t(s), float(s)) for s in range(0, 600, 30)] + [("503", t(s), s / 4) for s in range(0, 600, 30)]
    shares = L.error_share(spark.createDataFrame(samples, "status string, at timestamp, n double"), ["status"], "status", "n").collect()
    assert shares and all(r.error_share == pytest.approx(0.2) for r in shares)


def plain_trees(x, y, train, p):
    """Margins of level-wise boosting over bins, one symbol, all rows and features seen."""
    import numpy as np

    margin = np.zeros(len(y))
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        node = np.ones(len(y), int)
        for _ in range(p.depth):
            after = node.copy()
            for k in set(node[train]):
                own = train & (node == k)
                best = None
                for f in range(x.shape[1]):
                    for b in sorted(set(x[own, f])):
                        left, right = own & (x[:, f] <= b), own & (x[:, f] > b)
                        if h[left].sum() >= p.least_weight and h[right].sum() >= p.least_weight:
                            worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + p.penalty)
                            gain = round(worth(left) + worth(right) - worth(own), 9)
                            if gain > 1e-9 and (best is None or gain > best[0]):
                                best = gain, f, b
                if best:
                    here = node == k
                    after[here] = 2 * k + (x[here, best[1]] > best[2])
            node = after
        for k in set(node):
            own = train & (node == k)
            if own.any():
                margin[node == k] += p.rate * -g[own].sum() / (h[own].sum() + p.penalty)
    return margin


def test_trees_of_all_symbols_are_those_of_each(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for s in ("A", "B", "C"):
        for fold in (0, 1):
            v = rng.integers(0, 12, (90, 3)).astype(float)
            y = ((v[:, 0] > 5) ^ (v[:, 1] > 8) ^ (rng.random(90) < 0.15)).astype(int)
            rows += [(s, fold, i, "train" if i < 70 else "test", int(y[i]), float(v[i, 0]) if i % 11 else None, float(v[i, 1]), float(v[i, 2])) for i in range(90)]
    df = spark.createDataFrame(rows, "symbol string, fold int, n int, role string, label int, a double, b double, c double")
    p = BO.Boosting(trees=4, rate=0.3, row_share=1.0, feature_share=1.0, bins=64)
    got = {(r.symbol, r.fold, r.n): r.probability for r in BO.boosted(df, ["a", "b", "c"], p).collect()}
    assert len(got) == len(rows)
    for s in ("A", "B", "C"):
        for fold in (0, 1):
            own = [r for r in rows if r[:2] == (s, fold)]
            train = np.array([r[3] == "train" for r in own])
            x = np.zeros((len(own), 3), int)
            for f in range(3):
                values = [r[5 + f] for r in own]
                cuts = sorted({v for v, t_ in zip(values, train) if t_ and v is not None})
                x[:, f] = [0 if v is None else sum(c < v for c in cuts) for v in values]
            margin = plain_trees(x, np.array([r[4] for r in own]), train, p)
            assert np.allclose([got[s, fold, r[2]] for r in own], 1 / (1 + np.exp(-margin)), atol=1e-6)


def test_each_symbol_is_predicted_by_its_own_model(spark):
    from quantloom.operators import scoring as S

    rows = [(s, datetime(2024, 1, 1) + timedelta(days=i), 100.0 + (i * (3 + k)) % 17, 120.0 + (i * (3 + k)) % 17, 90.0, 101.0 + (i * (5 + k)) % 13, 10 + i % 7) for k, s in enumerate("AB") for i in range(150)]
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint"
    p = BO.Boosting(trees=3)
    both = {r.symbol: tuple(r) for r in BO.predicted(S.features(spark.createDataFrame(rows + [("few", *r[1:]) for r in rows[:40]], schema)), p=p).collect()}
    assert set(both) == {"A", "B"}
    alone = BO.predicted(S.features(spark.createDataFrame(rows[:150], schema)), p=p).collect()
    assert [tuple(r) for r in alone] == [both["A"]]
    for r in both.values():
        assert 0 <= r[3] <= r[2] <= r[4] <= 1 and 0 <= r[5] <= 1 and r[7] >= 30
    assert json.dumps([str(x) for x in both["A"]]) != json.dumps([str(x) for x in both["B"]])
