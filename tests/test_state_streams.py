"""Streams with state: values that expire, counted subscriptions, delivery."""

import time
from datetime import datetime, timedelta

import pytest

from quantloom.streaming import quotes as Q
from quantloom.streaming import state as S

TICKS = "symbol string, ts timestamp_ntz, price double, seq long"
EVENTS = "hub string, symbol string, connection string, action string, seq long, ts timestamp_ntz"
START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    S.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def files(spark, path, schema, parts):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05)  # files are taken in order of their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def wait_for(spark, name, n, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        found = spark.table(name).collect()
        if len(found) >= n:
            return found
        time.sleep(0.2)
    raise AssertionError(f"{len(found)} of {n} rows")


def test_values_expire_by_themselves(spark, tmp_path):
    asks = "symbol string, request string"
    files(spark, tmp_path / "q", TICKS, [[("a", at(0), 1.0, 1), ("A", at(5), 2.0, 3), ("a", at(5), 9.0, 2)]])
    lookups = files(spark, tmp_path / "l", asks, [[("zz", "r0")]])
    found = S.cached(spark.readStream.schema(TICKS).parquet(str(tmp_path / "q")), lookups, 6)
    query = found.writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        assert [(r.request, r.price) for r in wait_for(spark, "held", 1)] == [("r0", None)]
        spark.createDataFrame([("A", at(6), 3.0, 4), ("a", at(2), 7.0, 9)], TICKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "q"))
        spark.createDataFrame([("a", "r1")], asks).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
        held = {r.request: (r.ts, r.price) for r in wait_for(spark, "held", 2)}
        assert held["r1"] in ((at(6), 3.0), (at(5), 2.0))
        time.sleep(8)
        spark.createDataFrame([("a", "r2")], asks).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
        assert {r.request: r.price for r in wait_for(spark, "held", 3)}["r2"] is None
    finally:
        query.stop()


def test_expiries_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rows = [("a", at(0), 1.0, 1), ("a", at(2), 2.0, 2), ("a", at(9), 3.0, 4), ("a", at(9), 3.5, 5), ("b", at(1), 4.0, 6), ("b", at(4), 5.0, 7), ("a", at(30), 6.0, 8), ("b", at(61), 7.0, 9)]
    late = [rows[0], rows[2], rows[4]], [rows[1], rows[5], rows[3]], [rows[6]], [rows[7]]
    got = Q.run_dry(S.expiry_stream(files(spark, tmp_path / "q", TICKS, late), 3, "20 seconds"), "over", "append", str(tmp_path / "c"))
    batch = {tuple(r) for r in S.expiries(spark.createDataFrame(rows, TICKS), 3).collect()}
    assert batch == {("a", at(2), 2.0, at(5)), ("a", at(9), 3.5, at(12)), ("b", at(4), 5.0, at(7)), ("a", at(30), 6.0, at(33)), ("b", at(61), 7.0, at(64))}
    assert {tuple(r) for r in got.collect()} == {r for r in batch if r[3] < at(41)}


def plain_registry(events, most_symbols, most_connections):
    listens, left, out = {}, {}, []
    for hub, symbol, connection, action, seq, _ in events:
        symbol, who = symbol.strip().upper(), (hub, symbol.strip().upper(), connection)
        own = [k for k in listens if k[0] == hub]
        n = sum(k[1] == symbol for k in own)
        if seq <= max(listens.get(who, -1), left.get(who, -1)):
            outcome = "late"
        elif action == "unsubscribe":
            outcome = "unsubscribed" if listens.pop(who, None) is not None else "not_subscribed"
            n -= outcome == "unsubscribed"
            left[who] = seq
        elif who in listens:
            outcome, listens[who] = "already_subscribed", seq
        elif len(own) >= most_connections:
            outcome = "connection_capacity"
        elif n == 0 and len({k[1] for k in own}) >= most_symbols:
            outcome = "symbol_capacity"
        else:
            outcome, listens[who], n = "subscribed", seq, n + 1
        out.append((hub, symbol, connection, seq, outcome, n))
    return out


def test_registry(spark, tmp_path):
    import random

    rng = random.Random(4)
    events = [(rng.choice(["h1", "h2"]), rng.choice(["aa", "BB", " cc ", "dd"]), f"c{rng.randrange(5)}", rng.choice(["subscribe", "subscribe", "unsubscribe"]), k, at(k)) for k in range(120)]
    batches = [events[i : i + 40] for i in range(0, 120, 40)]
    # late and double events come with the next batch
    batches[1] = sorted(batches[1] + batches[0][:15], key=lambda e: e[4])
    batches[2] = sorted(batches[2] + batches[1][:9] + batches[2][:9], key=lambda e: e[4])
    got = Q.run_dry(S.registry_stream(files(spark, tmp_path / "e", EVENTS, batches), 2, 4, "10 minutes"), "registered", "append", str(tmp_path / "c")).collect()
    want = plain_registry([e for b in batches for e in sorted(b, key=lambda e: (e[4], e[2]))], 2, 4)
    assert sorted(r[:6] for r in map(tuple, got)) == sorted(want)
    assert {x[4] for x in want} == {"late", "subscribed", "unsubscribed", "already_subscribed", "not_subscribed", "connection_capacity", "symbol_capacity"}
    assert all(r.first == (r.outcome == "subscribed" and r.subscribers == 1) and r.last == (r.outcome == "unsubscribed" and r.subscribers == 0) for r in got)


def test_registry_without_caps_is_its_batch_twin(spark, tmp_path):
    events = [("h", "a", "1", "subscribe", 1, at(1)), ("h", "a", "2", "subscribe", 2, at(2)), ("h", "a", "1", "unsubscribe", 4, at(4)), ("h", "a", "1", "subscribe", 3, at(3)), ("h", "b!", "1", "subscribe", 5, at(5)), ("h", "b", "3", "subscribe", 6, at(6)), ("h", "b", "3", "subscribe", 6, at(6)), (None, "b", "3", "subscribe", 6, at(6)), ("h", "c", None, "jump", 7, at(7))]
    got = Q.run_dry(S.registry_stream(files(spark, tmp_path / "e", EVENTS, [events])), "alone", "append", str(tmp_path / "c")).collect()
    assert sorted(r.outcome for r in got) == ["already_subscribed", "invalid", "invalid", "late", "subscribed", "subscribed", "subscribed", "unsubscribed"]
    assert {(r.hub, r.symbol): r.subscribers for r in S.registry(spark.createDataFrame(events, EVENTS)).collect()} == {("h", "A"): 1, ("h", "B"): 1}


def test_quotes_go_to_the_hubs_that_want_them(spark, tmp_path):
    changes = "symbol string, hub string, wants boolean, ts timestamp_ntz"
    wanted = files(spark, tmp_path / "w", changes, [[("A", "h1", True, at(2)), ("A", "h2", True, at(3)), ("A", "h1", False, at(5)), ("B", "h3", True, at(20))]])
    ticks = [("A", at(1), 1.0, 1), ("A", at(2), 2.0, 2), ("A", at(4), 3.0, 3), ("A", at(6), 4.0, 4), ("B", at(1), 9.0, 5), ("C", at(1), 9.0, 6)]
    got = Q.run_dry(S.delivered(files(spark, tmp_path / "q", TICKS, [ticks]), wanted, 3), "given", "append", str(tmp_path / "c"))
    assert sorted(tuple(r) for r in got.collect()) == [("A", "h1", at(1), 1.0, True), ("A", "h1", at(2), 2.0, False), ("A", "h1", at(4), 3.0, False), ("A", "h2", at(2), 2.0, True), ("A", "h2", at(4), 3.0, False), ("A", "h2", at(6), 4.0, False)]
