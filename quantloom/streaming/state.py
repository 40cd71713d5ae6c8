"""Streams with state of their own: latest values that expire by themselves, and
subscriptions counted by reference, to which quotes are delivered.

The processors need Spark's RocksDB state store. Each has a batch twin of plain
DataFrame operations that says what the stream has said once all is settled.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quantloom.operators.guards import SYMBOL
from quantloom.sources.shared import ship
from quantloom.streaming.quotes import TTL_SECONDS

#: Fixed caps of a hub.
MOST_SYMBOLS, MOST_CONNECTIONS = 40, 200
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that the processors here need; set before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Cache(StatefulProcessor):
    """The newest quote of a symbol, held for ttl_seconds after it was written."""

    def __init__(self, ttl_seconds: float):
        self.ttl = int(ttl_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.quote = handle.getValueState("quote", "ts timestamp_ntz, seq long, price double", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            told = frame[frame["request"].isna()]
            if len(told):
                new = told.sort_values(["ts", "seq"]).iloc[-1]
                new = (new["ts"].to_pydatetime(), int(new["seq"]), float(new["price"]))
                old = self.quote.get()
                if old is None or tuple(old)[:2] <= new[:2]:
                    self.quote.update(new)
            asked = frame[frame["request"].notna()]
            if len(asked):
                held = self.quote.get()
                ts, price = (None, None) if held is None else (held[0], held[2])
                yield pd.DataFrame({"symbol": key[0], "request": asked["request"], "ts": pd.Series([ts] * len(asked), asked.index, "datetime64[us]"), "price": pd.Series([price] * len(asked), asked.index, "float64")})

    def close(self) -> None:
        pass


def cached(quotes: DataFrame, lookups: DataFrame, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """lookups (symbol, request) answered from a stream of quotes (symbol, ts,
    seq, price): the newest quote of the symbol, or nulls where none was written
    within ttl_seconds of the clock. An older quote does not replace a newer one.

    The state of a symbol is one row, which the store drops by itself; a symbol
    that falls silent costs nothing afterwards. Of what comes in one batch, quotes
    stand before lookups. Null requests are quotes; null prices are held as they are.
    """
    ship(quotes.sparkSession)
    told = quotes.select(F.upper("symbol").alias("symbol"), F.lit(None).cast("string").alias("request"), "ts", "seq", F.col("price").cast("double").alias("price"))
    none = lambda kind: F.lit(None).cast(kind)
    asked = lookups.where("request is not null").select(F.upper("symbol").alias("symbol"), F.col("request").cast("string").alias("request"), none("timestamp_ntz").alias("ts"), none("long").alias("seq"), none("double").alias("price"))
    return told.unionByName(asked).groupBy("symbol").transformWithStateInPandas(Cache(ttl_seconds), "symbol string, request string, ts timestamp_ntz, price double", "append", "processingTime")


def micros(at: datetime) -> int:
    return int(at.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000 + at.microsecond


class Expiry(StatefulProcessor):
    """The quotes of a symbol that may still be the last for ttl_seconds."""

    def __init__(self, ttl_seconds: float):
        self.ttl = int(ttl_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at long", "seq long, price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            newest = frame.sort_values("seq").drop_duplicates("at", keep="last")
            for at, seq, price in zip(newest["at"].tolist(), newest["seq"].tolist(), newest["price"].tolist()):
                old = self.held.getValue((at,)) if self.held.containsKey((at,)) else None
                if old is None:
                    self.handle.registerTimer(-(-(at + self.ttl) // 1000))
                if old is None or old[0] <= seq:
                    self.held.updateValue((at,), (seq, price))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        line = sorted((k[0], v[1]) for k, v in self.held.iterator())
        over = []
        for n, (at, price) in enumerate(line):
            if at + self.ttl > until:
                break
            # all that could follow within its time has come
            if n + 1 == len(line) or line[n + 1][0] > at + self.ttl:
                over.append((at, price))
            self.held.removeKey((at,))
        if over:
            yield pd.DataFrame({"symbol": key[0], "at": [a for a, _ in over], "price": [p for _, p in over]})

    def close(self) -> None:
        pass


def instants(quotes: DataFrame) -> DataFrame:
    """quotes with `at`, the microseconds of ts."""
    return quotes.withColumn("at", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")))


def told(rows: DataFrame, ttl_seconds: float) -> DataFrame:
    ts = F.timestamp_add("MICROSECOND", F.col("at"), F.lit("1970-01-01").cast("timestamp_ntz"))
    return rows.select("symbol", ts.alias("ts"), "price", F.timestamp_add("MICROSECOND", F.lit(int(ttl_seconds * 1_000_000)), ts).alias("expired_at"))


def expiry_stream(quotes: DataFrame, ttl_seconds: float = TTL_SECONDS, late: str = "10 seconds") -> DataFrame:
    """symbol, ts, price, expired_at: the quotes of a stream that no other quote of
    the symbol followed within ttl_seconds, said when the watermark has passed that.

    Time is the quotes' own, so the same rows come out whatever the batches and
    however often they are replayed. Quotes later than `late` are dropped; state
    holds a symbol's quotes of the last ttl_seconds and `late`.
    """
    ship(quotes.sparkSession)
    source = instants(quotes).select("symbol", "at", "seq", F.col("price").cast("double").alias("price"), F.timestamp_micros("at").alias("event")).withWatermark("event", late)
    found = source.groupBy("symbol").transformWithStateInPandas(Expiry(ttl_seconds), "symbol string, at long, price double", "append", "eventTime")
    return told(found, ttl_seconds)


def expiries(quotes: DataFrame, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """The batch twin of `expiry_stream`, with no watermark left open: also the last
    quote of each symbol expires. Of several at one time the last by seq counts;
    null times and symbols are left out."""
    newest = instants(quotes.where("ts is not null and symbol is not null")).groupBy("symbol", "at").agg(F.max_by(F.col("price").cast("double"), "seq").alias("price"))
    after = F.lead("at").over(W.partitionBy("symbol").orderBy("at"))
    alone = newest.withColumn("after", after).where(F.col("after").isNull() | (F.col("after") > F.col("at") + int(ttl_seconds * 1_000_000)))
    return told(alone, ttl_seconds)


class Registry(StatefulProcessor):
    """Who of a hub listens to what: each connection once, symbols by count."""

    def __init__(self, most_symbols: int, most_connections: int, keep_seconds: float):
        self.most_symbols, self.most_connections, self.keep = most_symbols, most_connections, int(keep_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.listens = handle.getMapState("listens", "symbol string, connection string", "seq long")
        self.left = handle.getMapState("left", "symbol string, connection string", "seq long, until long")
        self.counts = handle.getMapState("counts", "symbol string", "n int")
        self.sizes = handle.getValueState("sizes", "symbols int, connections int")

    def apply(self, symbol: str, connection: str, action: str, seq: int, now: int) -> tuple[str, int, bool, bool]:
        """(outcome, the symbol's subscribers, whether the first came or the last went)."""
        who = (symbol, connection)
        n = self.counts.getValue((symbol,))[0] if self.counts.containsKey((symbol,)) else 0
        symbols, connections = self.sizes.get() or (0, 0)
        here = self.listens.getValue(who)[0] if self.listens.containsKey(who) else None
        gone = self.left.getValue(who)[0] if self.left.containsKey(who) else None
        if max((x for x in (here, gone) if x is not None), default=seq - 1) >= seq:
            return "late", n, False, False
        if action == "unsubscribe":
            if here is None:
                outcome, first, last = "not_subscribed", False, False
            else:
                self.listens.removeKey(who)
                n, outcome, first, last = n - 1, "unsubscribed", False, n == 1
                self.sizes.update((symbols - last, connections - 1))
            self.left.updateValue(who, (seq, now + self.keep))
            self.handle.registerTimer(now + self.keep)
        elif here is not None:
            self.listens.updateValue(who, (seq,))
            return "already_subscribed", n, False, False
        elif connections >= self.most_connections:
            return "connection_capacity", n, False, False
        elif n == 0 and symbols >= self.most_symbols:
            return "symbol_capacity", n, False, False
        else:
            self.listens.updateValue(who, (seq,))
            if gone is not None:
                self.left.removeKey(who)
            n, outcome, first, last = n + 1, "subscribed", n == 0, False
            self.sizes.update((symbols + first, connections + 1))
        if n:
            self.counts.updateValue((symbol,), (n,))
        elif self.counts.containsKey((symbol,)):
            self.counts.removeKey((symbol,))
        return outcome, n, first, last

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame.sort_values(["seq", "connection"], kind="stable")
            out = []
            for symbol, connection, action, seq, event in zip(frame["symbol"], frame["connection"], frame["action"], frame["seq"].tolist(), frame["event"]):
                found = ("invalid", 0, False, False) if action == "invalid" else self.apply(symbol, connection, action, seq, int(event.timestamp() * 1000))
                out.append((key[0], symbol, connection, seq, *found))
            yield pd.DataFrame(out, columns=["hub", "symbol", "connection", "seq", "outcome", "subscribers", "first", "last"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = [k for k, v in self.left.iterator() if v[1] <= expiredTimerInfo.getExpiryTimeInMs()]
        for who in over:
            self.left.removeKey(tuple(who))
        return iter(())

    def close(self) -> None:
        pass


def requests(events: DataFrame) -> DataFrame:
    """events (hub, symbol, connection, action, seq, ts) with symbols as they are
    kept, and `invalid` for an action or a symbol that can't be."""
    symbol = F.upper(F.trim("symbol"))
    sound = F.rlike(symbol, F.lit(SYMBOL)) & F.col("action").isin("subscribe", "unsubscribe")
    return events.where("hub is not null and seq is not null").select("hub", symbol.alias("symbol"), F.coalesce("connection", F.lit("")).alias("connection"), F.when(F.coalesce(sound, F.lit(False)), F.col("action")).otherwise("invalid").alias("action"), "seq", F.col("ts").cast("timestamp").alias("event"))


REGISTERED = "hub string, symbol string, connection string, seq long, outcome string, subscribers int, first boolean, last boolean"


def registry_stream(events: DataFrame, most_symbols: int = MOST_SYMBOLS, most_connections: int = MOST_CONNECTIONS, late: str = "1 minute", keep_seconds: float = 600) -> DataFrame:
    """What becomes of each event (hub, symbol, connection, action, seq, ts):
    outcome, the symbol's subscribers afterwards, and whether the first came or
    the last went.

    A connection counts once a symbol. An event whose seq isn't above the last of
    its connection and symbol is late (a repeated one too) and changes nothing;
    that is remembered for keep_seconds of event time after a connection left.
    Beyond most_connections, or most_symbols different ones, a hub refuses. The
    state of a hub is a row a connection. In a batch a hub's events are applied
    by seq.
    """
    ship(events.sparkSession)
    source = requests(events).withWatermark("event", late)
    return source.groupBy("hub").transformWithStateInPandas(Registry(most_symbols, most_connections, keep_seconds), REGISTERED, "append", "eventTime")


def registry(events: DataFrame) -> DataFrame:
    """hub, symbol, subscribers after all events, without caps: the batch twin. The
    last event of each connection and symbol by seq counts, so late and repeated
    ones change nothing."""
    last = requests(events).where("action != 'invalid'").groupBy("hub", "symbol", "connection").agg(F.max_by("action", "seq").alias("action"))
    return last.where("action = 'subscribe'").groupBy("hub", "symbol").agg(F.count("*").cast("int").alias("subscribers"))


class Delivery(StatefulProcessor):
    """The hubs that want a symbol, and its last quote for those that come."""

    def __init__(self, ttl_seconds: float):
        self.ttl = timedelta(seconds=ttl_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hubs = handle.getMapState("hubs", "hub string", "at timestamp_ntz")
        self.quote = handle.getValueState("quote", "ts timestamp_ntz, price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            out = []
            frame = frame.sort_values(["ts", "seq"], kind="stable")
            for hub, wants, ts, price in zip(frame["hub"], frame["wants"], frame["ts"], frame["price"].tolist()):
                at = ts.to_pydatetime()
                held = self.quote.get()
                if hub is None:
                    if held is None or held[0] <= at:
                        self.quote.update((at, price))
                    out += [(key[0], k[0], at, price, False) for k in self.hubs.keys()]
                elif wants:
                    self.hubs.updateValue((hub,), (at,))
                    if held is not None and at - self.ttl <= held[0] <= at:
                        out.append((key[0], hub, held[0], held[1], True))
                elif self.hubs.containsKey((hub,)):
                    self.hubs.removeKey((hub,))
            if out:
                found = pd.DataFrame(out, columns=["symbol", "hub", "ts", "price", "cached"])
                yield found.astype({"ts": "datetime64[us]"})

    def close(self) -> None:
        pass


def delivered(quotes: DataFrame, changes: DataFrame, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """symbol, hub, ts, price, cached: each quote for each hub that wants its symbol,
    and to a hub that comes the last quote, if it is no older than ttl_seconds.

    changes (symbol, hub, wants, ts) are the first and last rows of a registry.
    The state of a symbol is a row a hub and one quote. In a batch a symbol's rows
    are taken by time, changes before quotes.
    """
    ship(quotes.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    told = quotes.select("symbol", none("string").alias("hub"), none("boolean").alias("wants"), F.col("ts").cast("timestamp_ntz").alias("ts"), "seq", F.col("price").cast("double").alias("price"))
    asked = changes.select("symbol", "hub", "wants", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("seq"), none("double").alias("price"))
    return told.unionByName(asked).groupBy("symbol").transformWithStateInPandas(Delivery(ttl_seconds), "symbol string, hub string, ts timestamp_ntz, price double, cached boolean", "append", "none")
