"""Structured Streaming over quotes: latest values with a time to live, one-shot
alerts, bars by event time, and rate limits. Each has a batch twin that gives
the same rows once the stream has run dry."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantloom.operators.folds import folded

TTL_SECONDS = 3


def latest(quotes: DataFrame) -> DataFrame:
    """The last quote of each symbol: a partial aggregate in batch, one state row
    a symbol in a stream (update or complete mode)."""
    return quotes.groupBy("symbol").agg(F.max_by(F.struct("ts", "price"), F.struct("ts", "seq")).alias("q"), F.count("*").alias("ticks")).select("symbol", "q.ts", "q.price", "ticks")


def alive(latest_quotes: DataFrame, now, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    return latest_quotes.where(F.col("ts") > F.lit(now).cast("timestamp_ntz") - F.make_interval(secs=F.lit(ttl_seconds)))


def evaluate_alerts(alerts: DataFrame, latest_quotes: DataFrame) -> DataFrame:
    """Active alerts against the latest quotes; those without one stay as they are."""
    q = latest_quotes.select("symbol", F.col("price").alias("last_price"), F.col("ts").alias("last_evaluated_at"))
    hit = F.when(F.col("condition") == "above", F.col("last_price") >= F.col("target_price")).when(F.col("condition") == "below", F.col("last_price") <= F.col("target_price"))
    fired = F.coalesce((F.col("status") == "active") & hit, F.lit(False))
    return alerts.join(q, "symbol", "left").withColumns({"triggered_at": F.when(fired, F.col("last_evaluated_at")), "status": F.when(fired, "triggered").otherwise(F.col("status"))})


def alert_stream(quotes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each alert once, when a quote first meets it: a stream-static join, then
    one bit of state an alert."""
    joined = quotes.join(alerts.where("status = 'active'"), "symbol")
    met = joined.where(((F.col("condition") == "above") & (F.col("price") >= F.col("target_price"))) | ((F.col("condition") == "below") & (F.col("price") <= F.col("target_price"))))

    def once(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        first = None  # of the batch, a frame at a time
        for frame in batches:
            own = frame.nsmallest(1, ["ts", "seq"])
            first = own if first is None else pd.concat([first, own]).nsmallest(1, ["ts", "seq"])
        state.update((True,))
        yield first.assign(alert_id=key[0])[["alert_id", "symbol", "ts", "price"]]

    return met.groupBy("alert_id").applyInPandasWithState(once, "alert_id long, symbol string, ts timestamp_ntz, price double", "done boolean", "append", GroupStateTimeout.NoTimeout)


def bars(quotes: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Bars by event time. With `late`, the stream keeps bars open that long and
    drops what comes after; an extension, the feeds themselves have no lateness rule."""
    # a watermark needs an instant
    kind = dict(quotes.dtypes)["ts"]
    source = quotes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else quotes
    order = F.struct("ts", "seq")
    return source.groupBy("symbol", F.window("ts", size).alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume")).select("symbol", F.col("w.start").cast(kind).alias("ts"), "open", "high", "low", "close", "volume")


def limited(events: DataFrame, start: Callable[[], Callable[[int], tuple]], added: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """events (key, ts, seq) with what a fold over their microseconds adds, by
    key in order of (ts, seq)."""
    plain = dict(events.dtypes)["ts"] == "timestamp_ntz"
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) if plain else F.unix_micros("ts")
    line = events.withColumn("_at", F.coalesce(micros, F.lit(-(2**63))))
    return folded(line, "key", [F.col("ts").asc_nulls_last(), F.col("seq").asc_nulls_last()], ["_at"], start, added).drop("_at")


def sliding_limit(events: DataFrame, limit: int, window_seconds: float) -> DataFrame:
    """events (key, ts, seq) with allowed and remaining: at most `limit` allowed
    events in any trailing window; refused ones don't count. A fold by key that
    holds at most `limit` times."""
    if limit < 1 or window_seconds <= 0:
        raise ValueError("limit and window must be positive")
    window = window_seconds * 1e6

    def start() -> Callable[[int], tuple]:
        held: deque[int] = deque()

        def step(now: int) -> tuple[bool, int]:
            while held and held[0] <= now - window:
                held.popleft()
            ok = len(held) < limit
            if ok:
                held.append(now)
            return ok, max(0, limit - len(held))

        return step

    return limited(events, start, {"allowed": ("boolean", pa.bool_()), "remaining": ("int", pa.int32())})


def token_bucket(events: DataFrame, rate: float) -> DataFrame:
    """events with wait_seconds: a bucket of `rate` tokens filled at `rate` a second."""
    if rate <= 0:
        raise ValueError("rate must be positive")

    def start() -> Callable[[int], tuple]:
        at, tokens = None, rate

        def step(micros: int) -> tuple[float]:
            nonlocal at, tokens
            now = micros / 1e6
            # a caller that waited holds the line up for those behind it
            begin = now if at is None else max(now, at)
            tokens = min(rate, tokens + (begin - (begin if at is None else at)) * rate)
            wait = 0.0 if tokens >= 1 else (1 - tokens) / rate
            tokens = tokens + wait * rate - 1
            at = begin + wait
            return (at - now,)

        return step

    return limited(events, start, {"wait_seconds": ("double", pa.float64())})


def run_dry(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """The rows of a stream's memory table after all that is there now."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)
