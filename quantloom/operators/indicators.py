"""Technical indicators: bounded windows as SQL windows over one sort by symbol
and time; recursive averages as one fold in time order."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quantloom.operators.folds import folded

INDICATORS = ["ma_5", "ma_20", "rsi_14", "macd", "macd_signal", "macd_histogram", "bb_middle", "bb_upper", "bb_lower", "atr_14", "plus_di_14", "minus_di_14", "adx_14", "mfi_14", "vwap", "obv", "supertrend_10_3", "supertrend_direction"]


def by_time() -> WindowSpec:
    """A symbol's rows in time order: the one sort that all windows share."""
    return W.partitionBy("symbol").orderBy("ts")


def full(aggregate: Column, x: Column, n: int) -> Column:
    """A rolling aggregate that is null until n values are there."""
    frame = by_time().rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, aggregate.over(frame))


def sma(x: str | Column, n: int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return full(F.avg(x), x, n)


def true_range() -> Column:
    before = F.lag("close").over(by_time())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def windows(bars: DataFrame) -> DataFrame:
    """Bars with the indicators that look back a bounded number of bars, or sum
    up from the start."""
    change = F.col("close") - F.lag("close").over(by_time())
    up, down = F.col("high") - F.lag("high").over(by_time()), F.lag("low").over(by_time()) - F.col("low")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    step = bars.select("*", change.alias("change"), true_range().alias("tr"), typical.alias("tp"),
                       F.when((up > down) & (up > 0), up).otherwise(0.0).alias("plus_dm"), F.when((down > up) & (down > 0), down).otherwise(0.0).alias("minus_dm"))
    step = step.withColumns({"gain": F.greatest("change", F.lit(0.0)), "loss": F.greatest(-F.col("change"), F.lit(0.0)), "tp_change": F.col("tp") - F.lag("tp").over(by_time())})
    step = step.withColumns({"gain": F.when(F.col("change").isNotNull(), F.col("gain")), "loss": F.when(F.col("change").isNotNull(), F.col("loss"))})
    flow = F.col("tp") * F.col("volume")
    inflow, outflow = F.when(F.col("tp_change") > 0, flow).otherwise(0.0), F.when(F.col("tp_change") < 0, flow).otherwise(0.0)
    so_far = by_time().rowsBetween(W.unboundedPreceding, 0)
    middle, spread = sma("close", 20), full(F.stddev_pop("close"), F.col("close"), 20)
    positive, negative = full(F.sum(inflow), inflow, 14), full(F.sum(outflow), outflow, 14)
    mfi = F.when(negative == 0, F.when(positive > 0, 100.0)).otherwise(100 - 100 / (1 + F.try_divide(positive, negative)))
    direction = F.coalesce(F.signum("change"), F.lit(0.0)) * F.col("volume")
    return step.select(
        *bars.columns, "tr", "gain", "loss", "plus_dm", "minus_dm", sma("close", 5).alias("ma_5"), middle.alias("ma_20"), middle.alias("bb_middle"), (middle + 2 * spread).alias("bb_upper"), (middle - 2 * spread).alias("bb_lower"),
        mfi.alias("mfi_14"), F.try_divide(F.sum(flow).over(so_far), F.sum(F.col("volume").cast("double")).over(so_far)).alias("vwap"), F.sum(direction).over(so_far).alias("obv"))


def wilder(period: int) -> Callable[[float | None], float | None]:
    """Wilder's average, a value at a time: nulls are skipped; the first `period`
    values' mean, then (last (period - 1) + value) / period."""
    first: list[float] = []
    last: float | None = None

    def step(x: float | None) -> float | None:
        nonlocal last
        if x is None or x != x:
            return None
        if last is not None:
            last = (last * (period - 1) + x) / period
        else:
            first.append(x)
            if len(first) == period:
                last = sum(first) / period
        return last

    return step


def exponential(span: int) -> Callable[[float | None], float | None]:
    """An exponential average from the first value on. Over nulls the last value
    stays, and its weight falls."""
    share = 2.0 / (span + 1)
    last: float | None = None
    weight = 1.0

    def step(x: float | None) -> float | None:
        nonlocal last, weight
        have = x is not None and x == x
        if last is None:
            last = x if have else None
            return last
        weight *= 1.0 - share
        if have:
            last = (weight * last + share * x) / (weight + share)
            weight = 1.0
        return last

    return step


def trail(factor: float) -> Callable[..., tuple[float | None, int | None]]:
    """The line that trails the price and its side (1 below, -1 above, null none
    yet), from (high, low, close, average true range) a bar at a time."""
    nan = float("nan")
    before: tuple[float, float, float] | None = None  # upper, lower, close
    side = 0

    def step(*bar: float | None) -> tuple[float | None, int | None]:
        nonlocal before, side
        high, low, close, atr = (nan if x is None else x for x in bar)
        middle = (high + low) / 2
        upper, lower = middle + factor * atr, middle - factor * atr
        line = None
        if before is None or atr != atr:
            side = 0
        else:
            if before[2] <= before[0]:
                upper = min(upper, before[0])
            if before[2] >= before[1]:
                lower = max(lower, before[1])
            if side == 0:
                side = 1 if close >= middle else -1
            elif side == 1:
                side = -1 if close < lower else 1
            else:
                side = 1 if close > upper else -1
            line = lower if side == 1 else upper
        before = upper, lower, close
        return line, side or None

    return step


RECURSIVE = ["g", "l", "atr_14", "plus_di_14", "minus_di_14", "adx_14", "macd", "macd_signal", "supertrend_10_3"]


def recursions() -> Callable[..., tuple]:
    """All recursive indicators of a symbol, a bar at a time."""
    gain, loss, ranges, plus, minus, directional, short_range = (wilder(n) for n in (14, 14, 14, 14, 14, 14, 10))
    fast, slow, signal = exponential(12), exponential(26), exponential(9)
    line = trail(3.0)

    def step(g: float | None, l: float | None, tr: float | None, up: float | None, down: float | None, high: float | None, low: float | None, close: float | None) -> tuple:
        atr, p, m = ranges(tr), plus(up), minus(down)
        share = lambda x: 100 * (x / atr) if x is not None and atr else None
        pdi, mdi = share(p), share(m)
        dx = 100 * (abs(pdi - mdi) / (pdi + mdi)) if pdi is not None and mdi is not None and pdi + mdi else None
        a, b = fast(close), slow(close)
        macd = a - b if a is not None and b is not None else None
        at, side = line(high, low, close, short_range(tr))
        return gain(g), loss(l), atr, pdi, mdi, directional(dx), macd, signal(macd), at, side

    return step


def rsi(gain: str, loss: str) -> Column:
    return F.when(F.col(gain).isNull() | F.isnan(gain), None).when(F.col(loss) == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col(gain), F.col(loss))))


def with_indicators(bars: DataFrame) -> DataFrame:
    """Bars with all 18 indicators, rounded to six places.

    Windows share one sort; all recursive averages are one fold over the same
    partitioning by symbol, which holds a few numbers a symbol. Warm-up rows are
    null; null prices and volumes give null where they are looked at.
    """
    own = bars.columns
    df = windows(bars.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close")}))
    added = {c: ("double", pa.float64()) for c in RECURSIVE} | {"supertrend_direction": ("bigint", pa.int64())}
    df = folded(df, "symbol", [F.col("ts")], ["gain", "loss", "tr", "plus_dm", "minus_dm", "high", "low", "close"], recursions, added)
    df = df.withColumns({"rsi_14": rsi("g", "l"), "macd_histogram": F.col("macd") - F.col("macd_signal")})
    rounded = [F.round(F.when(~F.isnan(c), F.col(c)), 6).alias(c) for c in INDICATORS[:-1]]
    return df.select(*own, *rounded, "supertrend_direction")


def support_resistance(bars: DataFrame, n: int = 20) -> DataFrame:
    turn = W.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("_n", F.row_number().over(turn)).where(F.col("_n") <= n).groupBy("symbol").agg(F.min("low").alias("support"), F.max("high").alias("resistance"))


def prior_range(bars: DataFrame, n: int = 20) -> DataFrame:
    """Bars with the high and low of the n bars before."""
    frame = by_time().rowsBetween(-n, -1)
    ready = F.count("close").over(frame) == n
    return bars.withColumns({"prior_high": F.when(ready, F.max("high").over(frame)), "prior_low": F.when(ready, F.min("low").over(frame))})


def local_extrema(bars: DataFrame) -> DataFrame:
    """Bars with is_top and is_bottom: not beaten by the two bars on either side."""
    def beats(c: str, sign: int) -> Column:
        near = [F.lag(c, 1), F.lag(c, 2), F.lead(c, 1), F.lead(c, 2)]
        out = F.lit(True)
        for x in near:
            out = out & ((F.col(c) - x.over(by_time())) * sign >= 0)
        return F.coalesce(out, F.lit(False))

    return bars.withColumns({"is_top": beats("high", 1), "is_bottom": beats("low", -1)})
