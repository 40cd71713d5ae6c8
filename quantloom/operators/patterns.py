"""Chart patterns of every bar, from the bars up to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators.bars import require_sound
from quantloom.operators.indicators import by_time, local_extrema, prior_range

WINDOW = 60


def entry(when: Column, family: str, name: str, direction: str, confidence: Column, *evidence: Column) -> Column:
    return F.when(when, F.struct(F.lit(family).alias("family"), F.lit(name).alias("name"), F.lit(direction).alias("direction"), F.round(confidence, 4).alias("confidence"), F.array(*evidence).alias("evidence")))


def told(text: str, *values: Column) -> Column:
    """A line of evidence; the wording is fixed."""
    return F.format_string(text, *values)


def candlesticks() -> list[Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span, body = h - l, F.abs(c - o)
    ratio, thick = F.try_divide(body, span), F.greatest(body, 0.02 * span)
    above, below = h - F.greatest(o, c), F.least(o, c) - l
    small = (span > 0) & ratio.between(0.05, 0.35)
    po, pc = F.col("previous_open"), F.col("previous_close")
    share = told("body/range=%.3f", ratio)
    shadow = lambda side, x: told(f"{side}_shadow/body=%.2f", F.try_divide(x, thick))
    held = lambda kind: F.lit(f"current real body contains the previous {kind} real body")
    return [
        entry((span > 0) & (ratio <= 0.10), "candlestick", "doji", "neutral", F.lit(0.68), share),
        entry(small & (below >= 2 * thick) & (above <= thick) & (F.greatest(o, c) >= l + 0.6 * span), "candlestick", "hammer", "upward", F.lit(0.72), shadow("lower", below), share),
        entry(small & (above >= 2 * thick) & (below <= thick) & (F.least(o, c) <= l + 0.4 * span), "candlestick", "shooting_star", "downward", F.lit(0.72), shadow("upper", above), share),
        entry((span > 0) & (pc < po) & (c > o) & (o <= pc) & (c >= po), "candlestick", "bullish_engulfing", "upward", F.lit(0.78), held("bearish")),
        entry((span > 0) & (pc > po) & (c < o) & (o >= pc) & (c <= po), "candlestick", "bearish_engulfing", "downward", F.lit(0.78), held("bullish")),
    ]


def breakouts() -> list[Column]:
    c, upper, lower = F.col("close"), F.col("prior_high"), F.col("prior_low")
    span = F.greatest(upper - lower, F.abs(c) * 0.001)
    confidence = lambda move: F.least(F.lit(0.90), 0.68 + F.try_divide(move, span) * 2)
    return [
        entry(c > upper, "chart", "range_breakout_up", "upward", confidence(c - upper), told("close=%.4f above prior_20_high=%.4f", c, upper)),
        entry(c < lower, "chart", "range_breakout_down", "downward", confidence(lower - c), told("close=%.4f below prior_20_low=%.4f", c, lower)),
    ]


def pairs(top: bool) -> Column:
    """(right, left, difference, neckline) of the pairs of like extremes that end at a
    bar and begin 5 to 35 bars before it; null where the bar is none."""
    price, edge, kind = ("high", "low", "is_top") if top else ("low", "high", "is_bottom")
    n, line = F.col("_n"), by_time()
    # the best price strictly between the two extremes is the neckline
    before = F.collect_list(F.when(F.col(kind), F.struct(n.alias("n"), F.col(price).alias("price")))).over(line.rowsBetween(-35, -5))
    edges = F.collect_list(edge).over(line.rowsBetween(-34, -1))

    def pair(p: Column) -> Column:
        inner = n - p.n - 1
        between = F.slice(edges, -inner, inner)
        mean = (p.price + F.col(price)) / 2
        difference = F.when(mean > 0, F.try_divide(F.abs(p.price - F.col(price)), mean))
        return F.struct(n.alias("right"), p.n.alias("left"), difference.alias("difference"), (F.array_min(between) if top else F.array_max(between)).alias("neckline"))

    return F.when(F.col(kind), F.filter(F.transform(before, pair), lambda x: x.difference <= 0.03))


def doubles(bars: DataFrame, window: int = WINDOW) -> DataFrame:
    """bars with double_top and double_bottom, (right, left, difference, neckline): of
    the pairs in the window that a bar's close confirms, the one whose right extreme,
    then left, is latest; null if there is none. Lists of pairs are windows of one
    order, and hold a few pairs a bar."""
    found = local_extrema(bars).withColumn("_n", F.row_number().over(by_time()) - 1)
    found = found.withColumns({"_tops": pairs(True), "_bottoms": pairs(False)})
    # the left extreme needs two bars before it in the window, the right one two bars after
    reach = by_time().rowsBetween(8 - window, -2)
    n, close = F.col("_n"), F.col("close")
    held = lambda c: F.flatten(F.collect_list(c).over(reach))
    beyond = {"double_top": ("_tops", lambda x: close < x.neckline), "double_bottom": ("_bottoms", lambda x: close > x.neckline)}
    best = {}
    for name, (c, past) in beyond.items():
        best[name] = F.when(n >= 11, F.array_max(F.filter(held(c), confirmed(past, n, window))))
    return found.withColumns(best).drop("_n", "_tops", "_bottoms", "is_top", "is_bottom")


def confirmed(past: Callable[[Column], Column], n: Column, window: int) -> Callable[[Column], Column]:
    return lambda x: (x.left >= n - (window - 3)) & past(x)


def double(column: str, name: str, direction: str, side: str) -> Column:
    d = F.col(column)
    evidence = told("extreme_similarity=%.3f", 1 - d.difference), told(f"latest close confirmed {side} neckline=%.4f", d.neckline)
    return entry(d.isNotNull(), "chart", name, direction, F.least(F.lit(0.90), 0.76 + (0.03 - d.difference) * 3), *evidence)


def with_patterns(bars: DataFrame, window: int = WINDOW) -> DataFrame:
    """bars with `patterns`, an array of those of each bar: all from windows over one
    order, so one shuffle and one sort however many patterns there are. The job
    fails at a bar whose prices can't be."""
    before = {"previous_open": F.lag("open").over(by_time()), "previous_close": F.lag("close").over(by_time())}
    seen = doubles(prior_range(require_sound(bars)).withColumns(before), window)
    both = [double("double_top", "double_top_confirmed", "downward", "below"), double("double_bottom", "double_bottom_confirmed", "upward", "above")]
    return seen.select(*bars.columns, F.array_compact(F.array(*candlesticks(), *breakouts(), *both)).alias("patterns"))


def patterns(bars: DataFrame, window: int = WINDOW) -> DataFrame:
    """symbol, ts, rank, family, name, direction, confidence, evidence: all patterns of
    each bar, most confident first, then by name. The job fails at a bar whose
    prices can't be."""
    every = with_patterns(bars, window).select("symbol", "ts", F.explode("patterns").alias("pattern")).select("symbol", "ts", "pattern.*")
    order = W.partitionBy("symbol", "ts").orderBy(F.desc("confidence"), "name")
    return every.withColumn("rank", F.row_number().over(order))


def latest_patterns(bars: DataFrame) -> DataFrame:
    last = bars.groupBy("symbol").agg(F.max("ts").alias("ts"))
    return patterns(bars).join(last, ["symbol", "ts"])
