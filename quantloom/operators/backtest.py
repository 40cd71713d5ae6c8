"""Backtests of long-or-flat signals: by windows, by one fold of orders a symbol,
walk-forward folds, metrics and comparisons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quantloom.operators.indicators import by_time, sma
from quantloom.operators.patterns import with_patterns

def so_far() -> WindowSpec:
    return by_time().rowsBetween(W.unboundedPreceding, 0)


@dataclass(frozen=True)
class Config:
    initial_capital: float = 10_000_000.0
    annualization_days: int = 252
    force_close: bool = True
    commission: float = 0.00015
    tax: float = 0.0018
    slippage: float = 0.0005
    participation: float = 1.0

    def __post_init__(self) -> None:
        if self.initial_capital <= 0 or self.annualization_days < 1 or not 0 < self.participation <= 1:
            raise ValueError("capital and days must be positive, participation in (0, 1]")
        if min(self.commission, self.tax, self.slippage) < 0:
            raise ValueError("costs can't be negative")


def buy_and_hold(bars: DataFrame) -> DataFrame:
    return bars.withColumn("signal", F.lit(1))


def ma_cross(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    if not 0 < fast < slow:
        raise ValueError("0 < fast < slow")
    return bars.withColumn("signal", F.coalesce((sma("close", fast) > sma("close", slow)).cast("int"), F.lit(0)))


def pattern_reference(bars: DataFrame, least: float = 0.68, window: int = 60) -> DataFrame:
    """Long after the latest bar whose best directional pattern points upward."""
    if not 0 <= least <= 1 or window < 21:
        raise ValueError("0 <= least <= 1 and window >= 21")
    able = lambda x: (x.direction != "neutral") & (x.confidence >= least)
    ranked = F.transform(F.filter("patterns", able), lambda x: F.struct(-x.confidence, x["name"], (x.direction == "upward").cast("int").alias("side")))
    sided = with_patterns(bars, window).withColumn("side", F.array_min(ranked).side)
    return sided.withColumn("signal", F.coalesce(F.last("side", ignorenulls=True).over(so_far()), F.lit(0))).drop("side", "patterns")


def technical_score(scored: DataFrame, threshold: float = 65.0) -> DataFrame:
    return scored.withColumn("signal", F.coalesce((F.col("technical_score") >= threshold).cast("int"), F.lit(0)))


def vectorized(signals: DataFrame, config: Config = Config(), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The equity curve: a signal at a close is held from the next open.

    All windows share one sort by key and time.
    """
    line = W.partitionBy(*keys).orderBy("ts")
    position = F.coalesce(F.lag("signal").over(line), F.lit(0))
    df = signals.withColumns({"position": position, "previous_close": F.lag("close").over(line), "is_last": F.lead("ts").over(line).isNull()})
    df = df.withColumn("was", F.coalesce(F.lag("position").over(line), F.lit(0)))
    overnight = F.col("was") * F.coalesce(F.try_divide(F.col("open"), F.col("previous_close")) - 1, F.lit(0.0))
    intraday = F.col("position") * (F.try_divide(F.col("close"), F.col("open")) - 1)
    buy_cost, sell_cost = config.commission + config.slippage, config.commission + config.tax + config.slippage
    bought, sold = F.greatest(F.col("position") - F.col("was"), F.lit(0)), F.greatest(F.col("was") - F.col("position"), F.lit(0))
    closing = F.when(F.lit(config.force_close) & F.col("is_last") & (F.col("position") == 1), sell_cost).otherwise(0.0)
    df = df.withColumn("daily_return", (1 + overnight) * (1 + intraday) - 1 - bought * buy_cost - sold * sell_cost - closing)
    return df.withColumn("equity", config.initial_capital * F.product(1 + F.col("daily_return")).over(line.rowsBetween(W.unboundedPreceding, 0)))


def trades(curve: DataFrame, config: Config = Config(), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, ts, seq, side, execution_price, cost, position_after."""
    line = W.partitionBy(*keys).orderBy("ts")
    before = F.coalesce(F.lag("equity").over(line), F.lit(config.initial_capital))
    df = curve.withColumn("before", before)
    change = F.col("position") - F.col("was")
    side = F.when(change == 1, "buy").when(change == -1, "sell")
    fee = F.when(change == 1, config.commission).otherwise(config.commission + config.tax)
    trade = lambda seq, side, price, cost, after: F.struct(F.lit(seq).alias("seq"), side.alias("side"), price.alias("execution_price"), cost.alias("cost"), after.cast("int").alias("position_after"))
    price = F.col("open") * F.when(change == 1, 1 + config.slippage).otherwise(1 - config.slippage)
    made = [F.when(change != 0, trade(0, side, price, F.col("before") * fee, F.when(change == 1, 1).otherwise(0)))]
    if config.force_close:
        made.append(F.when(F.col("is_last") & (F.col("position") == 1), trade(1, F.lit("sell"), F.col("close") * (1 - config.slippage), F.col("before") * (config.commission + config.tax), F.lit(0))))
    return df.select(*keys, "ts", F.explode(F.array_compact(F.array(*made))).alias("t")).select(*keys, "ts", "t.*")


def metrics(curve: DataFrame, made: DataFrame, config: Config = Config(), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Performance by key from (ts, equity, daily_return) and the trades."""
    k = list(keys)
    path = W.partitionBy(*k).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    peak = F.greatest(F.max("equity").over(path), F.lit(config.initial_capital))
    drawn = curve.withColumn("drawdown", F.col("equity") / peak - 1)
    base = drawn.groupBy(*k).agg(F.count("*").alias("n"), F.max_by("equity", "ts").alias("final"), F.min("drawdown").alias("drawdown"), F.avg("daily_return").alias("mean"), F.stddev_samp("daily_return").alias("spread"))
    order = W.partitionBy(*k).orderBy("ts", "seq")
    follow = made.withColumns({"next_side": F.lead("side").over(order), "next_price": F.lead("execution_price").over(order)})
    won = (F.col("next_price") * (1 - config.commission - config.tax)) / (F.col("execution_price") * (1 + config.commission)) - 1
    pairs = (F.col("side") == "buy") & (F.col("next_side") == "sell")
    counted = follow.groupBy(*k).agg(F.count("*").alias("trade_count"), F.avg(F.when(pairs, (won > 0).cast("double"))).alias("win_rate"))
    years = F.greatest((F.col("n") - 1) / config.annualization_days, F.lit(1 / config.annualization_days))
    sharpe = F.when(F.col("spread") > 0, F.col("mean") / F.col("spread") * F.sqrt(F.lit(float(config.annualization_days)))).otherwise(0.0)
    growth = F.col("final") / config.initial_capital
    return base.join(counted, k, "left").select(*k, F.round(growth - 1, 8).alias("total_return"), F.round(F.pow(growth, 1 / years) - 1, 8).alias("cagr"), F.round("drawdown", 8).alias("max_drawdown"), F.round(sharpe, 6).alias("sharpe_ratio"), F.round(F.coalesce("win_rate", F.lit(0.0)), 6).alias("win_rate"), F.coalesce("trade_count", F.lit(0)).alias("trade_count"), F.round("final", 4).alias("final_equity"))


def fold_orders(rows: pd.DataFrame, config: Config) -> list[tuple]:
    """One symbol's bars in time order, an order a bar at most: what is bought
    and sold at the open after each signal, in whole shares."""
    cash, held, pending, out = config.initial_capital, 0, None, []
    before = config.initial_capital
    last = len(rows) - 1
    for i, (ts, open_, close, volume, signal) in enumerate(zip(rows["ts"], rows["open"], rows["close"], rows["volume"], rows["signal"])):
        events: list[tuple] = []

        def act(side: str, market: float, limit: float | None, cash: float, held: int) -> tuple[float, int]:
            price = market * (1 + config.slippage if side == "buy" else 1 - config.slippage)
            wanted = int(cash // (price * (1 + config.commission))) if side == "buy" else held
            if wanted <= 0:
                events.append(("rejected", side, "insufficient_cash" if side == "buy" else "no_position", 0, 0, None))
                return cash, held
            filled = wanted if limit is None else min(wanted, int(max(0, limit) * config.participation))
            if filled <= 0:
                events.append(("rejected", side, "insufficient_liquidity", wanted, 0, None))
                return cash, held
            if filled < wanted:
                events.append(("partial_fill", side, "signal", wanted, filled, price))
            worth = price * filled
            fee = worth * config.commission
            cash, held = (cash - worth - fee, held + filled) if side == "buy" else (cash + worth - fee - worth * config.tax, held - filled)
            events.append(("fill", side, "signal" if limit is not None else "force_close", wanted, filled, price))
            return cash, held

        if pending:
            cash, held = act(pending, open_, volume, cash, held)
            pending = None
        if int(signal) != int(held > 0) and i < last:
            pending = "buy" if signal else "sell"
        if i == last and config.force_close and held > 0:
            cash, held = act("sell", close, None, cash, held)
        equity = cash + held * close
        out.append((ts, equity, equity / before - 1 if before else 0.0, int(held > 0), events))
        before = equity
    return out


EVENT = "array<struct<event_type:string,side:string,reason:string,requested:bigint,quantity:bigint,price:double>>"


def event_driven(signals: DataFrame, config: Config = Config(), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, ts, equity, daily_return, position, events: cash and whole shares
    carried from bar to bar, volume-limited fills, rejections. Signals look back
    only, so they are one column, computed once for all bars."""
    types = dict(signals.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", ts timestamp_ntz, equity double, daily_return double, position int, events {EVENT}"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(fold_orders(rows.sort_values("ts", kind="stable"), config), columns=["ts", "equity", "daily_return", "position", "events"])
        out["events"] = [[dict(zip(("event_type", "side", "reason", "requested", "quantity", "price"), e)) for e in es] for es in out["events"]]
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "ts", "equity", "daily_return", "position", "events"]]

    return signals.select(*keys, "ts", "open", "close", "volume", "signal").groupBy(*keys).applyInPandas(run, schema)


def events_of(curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return curve.select(*keys, "ts", F.posexplode("events").alias("seq", "e")).select(*keys, "ts", "seq", "e.*")


def fills(curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return events_of(curve, keys).where("event_type = 'fill'").select(*keys, "ts", "seq", "side", F.col("price").alias("execution_price"), "quantity")


def folds(bars: DataFrame, n_splits: int = 3, warmup: int = 60) -> DataFrame:
    """symbol, fold, start, first, last: bar ordinals; the remainder goes to the last fold."""
    if not 2 <= n_splits <= 6 or warmup < 21:
        raise ValueError("2 to 6 splits, a warm-up of 21 bars at least")
    sized = bars.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") - warmup >= n_splits * 10)
    size = F.floor((F.col("n") - warmup) / n_splits).cast("int")
    k = F.col("fold") - 1
    return sized.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits)))).select("symbol", "fold", (k * size).alias("start"), (warmup + k * size).alias("first"), F.when(F.col("fold") == n_splits, F.col("n").cast("int")).otherwise(warmup + (k + 1) * size).alias("stop"))


def in_folds(signals: DataFrame, n_splits: int = 3, warmup: int = 60) -> DataFrame:
    """Bars once for each fold that they are in, symbol being symbol and fold;
    no signal before the fold's test bars."""
    numbered = signals.withColumn("n", F.row_number().over(by_time()) - 1)
    parts = folds(signals, n_splits, warmup)
    rows = numbered.join(parts, "symbol").where((F.col("n") >= F.col("start")) & (F.col("n") < F.col("stop")))
    return rows.withColumn("signal", F.when(F.col("n") < F.col("first"), 0).otherwise(F.col("signal"))).withColumn("is_test", F.col("n") >= F.col("first")).withColumn("series", F.col("symbol")).withColumn("symbol", F.concat_ws("#", "symbol", "fold"))


def walk_forward(signals: DataFrame, config: Config = Config(), n_splits: int = 3, warmup: int = 60) -> DataFrame:
    """series, fold and the metrics over the fold's test bars, by windows."""
    rows = in_folds(signals, n_splits, warmup)
    curve = vectorized(rows, config)
    made = trades(curve, config)
    return metrics(curve.where("is_test"), made, config).select(F.substring_index("symbol", "#", 1).alias("series"), F.substring_index("symbol", "#", -1).cast("int").alias("fold"), "*").drop("symbol")


def stability(tested: DataFrame) -> DataFrame:
    """One row a series: how steady its folds are."""
    share = F.avg((F.col("total_return") > 0).cast("double"))
    mean = F.avg("total_return")
    label = F.when((F.col("share") >= 2 / 3) & (F.col("mean") > 0), "consistent_positive").when((F.col("share") <= 1 / 3) & (F.col("mean") < 0), "consistent_negative").otherwise("mixed")
    out = tested.groupBy("series").agg(share.alias("share"), mean.alias("mean"), F.min("max_drawdown").alias("worst"), F.avg("sharpe_ratio").alias("sharpe"), F.sum("trade_count").alias("trade_count"))
    return out.select("series", F.round("mean", 6).alias("mean_total_return"), F.round("share", 6).alias("profitable_fold_ratio"), F.round("worst", 6).alias("worst_max_drawdown"), F.round("sharpe", 4).alias("mean_sharpe_ratio"), "trade_count", label.alias("stability"))


def downsample(curve: DataFrame, initial: float, most: int = 120) -> DataFrame:
    """At most `most` evenly spaced points of each curve, both ends kept."""
    path = by_time().rowsBetween(W.unboundedPreceding, 0)
    peak = F.greatest(F.max("equity").over(path), F.lit(initial))
    everything = W.partitionBy("symbol")
    df = curve.select("symbol", "ts", F.round(F.col("equity") / initial * 100, 6).alias("normalized_equity"), F.round(F.col("equity") / peak - 1, 8).alias("drawdown"), (F.row_number().over(by_time()) - 1).alias("n"), (F.count("*").over(everything) - 1).alias("last"))
    # n is one of round(i last / (most - 1)) if the nearest i gives it back
    i = F.col("n") * (most - 1) / F.greatest("last", F.lit(1))
    back = lambda x: F.rint(x * F.col("last") / (most - 1)) == F.col("n")
    keep = (F.col("last") < most) | back(F.floor(i)) | back(F.ceil(i))
    return df.where(keep).select("symbol", "ts", "normalized_equity", "drawdown")


def signals(bars: DataFrame, strategies: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """bars with strategy and signal: a row for each strategy and for
    buy_and_hold, from one pass over the bars."""
    df, names = bars, {"buy_and_hold": F.lit(1)}
    for k, (name, add) in enumerate(strategies.items()):
        df = add(df).withColumnRenamed("signal", f"_signal{k}")
        names[name] = F.col(f"_signal{k}")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), c.cast("int").alias("signal")) for n, c in names.items()])).alias("_s")
    return df.select(*bars.columns, each).select(*bars.columns, "_s.*")


def compare_strategies(signals_: DataFrame, base: str, config: Config = Config()) -> DataFrame:
    """Metrics of each (symbol, strategy), and the difference from the base
    strategy's: one set of windows over all strategies together, of rows that are
    dealt by symbol once."""
    keys = ("symbol", "strategy")
    curve = vectorized(signals_, config, keys)
    found = metrics(curve, trades(curve, config, keys), config, keys)
    names = ["total_return", "max_drawdown", "sharpe_ratio", "final_equity"]
    own = lambda c: F.max(F.when(F.col("strategy") == base, F.col(c))).over(W.partitionBy("symbol"))
    return found.select(*keys, *names, "trade_count", *[F.round(F.col(c) - own(c), 6).alias(f"{c}_delta") for c in names])


def compared(parts: dict[str, DataFrame], base: str, by: str = "strategy") -> DataFrame:
    """Metrics of all parts, and each one's difference from the base part."""
    every = None
    for name, part in parts.items():
        named = part.withColumn(by, F.lit(name))
        every = named if every is None else every.unionByName(named)
    names = ["total_return", "max_drawdown", "sharpe_ratio", "final_equity"]
    own = parts[base].select("symbol", *[F.col(c).alias(f"base_{c}") for c in names])
    return every.join(own, "symbol").select("symbol", by, *names, "trade_count", *[F.round(F.col(c) - F.col(f"base_{c}"), 6).alias(f"{c}_delta") for c in names])
