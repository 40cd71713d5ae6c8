"""Bars: validation, cleaning, gaps and resampling, for all symbols at once.

Input bars have symbol, ts, open, high, low, close, volume; raw ones also seq
(order of arrival) and price_basis. Rows with a null price are invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP_DAYS = 5


def in_range() -> Column:
    return (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))


def is_valid() -> Column:
    return F.coalesce(in_range() & (F.col("volume") >= 0), F.lit(False))


def business_days_between(a: Column, b: Column) -> Column:
    """Weekdays strictly between two dates."""
    days = F.when(F.datediff(b, a) > 1, F.sequence(F.date_add(a, 1), F.date_sub(b, 1))).otherwise(F.array().cast("array<date>"))
    return F.size(F.filter(days, lambda d: F.weekday(d) < 5))


def gaps(bars: DataFrame, least: int = GAP_DAYS) -> DataFrame:
    """symbol, ts, missing_days: at each bar that follows a suspicious gap."""
    w = W.partitionBy("symbol").orderBy("ts")
    dated = bars.select("symbol", "ts").distinct().withColumn("before", F.lag("ts").over(w)).where("before is not null and datediff(ts, before) > 1")
    return dated.select("symbol", "ts", business_days_between(F.to_date("before"), F.to_date("ts")).alias("missing_days")).where(F.col("missing_days") >= least)


def mixed_bases(raw: DataFrame) -> DataFrame:
    """Symbols whose bars don't share one price basis."""
    return raw.groupBy("symbol").agg(F.min("price_basis").alias("a"), F.max("price_basis").alias("b")).where("a != b").select("symbol")


def quality_logs(raw: DataFrame) -> DataFrame:
    """symbol, rule, severity, ts: a row for each violation, none altered. All rules
    look at one frame that is shuffled by symbol once."""
    arrival, line = W.partitionBy("symbol").orderBy("seq"), W.partitionBy("symbol").orderBy("ts", "seq")
    whole = W.partitionBy("symbol")
    seen = raw.withColumns({
        "before": F.lag("ts").over(arrival), "place": F.row_number().over(arrival), "low_basis": F.min("price_basis").over(whole), "high_basis": F.max("price_basis").over(whole),
        "earlier": F.lag("ts").over(line), "again": F.row_number().over(line) > 1})
    copy = F.col("again") & F.col("ts").eqNullSafe(F.col("earlier"))
    missing = F.when(~copy & (F.datediff("ts", "earlier") > 1), business_days_between(F.to_date("earlier"), F.to_date("ts")))
    log = lambda when, rule, severity="error", at=F.col("ts"): F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), at.alias("ts")))
    rules = F.array_compact(F.array(
        log(copy, "duplicate_timestamp"), log(~in_range(), "invalid_ohlc"), log(F.col("volume") < 0, "negative_volume"), log(F.col("ts") <= F.col("before"), "out_of_order"),
        log((F.col("place") == 1) & (F.col("low_basis") != F.col("high_basis")), "mixed_price_basis", at=F.lit(None).cast("timestamp_ntz")), log(missing >= GAP_DAYS, "missing_daily_candles", "warning")))
    return seen.select("symbol", F.explode(rules).alias("r")).select("symbol", "r.*")


def clean(raw: DataFrame) -> DataFrame:
    """The first valid bar to arrive for each symbol and time; none for symbols
    of mixed basis."""
    whole, first = W.partitionBy("symbol"), W.partitionBy("symbol", "ts").orderBy("seq")
    alike = F.coalesce(F.min("price_basis").over(whole) == F.max("price_basis").over(whole), F.lit(True))
    kept = raw.withColumn("alike", alike).where(F.col("alike") & is_valid()).withColumn("copy", F.row_number().over(first))
    return kept.where("copy = 1").drop("copy", "alike")


def guarded(df: DataFrame, sound: Column, message: str) -> DataFrame:
    """df; the job fails at a row that isn't sound, whichever columns are read. The
    guard is a condition on rows, which stays where a column that nobody reads goes."""
    return df.where(F.assert_true(F.coalesce(sound, F.lit(True)), message).isNull())


def require_sound(bars: DataFrame) -> DataFrame:
    """Fails the job at a bar whose prices can't be; a null price passes."""
    return guarded(bars, (F.col("high") >= F.col("low")) & F.col("open").between(F.col("low"), F.col("high")) & F.col("close").between(F.col("low"), F.col("high")), "invalid OHLC bar")


def require_unique(bars: DataFrame) -> DataFrame:
    """Fails the job where a symbol has a time twice."""
    seen = bars.withColumn("_before", F.lag("ts").over(W.partitionBy("symbol").orderBy("ts")))
    return guarded(seen, F.coalesce(F.col("ts") > F.col("_before"), F.lit(True)), "times must be unique").drop("_before")


def require_positive(bars: DataFrame) -> DataFrame:
    """Fails the job at a price of 0 or less, and where a symbol has a time twice."""
    return require_unique(guarded(bars, F.least("open", "high", "low", "close") > 0, "prices must be positive"))


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Bars by day (as they are), ISO week or month; ts is the first bar's. Where
    bars have a price_basis, the job fails at a symbol with more than one."""
    if interval == "1d":
        return bars
    if "price_basis" in bars.columns:
        kept = resample(bars.drop("price_basis"), interval)
        bases = bars.groupBy("symbol").agg(F.min("price_basis").alias("price_basis"), F.max("price_basis").alias("_other"))
        return guarded(kept.join(bases, "symbol"), F.col("price_basis") == F.col("_other"), "bars of mixed price bases").drop("_other")
    period = {"1w": [F.extract(F.lit("YEAROFWEEK"), "ts").alias("y"), F.weekofyear("ts").alias("p")], "1M": [F.year("ts").alias("y"), F.month("ts").alias("p")]}[interval]
    return bars.groupBy("symbol", *period).agg(
        F.min("ts").alias("first_ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    ).select("symbol", F.col("first_ts").alias("ts"), "open", "high", "low", "close", "volume")


def last_n(bars: DataFrame, n: int) -> DataFrame:
    """The n latest bars of each symbol."""
    turn = W.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= n).drop("_turn")


def process(raw: DataFrame, interval: str = "1d") -> tuple[DataFrame, DataFrame]:
    """Clean bars of an interval, and the quality log."""
    return resample(clean(raw).drop("seq", "price_basis"), interval), quality_logs(raw)
