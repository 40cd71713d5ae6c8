"""Scores, reference signals, portfolios and light predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.numeric import clamp, mean_of
from quantloom.operators.indicators import by_time, full, sma

#: Fixed weights of the six axes.
WEIGHTS = {"technical": 0.30, "financial": 0.20, "news": 0.10, "disclosure": 0.10, "investor_flow": 0.15, "market_risk": 0.15}
#: Fixed terms of severe market warnings.
SEVERE = ["risk", "liquidation", "delisting", "투자위험", "정리매매"]


def technical(df: DataFrame) -> DataFrame:
    """Bars with indicators, and technical_score: the mean of what is known."""
    rsi, close = F.col("rsi_14"), F.col("close")
    by_rsi = F.when(rsi.between(30, 70), 50 + (rsi - 50) * 1.25).when(rsi > 70, 75 - (rsi - 70) * 2).otherwise(25 + rsi / 30 * 12.5)
    stack = F.when((close > F.col("ma_5")) & (F.col("ma_5") > F.col("ma_20")), 80.0).when((close < F.col("ma_5")) & (F.col("ma_5") < F.col("ma_20")), 20.0).otherwise(50.0)
    trend = F.when(F.col("adx_14") < 25, 50.0).when(F.col("plus_di_14") > F.col("minus_di_14"), 75.0).otherwise(25.0)
    mfi = F.col("mfi_14")
    flow = F.when(mfi.between(45, 70), 65.0).when((mfi > 80) | (mfi < 20), 35.0).otherwise(50.0)
    known = lambda x, *need: F.when(_all_known(need), x)
    score = mean_of(
        known(clamp(by_rsi, 20.0, 80.0), "rsi_14"),
        F.when(F.col("macd_histogram").isNotNull() & (close > 0), 50 + 30 * F.tanh(F.try_divide("macd_histogram", close * 0.005))),
        known(stack, "ma_5", "ma_20"), known(trend, "adx_14", "plus_di_14", "minus_di_14"), known(flow, "mfi_14"),
        known(F.when(F.col("supertrend_direction") > 0, 70.0).otherwise(30.0), "supertrend_direction"))
    return df.withColumn("technical_score", F.round(score, 4))


def _all_known(names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def margin_score(part: Column, whole: Column) -> Column:
    return F.when((whole != 0) & part.isNotNull(), clamp(50 + 30 * F.tanh(F.try_divide(part, whole) / 0.15)))


def financial_axis(revenue: Column, operating: Column, net: Column, assets: Column, equity: Column) -> Column:
    ratio = F.when((assets != 0) & equity.isNotNull(), clamp(50 + (F.try_divide(equity, assets) - 0.5) * 60))
    return F.round(mean_of(margin_score(operating, revenue), margin_score(net, revenue), ratio), 4)


def news_axis(sentiment: Column) -> Column:
    return F.round(clamp(50 + 25 * F.tanh(sentiment)), 4)


def disclosure_axis(flags: Column) -> Column:
    return F.round(clamp(50 - F.least(F.lit(40.0), flags * 20.0)), 4)


def flow_axis(net: Column, holding: Column) -> Column:
    by_sign = F.when(net > 0, 60.0).when(net < 0, 40.0).when(net == 0, 50.0)
    return F.round(F.when(holding > 0, clamp(50 + 30 * F.tanh(F.try_divide(net, holding) / 0.001))).otherwise(by_sign), 4)


def risk_axis(warnings: Column) -> Column:
    """From an array of warning types; none is 50."""
    severe = lambda w: F.exists(F.array(*map(F.lit, SEVERE)), lambda t: F.contains(F.lower(w), t))
    penalty = F.aggregate(F.coalesce(warnings, F.array().cast("array<string>")), F.lit(0.0), lambda a, w: a + F.when(severe(w), 25.0).otherwise(15.0))
    return clamp(50 - F.least(F.lit(40.0), penalty))


def aggregate(axes: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """axes with overall_score, coverage, available_axes and label: weighted by
    the axes that are there; 50 if none is."""
    if set(weights) != set(WEIGHTS) or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("a weight of at least 0 for each axis, with a positive total")
    zero = F.lit(0.0)
    total = sum((F.when(F.col(k).isNotNull(), F.col(k) * w).otherwise(zero) for k, w in weights.items()), zero)
    weight = sum((F.when(F.col(k).isNotNull(), w).otherwise(zero) for k, w in weights.items()), zero)
    count = sum((F.col(k).isNotNull().cast("int") for k in weights), F.lit(0))
    overall = F.round(F.coalesce(F.try_divide(total, F.when(weight > 0, weight)), F.lit(50.0)), 4)
    out = axes.withColumns({"overall_score": overall, "coverage": F.round(weight / sum(weights.values()), 4), "available_axes": count})
    return out.withColumn("label", F.when(F.col("overall_score") >= 65, "positive").when(F.col("overall_score") <= 35, "negative").otherwise("neutral"))


def reference_signal(df: DataFrame) -> DataFrame:
    """df (overall_score, rise_probability, warning_count) with signal and strength."""
    consensus = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("overall_score") - 50) / 50 * 0.55 + (F.col("rise_probability") - 0.5) * 2 * 0.45))
    warned, missing = F.col("warning_count") > 0, F.col("overall_score").isNull() | F.col("rise_probability").isNull()
    signal = F.when(warned, "risk_aware").when(missing, "data_insufficient").when(consensus >= 0.12, "positive_watch").when(consensus <= -0.12, "defensive_watch").otherwise("neutral_watch")
    return df.withColumns({"signal": signal, "strength": F.when(warned, 100.0).when(missing, 0.0).otherwise(F.round(F.abs(consensus) * 100, 2))})


def report_fields(df: DataFrame) -> DataFrame:
    """df (warning_count, missing_count, confidence_lower, confidence_upper) with
    downside_risk and confidence, low where there is no band."""
    band = F.col("confidence_upper") - F.col("confidence_lower")
    downside = F.when(F.col("warning_count") > 0, "high").when(F.col("missing_count") > 0, "medium").otherwise("low")
    return df.withColumns({"downside_risk": downside, "confidence": F.when(band <= 0.15, "high").when(band <= 0.30, "medium").otherwise("low")})


def flow_signal(foreign: Column, institution: Column) -> Column:
    both = foreign + institution
    return F.when(both > 0, "net_inflow").when(both < 0, "net_outflow").otherwise("balanced")


def allocations(holdings: DataFrame) -> DataFrame:
    """Holdings with their share of the currency's market value. The totals are
    aggregated first and joined back, so a currency may hold most rows."""
    totals = holdings.groupBy("currency").agg(F.sum("market_value").alias("total"))
    return holdings.join(totals, "currency").withColumn("allocation", F.coalesce(F.try_divide("market_value", "total"), F.lit(0.0))).drop("total")


def portfolio(holdings: DataFrame) -> DataFrame:
    """One row a currency: sums, concentration and flags. Of equal largest
    holdings the first symbol counts."""
    value, profit = F.col("market_value"), F.col("profit_loss_after_cost")
    out = allocations(holdings).groupBy("currency").agg(
        F.count("*").alias("holding_count"), F.sum(value).alias("market_value"), F.sum("purchase_amount").alias("purchase_amount"), F.sum(profit).alias("profit_loss_after_cost"),
        F.count_if(profit >= 0).alias("profitable_count"), F.count_if(profit < 0).alias("loss_making_count"), F.min_by("symbol", F.struct(-F.col("allocation"), F.col("symbol"))).alias("largest_symbol"), F.max("allocation").alias("largest_allocation"),
        F.sum(F.col("allocation") * F.col("allocation")).alias("concentration_index"), F.sum(F.when(profit < 0, value).otherwise(0.0)).alias("loss_value"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"profit_rate_after_cost": ratio("profit_loss_after_cost", "purchase_amount"), "effective_holding_count": ratio(F.lit(1.0), "concentration_index"), "loss_exposure": ratio("loss_value", "market_value")})
    level = F.when((F.col("largest_allocation") >= 0.5) | (F.col("concentration_index") >= 0.35), "high").when((F.col("largest_allocation") >= 0.3) | (F.col("concentration_index") >= 0.2), "moderate").otherwise("balanced")
    out = out.withColumn("concentration_level", level)
    flags = F.array_compact(F.array(F.when(level == "high", F.lit("high_concentration")), F.when(F.col("loss_exposure") >= 0.25, F.lit("loss_concentration")), F.when(F.col("profit_loss_after_cost") < 0, F.lit("negative_after_cost_return"))))
    return out.withColumn("risk_flags", flags).drop("loss_value")


def portfolio_signal(by_currency: DataFrame) -> DataFrame:
    loss, high = F.bool_or(F.col("loss_exposure") >= 0.25), F.bool_or(F.col("concentration_level") == "high")
    return by_currency.agg(F.when(loss, "loss_watch").when(high, "concentration_watch").otherwise("balanced_monitor").alias("reference_signal"))


def light_prediction(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """Rise probability of each symbol from its last 20 log returns; symbols
    with fewer than 30 bars, or a price not above 0, have none."""
    turn = W.partitionBy("symbol").orderBy(F.desc("ts"))
    everything = W.partitionBy("symbol")
    r = bars.withColumns({"ret": F.when(F.lag("close").over(by_time()) > 0, F.ln(F.try_divide("close", F.lag("close").over(by_time())))), "bars": F.count("*").over(everything), "least": F.min("close").over(everything)})
    r = r.where("bars >= 30 and least > 0").withColumn("n", F.row_number().over(turn)).where("n <= 20 and ret is not null")
    a = r.groupBy("symbol").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("spread"), F.count("*").alias("n"))
    score = F.col("mean") * horizon / F.greatest(F.col("spread") * F.sqrt(F.lit(float(horizon))), F.lit(1e-6))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-6.0), F.least(F.lit(6.0), score))))
    width = F.least(F.lit(0.25), F.greatest(F.lit(0.08), 1 / F.sqrt("n")))
    return a.withColumn("p", p).select("symbol", F.round("p", 6).alias("rise_probability"), F.round(F.greatest(F.lit(0.0), F.col("p") - width), 6).alias("confidence_lower"), F.round(F.least(F.lit(1.0), F.col("p") + width), 6).alias("confidence_upper"), F.col("n").alias("observations"))


FEATURES = ["return_1", "return_5", "sma_5_gap", "sma_20_gap", "volatility_20", "volume_ratio", "rsi_14"]


def features(bars: DataFrame, horizon: int = 5, lookback: int = 20) -> DataFrame:
    """Seven features of each bar from the bars up to it, and the label: whether
    the close is higher `horizon` bars on (null for the last bars)."""
    if horizon < 1:
        raise ValueError("horizon must be positive")
    change = F.col("close") - F.lag("close").over(by_time())
    df = bars.withColumns({"change": change, "n": F.row_number().over(by_time()) - 1, "ret": F.try_divide("close", F.lag("close").over(by_time())) - 1})
    gains, losses = F.greatest("change", F.lit(0.0)), F.greatest(-F.col("change"), F.lit(0.0))
    up, down = F.avg(gains).over(by_time().rowsBetween(-13, 0)), F.avg(losses).over(by_time().rowsBetween(-13, 0))
    rsi = F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(up, down)))
    close = F.col("close")
    ratio = F.col("volume") / F.greatest(F.avg("volume").over(by_time().rowsBetween(-19, 0)), F.lit(1.0))
    label = (F.lead("close", horizon).over(by_time()) > close).cast("int")
    columns = [F.col("ret"), F.try_divide(close, F.lag("close", 5).over(by_time())) - 1, F.try_divide(close, sma("close", 5)) - 1, F.try_divide(close, sma("close", 20)) - 1, F.stddev_pop("ret").over(by_time().rowsBetween(-19, 0)), ratio, rsi / 100]
    return df.select("symbol", "ts", "n", *[c.alias(k) for k, c in zip(FEATURES, columns)], label.alias("label")).where(F.col("n") >= lookback)


def purged_splits(samples: DataFrame, horizon: int, min_train: int = 60, n_splits: int = 3) -> DataFrame:
    """symbol, fold, train_end, test_start, test_end of (symbol, n): expanding
    training rows, a gap of the label horizon, then the test rows."""
    size = F.greatest(F.lit(10), F.floor((F.col("n") - min_train - horizon) / n_splits)).cast("int")
    k = F.col("fold") - 1
    start = min_train + horizon + k * size
    out = samples.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    return out.select("symbol", "fold", (start - horizon).alias("train_end"), start.alias("test_start"), F.least(F.col("n").cast("int"), start + size).alias("test_end")).where("test_start < test_end")


def accuracy_brier(df: DataFrame, probability: str, label: str, keys: list[str]) -> DataFrame:
    p, y = F.col(probability), F.col(label)
    return df.where(p.isNotNull() & y.isNotNull()).groupBy(*keys).agg(F.avg(((p >= 0.5).cast("int") == y).cast("double")).alias("accuracy"), F.avg((p - y) * (p - y)).alias("brier"), F.count("*").alias("n"))


def gbt_prediction(rows: DataFrame, trees: int = 40, depth: int = 3, rate: float = 0.05, share: float = 0.9, seed: int = 42) -> DataFrame:
    """symbol, ts, rise_probability of the latest bars, by gradient-boosted trees
    fitted on all labelled rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    whole = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip").transform(rows)
    known = whole.where("label is not null")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=share, seed=seed, labelCol="label").fit(known)
    last = whole.groupBy("symbol").agg(F.max("ts").alias("ts"))
    return model.transform(whole.join(last, ["symbol", "ts"])).select("symbol", "ts", F.round(vector_to_array("probability")[1], 6).alias("rise_probability"))


def gbt_validated(rows: DataFrame, horizon: int = 5, n_splits: int = 3, **parameters) -> DataFrame:
    """symbol, ts, rise_probability, confidence_lower, confidence_upper, accuracy,
    brier_score, validation_samples of the latest bars.

    Rows are `features` with n. In each purged fold trees are fitted on the rows
    before the gap, of all symbols, and tried on the rows after it; what they give
    there makes accuracy, Brier score and the width of the band, 1.96 standard
    errors of the probability. Nothing is returned where no fold can be tried.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    place = F.row_number().over(W.partitionBy("symbol").orderBy("ts")) - 1
    whole = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip").transform(rows)
    known = whole.where("label is not null").withColumn("place", place)
    folds = purged_splits(known.groupBy("symbol").agg(F.count("*").alias("n")), horizon, n_splits=n_splits)
    dealt = known.join(folds, "symbol")
    tried = None
    for fold in range(1, n_splits + 1):
        own = dealt.where(F.col("fold") == fold)
        train, test = own.where("place < train_end"), own.where("place >= test_start and place < test_end")
        if train.select("label").distinct().count() < 2:
            continue
        model = GBTClassifier(maxIter=parameters.get("trees", 40), maxDepth=parameters.get("depth", 3), stepSize=parameters.get("rate", 0.05), subsamplingRate=parameters.get("share", 0.9), seed=parameters.get("seed", 42), labelCol="label").fit(train)
        found = model.transform(test).select("symbol", "label", vector_to_array("probability")[1].alias("p"))
        tried = found if tried is None else tried.unionByName(found)
    if tried is None:
        raise ValueError("too few rows, or labels of one kind only, for validation")
    measured = accuracy_brier(tried, "p", "label", ["symbol"])
    p = F.col("rise_probability")
    width = 1.96 * F.sqrt(p * (1 - p) / F.col("n"))
    return gbt_prediction(rows, **parameters).join(measured, "symbol").select(
        "symbol", "ts", "rise_probability", F.round(F.greatest(F.lit(0.0), p - width), 6).alias("confidence_lower"), F.round(F.least(F.lit(1.0), p + width), 6).alias("confidence_upper"),
        F.round("accuracy", 4).alias("accuracy"), F.round("brier", 4).alias("brier_score"), F.col("n").alias("validation_samples"))


def content_fingerprint(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and fingerprint: 256 bits of what a key's rows hold, in any order of
    rows. Hashes of rows are added up, so no task holds a key's rows together."""
    whole = F.struct(*columns)
    sums = [F.sum(F.xxhash64(F.lit(k), whole).cast("decimal(38,0)")).cast("string") for k in range(2)]
    told = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.col("n").cast("string"), "a", "b")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), sums[0].alias("a"), sums[1].alias("b")).select(*keys, F.sha2(told, 256).alias("fingerprint"))


AXES = ["technical", "financial", "news", "disclosure", "investor_flow", "risk"]


def joined_axes(symbols: DataFrame, axes: dict[str, DataFrame]) -> DataFrame:
    """symbols with one score an axis from (symbol, score) tables. A symbol that
    an axis lacks, or has no finite score for, has a null there, and the other
    axes are as they would be without it."""
    out = symbols
    for name in AXES:
        if name in axes:
            score = axes[name].groupBy("symbol").agg(F.max(F.when(F.abs(F.col("score")) < float("inf"), F.col("score"))).alias(name))
            out = out.join(score, "symbol", "left")
        else:
            out = out.withColumn(name, F.lit(None).cast("double"))
    return out


def isolated_axes(symbols: DataFrame, loaders: dict[str, Callable[[], DataFrame]], keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, dict[str, str]]:
    """(joined_axes of what could be loaded, a status an axis): available,
    unavailable where there is no loader, or the error of a loader that fails, when
    its plan is made or when it runs. Each axis is written by a job of its own with
    keep(frame, name), which reads it back, so a failure stays with its axis."""
    axes, status = {}, {}
    for name in AXES:
        if name not in loaders:
            status[name] = "unavailable"
            continue
        try:
            axes[name] = keep(loaders[name]().select("symbol", F.col("score").cast("double").alias("score")), name)
            status[name] = "available"
        except Exception as e:  # whatever a source raises makes its axis unavailable
            status[name] = f"failed: {type(e).__name__}"
    return joined_axes(symbols, axes), status
