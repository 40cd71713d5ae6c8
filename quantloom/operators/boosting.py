"""Boosted trees by symbol: all symbols' trees grow together, a level a job.

Rows carry which node of their symbol's tree they are in. A level is one
aggregation of gradients by (symbol, node, feature, bin), which Spark combines
before it shuffles, and the best cut of each node is picked from running sums over
the bins. So no symbol is gathered anywhere, however long its history.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators.scoring import FEATURES, accuracy_brier, purged_splits
from quantloom.sources.shared import scratch

KEY = ["symbol", "fold"]


@dataclass(frozen=True)
class Boosting:
    """Fixed parameters of the model: trees, their depth, the learning rate, shares
    of rows and features a tree sees; and of the cuts: bins, the penalty on leaf
    values, and the least weight on either side of a cut."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.05
    row_share: float = 0.9
    feature_share: float = 0.9
    bins: int = 32
    penalty: float = 1.0
    least_weight: float = 1.0
    seed: int = 42


def binned(rows: DataFrame, features: list[str], bins: int) -> DataFrame:
    """rows with x, the bin of each feature: how many of the cut points of the
    training rows, at even shares of them, are below it. A null is in bin 0."""
    shares = [k / bins for k in range(1, bins)]
    cuts = rows.where("role = 'train'").groupBy(*KEY).agg(*[F.array_distinct(F.percentile_approx(f, shares, 100_000)).alias(f"_{f}") for f in features])

    def place(f: str) -> Column:
        below = F.size(F.filter(F.col(f"_{f}"), lambda c: c < F.col(f)))
        return F.when(F.col(f).isNull() | F.isnan(f), 0).otherwise(F.coalesce(below, F.lit(0))).cast("int")

    x = F.array(*[place(f) for f in features])
    return rows.join(cuts, KEY).select(*rows.columns, x.alias("x"))


def chance(p: Boosting, tree: int, *parts: Column) -> Column:
    """A number from 0 to 1 that hangs on its parts alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(p.seed), F.lit(tree), *parts), 11).cast("double") / float(1 << 53)


def seen_features(p: Boosting, tree: int, n: int) -> Column:
    """The numbers of the features that a symbol's tree sees."""
    many = max(1, int(n * p.feature_share))
    ranked = F.array_sort(F.array(*[F.struct(chance(p, tree, *KEY, F.lit(f)).alias("u"), F.lit(f).alias("f")) for f in range(n)]))
    return F.transform(F.slice(ranked, 1, many), lambda s: s.f)


def splits(rows: DataFrame, p: Boosting, tree: int, n: int) -> DataFrame:
    """KEY, node, f, b: the best cut of each node that has one. A row goes left if
    its bin of feature f is b or less. Of equal gains the first feature, then the
    lowest bin."""
    long = rows.select(*KEY, "node", "g", "h", F.posexplode("x").alias("f", "b"), seen_features(p, tree, n).alias("_seen")).where(F.array_contains("_seen", F.col("f")))
    sums = long.groupBy(*KEY, "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    of = W.partitionBy(*KEY, "node", "f")
    upto = of.orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    cut = sums.select(*KEY, "node", "f", "b", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(of).alias("gt"), F.sum("h").over(of).alias("ht"))
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    worth = lambda g, h: g * g / (h + p.penalty)
    gain = worth(F.col("gl"), F.col("hl")) + worth(gr, hr) - worth(F.col("gt"), F.col("ht"))
    able = cut.withColumn("gain", gain).where((F.col("hl") >= p.least_weight) & (hr >= p.least_weight) & (F.col("gain") > 1e-9))
    # sums in another order differ in their last places: equal gains are told by nine
    best = able.groupBy(*KEY, "node").agg(F.max(F.struct(F.round("gain", 9).alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"))).alias("s"))
    return best.select(*KEY, "node", (-F.col("s.f")).alias("f"), (-F.col("s.b")).alias("b"))


def moved(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows in the nodes below their cuts: 2n and 2n + 1; where there is no cut they stay."""
    right = (F.get("x", F.col("f")) > F.col("b")).cast("long")
    return rows.join(cuts, [*KEY, "node"], "left").withColumn("node", F.when(F.col("f").isNull(), F.col("node")).otherwise(2 * F.col("node") + right)).drop("f", "b")


def boosted(rows: DataFrame, features: list[str] = FEATURES, p: Boosting = Boosting(), keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """rows (symbol, fold, n, role, label, features) with probability, of a model for
    each symbol and fold, fitted to its rows of role `train`; n tells a key's rows
    apart. Keys without a training row are left out. keep(frame, name) writes a frame and reads it back: by
    default as Parquet in the shared folder, which cuts lineage after each level."""
    spark = rows.sparkSession
    root = scratch(spark, "boosting") if keep is None else None

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    keep = keep or written
    whole = keep(binned(rows, features, p.bins), "binned")
    state = whole.select(*KEY, "n", "role", "label", "x", F.lit(0.0).alias("margin"))
    for tree in range(p.trees):
        probability = 1 / (1 + F.exp(-F.col("margin")))
        seen = (F.col("role") == "train") & (chance(p, tree, *KEY, F.col("n")) < p.row_share)
        now = state.withColumns({"node": F.lit(1).cast("long"), "g": F.when(seen, probability - F.col("label")), "h": F.when(seen, probability * (1 - probability))})
        for level in range(p.depth):
            now = moved(now, keep(splits(now.where("g is not null"), p, tree, len(features)), f"cuts-{tree}-{level}"))
        values = now.where("g is not null").groupBy(*KEY, "node").agg((-F.sum("g") / (F.sum("h") + p.penalty) * p.rate).alias("value"))
        state = keep(now.join(values, [*KEY, "node"], "left").withColumn("margin", F.col("margin") + F.coalesce("value", F.lit(0.0))).select(*state.columns), f"margins-{tree}")
    told = state.select(*KEY, "n", (1 / (1 + F.exp(-F.col("margin")))).alias("probability"))
    return whole.drop("x").join(told, [*KEY, "n"])


def prediction_rows(rows: DataFrame, horizon: int, min_train: int = 60, n_splits: int = 3) -> DataFrame:
    """`scoring.features` as rows for `boosted`: purged folds 1 to n_splits, with
    their training and test rows, and fold 0, which trains on every labelled row and
    predicts the latest. Folds whose training labels are all alike are left out."""
    place = F.row_number().over(W.partitionBy("symbol").orderBy("ts")) - 1
    known = rows.where("label is not null").withColumn("place", place)
    folds = purged_splits(known.groupBy("symbol").agg(F.count("*").alias("n")), horizon, min_train, n_splits).select("symbol", "fold", "train_end", "test_start", "test_end")
    role = F.when(F.col("place") < F.col("train_end"), "train").when((F.col("place") >= F.col("test_start")) & (F.col("place") < F.col("test_end")), "test")
    tried = known.join(folds, "symbol").withColumn("role", role).where("role is not null").drop("place", "train_end", "test_start", "test_end")
    latest = rows.withColumn("_last", F.max("ts").over(W.partitionBy("symbol"))).where("ts = _last").drop("_last").withColumn("fold", F.lit(0)).withColumn("role", F.lit("latest")).withColumn("n", -1 - F.col("n"))
    final = known.drop("place").withColumn("fold", F.lit(0)).withColumn("role", F.lit("train"))
    both = tried.unionByName(final).unionByName(latest)
    mixed = both.where("role = 'train'").groupBy(*KEY).agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select(*KEY)
    return both.join(mixed, KEY, "left_semi")


def predicted(rows: DataFrame, horizon: int = 5, p: Boosting = Boosting(), min_train: int = 60, n_splits: int = 3) -> DataFrame:
    """symbol, ts, rise_probability, confidence_lower, confidence_upper, accuracy,
    brier_score, validation_samples: the latest bar of each symbol by a model of its
    own, and how such models did in its purged folds. The band is 1.96 standard
    errors of the probability over the rows tried. Symbols with too few rows for a
    fold, or labels of one kind, have none. rows: `scoring.features`."""
    found = boosted(prediction_rows(rows, horizon, min_train, n_splits), FEATURES, p)
    measured = accuracy_brier(found.where("role = 'test'"), "probability", "label", ["symbol"])
    chance_ = F.col("probability")
    width = 1.96 * F.sqrt(chance_ * (1 - chance_) / F.col("samples"))
    return found.where("role = 'latest'").select("symbol", "ts", "probability").join(measured.withColumnRenamed("n", "samples"), "symbol").select(
        "symbol", "ts", F.round("probability", 6).alias("rise_probability"), F.round(F.greatest(F.lit(0.0), chance_ - width), 6).alias("confidence_lower"), F.round(F.least(F.lit(1.0), chance_ + width), 6).alias("confidence_upper"),
        F.round("accuracy", 4).alias("accuracy"), F.round("brier", 4).alias("brier_score"), F.col("samples").alias("validation_samples"))
