"""How often plans read and shuffle, and that large lists take the other way."""

import pytest
from pyspark.sql import functions as F

from quantloom.sources import feeds as D
from quantloom.sources import tables as T

SF = "/root/testdata/sf0.001"


def counted(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan.count("FileScan"), plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition")


#: The bars themselves take one shuffle by symbol and hour.
@pytest.mark.parametrize("name,scans,shuffles", [("pattern_rank", 1, 2), ("pattern_strategy", 1, 2), ("double_top_bottom", 1, 2), ("indicators_all", 1, 3), ("strategy_compare", 2, 5)])
def test_patterns_and_strategies_read_once(spark, name, scans, shuffles):
    from quantloom.plans import ALL

    found = counted(ALL[name](spark, SF))
    assert found[0] <= scans and found[1] <= shuffles, found


def test_logs_read_once(spark):
    from quantloom.operators import bars as B

    raw = T.hourly(spark, SF).select("*", F.lit("unadjusted").alias("price_basis"), F.col("volume").alias("seq"))
    assert counted(B.quality_logs(raw)) == (1, 2)
    assert counted(B.clean(raw)) == (1, 2)


def test_long_lists_of_subscriptions_are_joined(spark):
    rows = spark.createDataFrame([(i, f, k) for i, (f, k) in enumerate([("f", "K1"), ("f", "XXAB"), ("f", "none"), ("g", "XXAB"), (None, "AB"), ("f", None)])], "id int, feed string, key string")
    subs = spark.createDataFrame([("f", "K1", "ONE", 3), ("f", "K2", "AB", 2), ("f", "K3", "B", 1), ("g", "Q", "XAB", 9), ("g", "R", "AB", 9), ("f", "K4", "a" * 20, 0)], "feed string, key string, symbol string, ordinal int")
    want = {0: "ONE", 1: "B", 2: None, 3: "AB", 4: None, 5: None}
    for most in (500, 0):
        assert {r.id: r.symbol for r in D.subscribed(rows, subs, most).collect()} == want


def test_rows_are_added_and_removed_once(spark):
    from quantloom.operators import guards as G

    stored = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z"), (2, "z")], "k int, v string")
    assert sorted(((r.k or 0), r.v) for r in G.added(stored, new, ["k"]).collect()) == [(0, "b"), (1, "a"), (2, "z")]
    assert [r.v for r in G.removed(stored, F.col("k") == 1).collect()] == ["b"]
