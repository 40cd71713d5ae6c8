"""Counters and histograms as they are scraped: cumulative, now and then reset.

Everything is sums by series and time, so it merges across tasks; what a group
holds together is a row a bucket bound, of which there are a fixed few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed upper bounds of duration buckets, in seconds.
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf")]
LEAST_RATE = 0.001
ERROR_SHARE, SLOWEST, QUANTILE = 0.05, 2.0, 0.95


def bucketed(requests: DataFrame, keys: list[str], duration: str, at: Column, bounds: list[float] = BOUNDS) -> DataFrame:
    """keys, at, le, n: how many requests of each time are no longer than each bound,
    those that are counted at one bound counting at all above it. Durations that are
    null or NaN are in no bucket. The bucket of a request is found before they are
    counted, so bounds multiply rows of the counts and not of the requests."""
    known = requests.where(F.col(duration).isNotNull() & ~F.isnan(F.col(duration).cast("double")))
    place = F.array_position(F.transform(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col(duration) <= b), F.lit(True)).cast("int")
    counted = known.groupBy(*keys, at.alias("at"), place.alias("_place")).agg(F.count("*").alias("_n"))
    spread = F.slice(F.array(*[F.lit(b) for b in bounds]), F.col("_place"), F.lit(len(bounds)))
    return counted.select(*keys, "at", "_n", F.explode(spread).alias("le")).groupBy(*keys, "at", "le").agg(F.sum("_n").alias("n"))


def cumulative(counts: DataFrame, series: list[str], value: str, until: list[str] | None = None) -> DataFrame:
    """Counts (series, at, value) as a counter shows them: running totals, begun anew
    in each group of `until`, as by a restart."""
    line = W.partitionBy(*series, *(until or [])).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn(value, F.sum(value).over(line))


def seconds(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")) / F.lit(1e6)


def rates(samples: DataFrame, series: list[str], value: str, range_seconds: int, step_seconds: int) -> DataFrame:
    """series, at, rate: the growth a second of counters over the range_seconds up to
    each multiple of step_seconds, where the range holds two samples or more.

    A value under the one before is a counter that began anew: what it shows is what
    it has grown. The growth between the first and the last sample is carried on to
    the ends of the range: wholly if the gap there is under 1.1 times the mean one,
    else by half a mean gap, and to the front no further than to where the counter
    would be 0. Samples are (series, at, value); of several at one time the largest
    counts.
    """
    one = samples.where(F.col("at").isNotNull() & F.col(value).isNotNull()).groupBy(*series, "at").agg(F.max(F.col(value).cast("double")).alias("_v"))
    line = W.partitionBy(*series).orderBy("at")
    before = F.lag("_v").over(line)
    grown = F.when(F.col("_v") >= before, F.col("_v") - before).otherwise(F.col("_v"))
    timed = one.select(*series, "_v", seconds(F.col("at")).alias("_t"), F.coalesce(grown, F.lit(0.0)).alias("_d"))
    # a sample is in the ranges that end at it or later and begin before it
    first = F.ceil(F.col("_t") / step_seconds)
    last = F.ceil((F.col("_t") + range_seconds) / step_seconds) - 1
    seen = timed.where(last >= first).select(*series, "_v", "_t", "_d", F.explode(F.sequence(first, last)).alias("_step"))
    every = seen.groupBy(*series, "_step").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.count("*").alias("_n"), (F.sum("_d") - F.min_by("_d", "_t")).alias("_grown"), F.min_by("_v", "_t").alias("_first")).where("_n > 1")
    end = F.col("_step") * step_seconds
    width = F.col("_b") - F.col("_a")
    mean = width / (F.col("_n") - 1)
    front, back = F.col("_a") - (end - range_seconds), end - F.col("_b")
    near = lambda gap: F.when(gap < mean * 1.1, gap).otherwise(mean / 2)
    zero = F.when((F.col("_grown") > 0) & (F.col("_first") >= 0), width * F.col("_first") / F.col("_grown"))
    ahead = F.least(near(front), F.coalesce(zero, near(front)))
    rate = F.col("_grown") * (width + ahead + near(back)) / width / range_seconds
    return every.select(*series, F.timestamp_seconds(end).alias("at"), rate.alias("rate"))


def quantile(buckets: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """keys and quantile of cumulative buckets (keys, le, value): the point, by a
    straight line within the bucket, under which the share q lies.

    The lowest bucket begins at 0 where its bound is above that; in the open bucket
    it is the highest bound. Without the open bucket, with fewer than two, or without
    a request, it is null; a bucket below the one before counts as that.
    """
    if not 0 <= q <= 1:
        raise ValueError("a quantile is from 0 to 1")
    summed = buckets.groupBy(*keys, "le").agg(F.sum(F.col(value).cast("double")).alias("_v"))
    listed = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("le", "_v"))).alias("_l"))
    # never falling: each is the most so far
    line = F.transform("_l", lambda b, i: F.struct(b.le.alias("le"), F.array_max(F.transform(F.slice("_l", F.lit(1), i + 1), lambda x: x._v)).alias("v")))
    found = listed.withColumn("_l", line).withColumn("_total", F.element_at("_l", -1).v).withColumn("_rank", q * F.col("_total"))
    found = found.withColumn("_k", F.array_position(F.transform("_l", lambda b: b.v >= F.col("_rank")), F.lit(True)).cast("int"))
    at, size = lambda k: F.get(F.col("_l"), k), F.size("_l")
    own, lower = at(F.col("_k") - 1), at(F.col("_k") - 2)
    start = F.when(F.col("_k") > 1, lower.le).when(own.le > 0, 0.0)
    under = F.when(F.col("_k") > 1, lower.v).otherwise(0.0)
    inside = start + (own.le - start) * F.try_divide(F.col("_rank") - under, own.v - under)
    answer = F.when(F.col("_k") == size, at(size - 2).le).when(start.isNull(), own.le).otherwise(F.coalesce(inside, start))
    sound = (size > 1) & (F.element_at("_l", -1).le == float("inf")) & (F.col("_total") > 0)
    return found.select(*keys, F.when(sound, answer).alias("quantile"))


def error_share(samples: DataFrame, series: list[str], status: str, value: str, range_seconds: int = 300, step_seconds: int = 60) -> DataFrame:
    """at and error_share: the rate of requests whose status is 500 or more over that
    of all, which counts as LEAST_RATE at least."""
    found = rates(samples, series, value, range_seconds, step_seconds)
    bad = F.col(status).cast("string").startswith("5")
    return found.groupBy("at").agg((F.coalesce(F.sum(F.when(bad, F.col("rate"))), F.lit(0.0)) / F.greatest(F.sum("rate"), F.lit(LEAST_RATE))).alias("error_share"))


def slow_share(samples: DataFrame, series: list[str], value: str, q: float = QUANTILE, range_seconds: int = 300, step_seconds: int = 60) -> DataFrame:
    """at and quantile of the durations of the range, from rates of buckets (series
    with le) summed over all other keys."""
    return quantile(rates(samples, series, value, range_seconds, step_seconds), ["at"], "rate", q)


def firing(evaluations: DataFrame, keys: list[str], condition: Column, for_seconds: int) -> DataFrame:
    """evaluations with state: `firing` where the condition has held at every time for
    for_seconds or longer, `pending` where it holds, else `inactive`."""
    line = W.partitionBy(*keys).orderBy("at")
    holds = evaluations.withColumn("_holds", F.coalesce(condition, F.lit(False)))
    broken = F.max(F.when(~F.col("_holds"), F.col("at"))).over(line.rowsBetween(W.unboundedPreceding, 0))
    run = W.partitionBy(*keys, "_broken").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    since = holds.withColumn("_broken", broken).withColumn("_since", F.min(F.when(F.col("_holds"), F.col("at"))).over(run))
    lasted = seconds(F.col("at")) - seconds(F.col("_since")) >= for_seconds
    return since.withColumn("state", F.when(~F.col("_holds"), "inactive").when(lasted, "firing").otherwise("pending")).drop("_holds", "_broken", "_since")
