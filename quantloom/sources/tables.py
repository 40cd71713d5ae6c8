"""Market tables projected from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASIS = "unadjusted"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(c, pattern)


def bars_of(ticks: DataFrame, unit: str) -> DataFrame:
    """OHLCV bars of (symbol, ts, price, size, seq): one aggregation, partial
    before the shuffle, so hot symbols cost no more than their bars."""
    first, last = F.struct("ts", "seq"), F.struct("ts", "seq")
    return ticks.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bar")).agg(
        F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", last).alias("close"), F.sum("size").cast("long").alias("volume"),
    ).withColumnRenamed("bar", "ts")


def event_ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col(symbol).cast("string").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1).cast("long").alias("size"), F.col("event_id").alias("seq"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(event_ticks(spark, sf_dir), "day")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(event_ticks(spark, sf_dir), "hour")


def user_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(event_ticks(spark, sf_dir, "user_id"), "day")


def order_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.lit(1).cast("long").alias("size"), F.col("o_orderkey").alias("seq"))
    return bars_of(ticks, "day")


def raw_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars as a feed might deliver them: out of order, repeated, with bad
    prices and volumes; seq is the order of arrival."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("symbol").orderBy("ts"))
    numbered = hourly(spark, sf_dir).withColumn("n", n)
    late = F.when(F.col("n") % 11 == 0, 25).otherwise(0)
    base = numbered.select("symbol", "ts", "open", F.when(F.col("n") % 23 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low", "close",
                           F.when(F.col("n") % 29 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"), (F.col("n") * 10 + late).cast("long").alias("seq"), F.lit(BASIS).alias("price_basis"), "n")
    again = base.where("n % 13 = 0").withColumn("seq", (F.col("n") * 10 + 1).cast("long")).withColumn("close", F.col("close") + 0.5)
    return base.unionByName(again).drop("n")


def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits and dividends with two points in time and revisions: one of each
    event, by user."""
    e = table(spark, sf_dir, "events")
    one = e.select(
        F.col("user_id").cast("string").alias("symbol"), F.lit("feed").alias("source"), F.col("event_id").cast("string").alias("event_id"), F.lit(1).alias("revision"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("effective_at"), (F.date_trunc("day", "ts") - F.expr("make_interval(0, 0, 0, 1 + event_id % 5)")).cast("timestamp_ntz").alias("known_at"),
        F.expr("cast(case event_id % 3 when 0 then 0.999 when 1 then 0.998 else 1.002 end as decimal(24,12))").alias("price_factor"),
        F.expr("cast(case event_id % 3 when 0 then 1.001 when 1 then 1.002 else 0.998 end as decimal(24,12))").alias("volume_factor"), F.lit("confirmed").alias("status"), F.col("event_id").alias("n"))
    two = one.where("n % 4 = 0").withColumn("revision", F.lit(2)).withColumn("known_at", F.expr("known_at + interval 2 days")).withColumn("status", F.expr("case when n % 8 = 0 then 'cancelled' else 'confirmed' end")).withColumn("price_factor", F.expr("cast(price_factor * 1.1 as decimal(24,12))"))
    return one.unionByName(two).drop("n")
