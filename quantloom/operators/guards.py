"""Guards of names, parameters, batches and addresses, and small ordered reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A fixed pattern of symbols.
SYMBOL = r"^[A-Z0-9.-]{1,16}$"
#: Fixed bounds of request parameters: the least and the most.
BOUNDS = {"limit": (1, 500), "fast_period": (2, 60), "slow_period": (3, 200), "n_splits": (2, 6), "warmup": (21, 120)}


def symbol_of(text: Column) -> Column:
    return F.upper(F.trim(text))


def symbol_is_valid(text: Column) -> Column:
    return F.coalesce(F.rlike(symbol_of(text), F.lit(SYMBOL)), F.lit(False))


def provenance_is_valid(provider: Column, rule_version: Column, most: int = 32) -> Column:
    """Both names are there and no longer than what is stored."""
    named = lambda c: F.coalesce(F.length(c), F.lit(0)).between(1, most)
    return named(provider) & named(rule_version)


def within(name: str, value: int) -> int:
    """value, if it is within the bounds of the parameter."""
    low, high = BOUNDS[name]
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


def unknown(asked: Column, known: list[str]) -> Column:
    """The names in an array that aren't known, in order."""
    return F.array_except(asked, F.array(*[F.lit(k) for k in known]) if known else F.array().cast("array<string>"))


def missing(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The keys asked for that aren't known, once each."""
    return asked.select(key).distinct().join(known.select(key), key, "left_anti")


def looked_up(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the table's value; the job fails at a key that isn't there, whichever
    columns are read."""
    one = table.groupBy(key).agg(F.first(value).alias(value))
    joined = rows.join(one.withColumn("_there", F.lit(True)), key, "left")
    return joined.where(F.assert_true(F.col("_there").isNotNull(), F.concat(F.lit("not found: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).isNull()).drop("_there")


def ingestion_errors(actions: DataFrame, batch: DataFrame) -> DataFrame:
    """actions with error, null if sound: against their batch (batch_id, source,
    symbol, start, end, fetched_at, limit) the provenance must be equal, the time
    within the range, known by the fetch, and the batch within its limit."""
    b = batch.select("batch_id", *[F.col(c).alias(f"_{c}") for c in ("source", "symbol", "start", "end", "fetched_at", "limit")])
    joined = actions.join(b, "batch_id", "left").withColumn("_n", F.count("*").over(W.partitionBy("batch_id")))
    error = F.when(F.col("_source").isNull(), "unknown batch").when(F.col("_start") > F.col("_end"), "range").when(~F.col("_limit").between(1, 500), "limit bounds").when(F.col("_n") > F.col("_limit"), "batch limit")
    error = error.when((F.col("source") != F.col("_source")) | (F.upper("symbol") != F.upper(F.trim("_symbol"))), "provenance").when(~F.col("effective_at").between(F.col("_start"), F.col("_end")), "effective_at").when(F.col("known_at") > F.col("_fetched_at"), "known_at")
    return joined.withColumn("error", error).select(*actions.columns, "error")


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def is_https(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PROTOCOL")) == "https"


def is_plain_https(url: Column) -> Column:
    """https without a query or a fragment."""
    return is_https(url) & F.try_parse_url(url, F.lit("QUERY")).isNull() & F.try_parse_url(url, F.lit("REF")).isNull()


def most_subscribed(subscriptions: DataFrame, most: int) -> DataFrame:
    """The symbols with the most subscribers, up to the cap of a feed."""
    return subscriptions.groupBy("symbol").agg(F.count("*").alias("subscribers")).orderBy(F.desc("subscribers"), "symbol").limit(most)


def recent(seen: DataFrame, owner: str, item: str, at: str, most: int) -> DataFrame:
    """owner and items: the last `most` different ones, latest first. Ranked
    before they are gathered, so no list is longer than that."""
    last = seen.groupBy(owner, item).agg(F.max(at).alias("last"))
    turn = F.row_number().over(W.partitionBy(owner).orderBy(F.desc("last"), item))
    kept = last.withColumn("turn", turn).where(F.col("turn") <= most)
    return kept.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct("turn", item))).alias("l")).select(owner, F.transform("l", lambda x: x[item]).alias("items"))


def chart_scale(values: DataFrame, column: str, pad: float = 0.08) -> DataFrame:
    """low and high of an axis that leaves a share of the range on either side."""
    ends = values.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    room = (F.col("b") - F.col("a")) * pad
    return ends.select((F.col("a") - room).alias("low"), (F.col("b") + room).alias("high"))


def totals_by(rows: DataFrame, owner: str, kind: str, amount: str, kinds: dict[str, str]) -> DataFrame:
    """owner and a total a kind; kinds: value: column."""
    return rows.groupBy(owner).agg(*[F.sum(F.when(F.col(kind) == k, F.col(amount))).alias(c) for k, c in kinds.items()])


def latest_of(parts: dict[str, DataFrame], key: str, at: str) -> DataFrame:
    """key and data_as_of: the latest time over all parts, for the keys of the first."""
    out = None
    for name, part in parts.items():
        last = part.groupBy(key).agg(F.max(at).alias(name))
        out = last if out is None else out.join(last, key, "left")
    times = [F.col(n) for n in parts]
    return out.select(key, (F.greatest(*times) if len(times) > 1 else times[0]).alias("data_as_of"))


def disable(alerts: DataFrame, ids: Column) -> DataFrame:
    """Active alerts of the ids become disabled; others stay as they are."""
    return alerts.withColumn("status", F.when(ids & (F.col("status") == "active"), "disabled").otherwise(F.col("status")))


def added(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and those of the new rows whose keys aren't stored, each key once;
    nulls equal each other."""
    own = stored.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return stored.unionByName(new.dropDuplicates(keys).join(own, same, "left_anti").select(*stored.columns))


def removed(stored: DataFrame, ids: Column) -> DataFrame:
    """stored without the rows of the ids; a row for which that can't be told stays."""
    return stored.where(~F.coalesce(ids, F.lit(False)))
