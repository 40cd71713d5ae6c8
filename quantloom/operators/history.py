"""Stored history: keyed merges, retention, pages, inventories, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUANTUM = "decimal(24,12)"


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """old and new with one row a key: the last written (by order, new over old)."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    turn = W.partitionBy(*keys).orderBy(F.desc("_gen"), *(order or []))
    return both.withColumn("_n", F.row_number().over(turn)).where("_n = 1").drop("_n", "_gen")


def insert_outcomes(stored: DataFrame, new: DataFrame, keys: list[str], factors: list[str], batch: str | None = None) -> DataFrame:
    """new, its factors put to twelve places, half to even, with outcome: `created`
    for a row that is to be added, `unchanged` for one equal to a stored one or to
    another of the new ones, `conflict` for one that differs from a row of its keys,
    stored or new, and `rejected` for one that would be added but for a conflict in
    its batch. All rows are one batch where none is named; equal rows may lie in
    several batches, and the first by name adds the row. Nulls equal each other."""
    exact = new.withColumns({c: F.bround(c, 12).cast(QUANTUM) for c in factors})
    rest = [c for c in stored.columns if c not in keys]
    known = stored.select(*keys, F.struct(*rest).alias("_stored")).dropDuplicates(keys)
    own, same = F.struct(*rest), W.partitionBy(*keys)
    seen = exact.withColumn("_own", own).join(known, keys, "left")
    differs = ~F.min("_own").over(same).eqNullSafe(F.max("_own").over(same)) | (F.col("_stored").isNotNull() & ~F.col("_own").eqNullSafe(F.col("_stored")))
    first = F.row_number().over(same.orderBy(F.col(batch) if batch else F.lit(1))) == 1
    told = seen.withColumn("outcome", F.when(differs, "conflict").when(F.col("_stored").isNotNull() | ~first, "unchanged").otherwise("created")).drop("_own", "_stored")
    bad = told.where("outcome = 'conflict'")
    refused = F.when(F.col("_bad") & (F.col("outcome") == "created"), "rejected").otherwise(F.col("outcome"))
    if batch is None:
        marked = told.withColumn("_bad", bad.agg(F.count("*") > 0).scalar())
    else:
        ill = bad.select(F.col(batch).alias("_batch")).distinct().withColumn("_bad", F.lit(True))
        marked = told.join(ill, F.col(batch).eqNullSafe(F.col("_batch")), "left").drop("_batch").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    return marked.withColumn("outcome", refused).drop("_bad")


def insert_revisions(stored: DataFrame, new: DataFrame, keys: list[str], factors: list[str], batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to add, conflicting rows) of `insert_outcomes`: a batch with a conflict
    adds nothing. A caller that writes the first and finds any of the second has
    written no part of a conflicting batch."""
    told = insert_outcomes(stored, new, keys, factors, batch)
    return told.where("outcome = 'created'").select(*stored.columns), told.where("outcome = 'conflict'")


def insert_counts(outcomes: DataFrame, *keys: str) -> DataFrame:
    """How many rows of `insert_outcomes` are created, unchanged, conflicting and
    rejected, by keys if there are any."""
    return outcomes.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("created", "unchanged", "conflict", "rejected")])


def filtered(df: DataFrame, **equal: object) -> DataFrame:
    """The rows that equal what is given; None asks for nothing."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    return df


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, **equal: object) -> DataFrame:
    """A page of the rows that equal what is given."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("1 to 500 rows, offset at least 0")
    return filtered(df, **equal).orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0, **equal: object) -> DataFrame:
    """A page, and with each of its rows the total under the same filters."""
    total = filtered(df, **equal).agg(F.count("*")).scalar()
    return page(df, order, limit, offset, **equal).select("*", total.alias("total"))


def insert_run(runs: DataFrame, results: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(runs to add, results to add): results need a run and runs a result; what
    lacks the other is left out, so that both tables can be published together."""
    return runs.join(results.select(key), key, "left_semi"), results.join(runs.select(key), key, "left_semi")


#: The most points of a run: the fixed bound of what a request may ask for.
MOST_POINTS = 365


def result_payloads(metrics: DataFrame, parts: dict[str, DataFrame], keys: list[str], order: list[str], most: int = MOST_POINTS) -> DataFrame:
    """keys, metrics and a column a part: the result of each run as JSON, decimals as
    texts. A part's rows are listed by `order`; one without rows is an empty list.

    A run has at most `most` rows a part, which is counted before they are gathered:
    a longer one fails the job, since a cut list would hide some.
    """
    def plain(df: DataFrame) -> Column:
        return F.struct(*[F.col(c).cast("string").alias(c) if t.startswith(("decimal", "timestamp", "date")) else F.col(c) for c, t in df.dtypes if c not in keys])

    out = metrics.select(*keys, F.to_json(plain(metrics)).alias("metrics"))
    for name, part in parts.items():
        sizes = part.groupBy(*keys).agg(F.count("*").alias("_n"))
        sized = part.join(sizes, keys).where(F.assert_true(F.col("_n") <= most, f"more than {most} rows of {name}").isNull())
        rows = F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(order)], plain(part).alias("row"))
        listed = sized.groupBy(*keys).agg(F.to_json(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["row"])).alias(name))
        out = out.join(listed, keys, "left").withColumn(name, F.coalesce(name, F.lit("[]")))
    return out


def severity_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("symbol").agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


INVENTORY = ["source_provider", "price_basis", "price_basis_rule_version", "data_stage", "interval", "aggregation_version"]


def inventory(bars: DataFrame) -> DataFrame:
    """Counts and time range by provenance, and what evidence each group lacks."""
    out = bars.groupBy(*INVENTORY).agg(F.count("*").alias("candle_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    unknown = lambda c, v, *names: [F.when(F.col(c) == v, F.lit(n)) for n in names]
    need = F.array_compact(F.array(*unknown("source_provider", "legacy_unknown", "original_provider_identifier", "provider_response_or_contract_reference"), *unknown("price_basis", "unknown", "endpoint_adjustment_semantics", "provider_contract_test"), *unknown("price_basis_rule_version", "legacy_unknown", "versioned_price_basis_rule")))
    return out.withColumn("required_evidence", F.array_distinct(need)).withColumn("review_status", F.when(F.size("required_evidence") > 0, "evidence_required").otherwise("evidence_recorded"))


def inventory_totals(bars: DataFrame) -> DataFrame:
    groups = bars.groupBy(*INVENTORY).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("total_candles"), F.sum(F.when(F.col("price_basis") == "unknown", F.col("n")).otherwise(0)).alias("unknown_candles"), F.sum(F.when(F.col("source_provider") == "legacy_unknown", F.col("n")).otherwise(0)).alias("legacy_unknown_candles"), F.count("*").alias("total_groups"))


def inventory_review(bars: DataFrame, limit: int) -> DataFrame:
    """One row: totals over all bars, and of the first `limit` groups how many are
    ready or blocked, whether there are more, and what stands in the way."""
    groups = inventory(bars)
    totals = groups.agg(
        F.sum("candle_count").alias("total_candles"), F.sum(F.when(F.col("price_basis") == "unknown", F.col("candle_count")).otherwise(0)).alias("unknown_candles"),
        F.sum(F.when(F.col("source_provider") == "legacy_unknown", F.col("candle_count")).otherwise(0)).alias("legacy_unknown_candles"),
        F.sum(F.when(F.col("price_basis_rule_version") == "legacy_unknown", F.col("candle_count")).otherwise(0)).alias("legacy_rule_candles"), F.count("*").alias("total_groups"))
    shown = groups.orderBy(*INVENTORY).limit(limit).agg(F.struct(F.count("*").alias("n"), F.count_if(F.col("review_status") == "evidence_recorded").alias("ready"))).scalar()
    blockers = F.array_compact(F.array(
        F.when(F.col("unknown_candles") > 0, F.lit("unknown_price_basis_requires_source_specific_evidence")), F.when(F.col("legacy_unknown_candles") > 0, F.lit("legacy_rows_lack_provider_provenance")),
        F.when(F.col("legacy_rule_candles") > 0, F.lit("legacy_rows_lack_price_basis_rule_version"))))
    both = totals.withColumn("shown", shown)
    return both.select(*totals.columns, F.col("shown.ready").alias("review_ready_groups"), (F.col("shown.n") - F.col("shown.ready")).alias("blocked_review_groups"), (F.col("total_groups") > F.col("shown.n")).alias("groups_truncated"), blockers.alias("classification_blockers"))


def retention(rows: DataFrame, ts: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, how many are older)."""
    return rows.where(F.col(ts) >= cutoff), rows.agg(F.count_if(F.col(ts) < cutoff).alias("expired"), F.count("*").alias("total"))


def promote(models: DataFrame, version: str) -> DataFrame:
    """The model becomes the champion of its scope, algorithm and horizon; the
    champion before becomes a challenger. An unknown version changes nothing."""
    scope = ["scope_symbol", "algorithm", "horizon_days"]
    own = models.where(F.col("version") == version).select(*[F.col(c).alias(f"_{c}") for c in scope]).limit(1)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scope]
    joined = models.join(F.broadcast(own.withColumn("_hit", F.lit(True))), same[0] & same[1] & same[2], "left")
    stage = F.when(F.col("version") == version, "champion").when(F.col("_hit") & (F.col("registry_stage") == "champion"), "challenger").otherwise(F.col("registry_stage"))
    return joined.withColumn("registry_stage", stage).select(*models.columns)


def activate(weights: DataFrame, version: str) -> DataFrame:
    return weights.withColumn("active", F.col("version") == version)


def approvals(stored: DataFrame, new: DataFrame, evidence: list[str]) -> DataFrame:
    """New approvals with evidence_hash and the next revision of their event;
    those whose evidence is stored already are left out."""
    hashed = new.withColumn("evidence_hash", F.sha2(F.to_json(F.struct(*sorted(evidence))), 256)).dropDuplicates(["evidence_hash"])
    fresh = hashed.join(stored.select("evidence_hash"), "evidence_hash", "left_anti")
    last = stored.groupBy("event_id").agg(F.max("revision").alias("_last"))
    turn = F.row_number().over(W.partitionBy("event_id").orderBy("evidence_hash"))
    return fresh.join(last, "event_id", "left").withColumn("revision", (F.coalesce("_last", F.lit(0)) + turn).cast("int")).drop("_last")


def partition_plan(reference: DataFrame, ahead: int) -> DataFrame:
    """Names and bounds of the monthly partitions after each `day`."""
    month = F.trunc("day", "MM")
    start = F.explode(F.sequence(F.add_months(month, 1), F.add_months(month, ahead), F.expr("interval 1 month"))).alias("starts_on")
    return reference.select(start).distinct().select(F.concat(F.lit("bars_"), F.date_format("starts_on", "yyyy_MM")).alias("name"), "starts_on", F.add_months("starts_on", 1).alias("ends_before"))


def archive_candidates(names: DataFrame, cutoff: Column) -> DataFrame:
    parsed = names.select("name", F.try_to_timestamp(F.regexp_extract("name", r"^bars_(\d{4}_\d{2})$", 1), F.lit("yyyy_MM")).cast("date").alias("starts_on"))
    return parsed.where(F.add_months("starts_on", 1) <= cutoff)
