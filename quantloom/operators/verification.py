"""Effective dates of corporate actions against registered sources, fail-closed:
whatever isn't shown to be sound has a reason, and only what has none counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed words of a source's metadata.
INTEGRATION = ["not_available", "requires_contract", "verified", "disabled"]
DATE_FIELD = ["absent", "unverified", "verified"]
ROLES = ["primary", "crosscheck", "not_suitable"]
#: Fixed patterns of a source's name and markets.
NAME, MARKET = r"^[a-z0-9_-]{1,40}$", r"^[A-Z]{2,8}$"


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def authoritative(url: Column) -> Column:
    """https at a host, by the usual port, without a user or a fragment."""
    port = F.regexp_extract(F.coalesce(part(url, "AUTHORITY"), F.lit("")), r":(\d*)$", 1)
    sound = (part(url, "PROTOCOL") == "https") & (F.coalesce(host(url), F.lit("")) != "") & part(url, "USERINFO").isNull() & port.isin("", "443") & (F.coalesce(part(url, "REF"), F.lit("")) == "")
    return F.coalesce(sound, F.lit(False))


def is_(condition: Column) -> Column:
    """The condition, false where it can't be told."""
    return F.coalesce(condition, F.lit(False))


def source_faults(sources: DataFrame) -> DataFrame:
    """sources (name, authority, markets, integration_status, corporate_action_data,
    effective_date_field_status, verification_role, reference_url) with fault: a
    name that stands twice, metadata that can't be, or `verified` without a verified
    effective date; null for a sound one. A null anywhere is a fault."""
    markets = is_((F.size("markets") > 0) & F.forall("markets", lambda m: is_(F.rlike(m, F.lit(MARKET)))))
    sound = is_(F.rlike("name", F.lit(NAME))) & is_(F.trim("authority") != "") & markets
    sound = sound & is_(F.col("integration_status").isin(INTEGRATION)) & is_(F.col("effective_date_field_status").isin(DATE_FIELD)) & is_(F.col("verification_role").isin(ROLES))
    dated = is_(F.col("corporate_action_data")) & is_(F.col("effective_date_field_status") == "verified")
    fault = F.when(~sound | ~authoritative(F.col("reference_url")), "invalid_metadata").when((F.col("integration_status") == "verified") & ~dated, "verified_without_effective_date")
    return sources.withColumn("fault", F.when(F.count("*").over(W.partitionBy("name")) > 1, "duplicate_source").otherwise(fault))


def verify(requests: DataFrame, sources: DataFrame, results: DataFrame) -> DataFrame:
    """requests (request_id, source, symbol, action_type, effective_at) with the
    answer's matched_effective_at, exact_match, evidence_id, evidence_url, and
    reason: why the answer can't be relied on, null if it can.

    results (request_id, source, symbol, action_type, requested_effective_at,
    matched_effective_at, fetched_at, exact_match, evidence_id, evidence_url). In
    order: the request lacks its time; the source is unknown, itself at fault, or
    not verified; there is no result, or more than one; a time is missing; the
    result is of another source, symbol, action or time; its match flag says
    otherwise than its times; it has no evidence at the source's own host. Of a
    request that has a reason nothing of the answer is handed on. Two joins by key;
    results are grouped by request before.
    """
    known = source_faults(sources).groupBy(F.col("name").alias("source")).agg(F.first("fault").alias("_fault"), F.first("integration_status").alias("_status"), F.first("reference_url").alias("_reference"))
    fields = ["source", "symbol", "action_type", "requested_effective_at", "matched_effective_at", "fetched_at", "exact_match", "evidence_id", "evidence_url"]
    answers = results.groupBy("request_id").agg(F.first(F.struct(*fields)).alias("r"), F.count("*").alias("_answers"))
    joined = requests.join(known.withColumn("_known", F.lit(True)), "source", "left").join(answers, "request_id", "left")
    r = lambda c: F.col(f"r.{c}")
    same = is_((r("source") == F.col("source")) & (r("symbol") == F.upper(F.trim("symbol"))) & (r("action_type") == F.col("action_type")) & (r("requested_effective_at") == F.col("effective_at")))
    reason = (
        F.when(F.col("effective_at").isNull(), "effective_at_missing").when(F.col("_known").isNull(), "source_not_found").when(F.col("_fault").isNotNull(), "source_at_fault")
        .when(~is_(F.col("_status") == "verified"), "source_not_verified").when(F.col("_answers").isNull(), "no_result").when(F.col("_answers") > 1, "ambiguous_result")
        .when(r("requested_effective_at").isNull() | r("matched_effective_at").isNull() | r("fetched_at").isNull(), "result_time_missing").when(~same, "mismatched_provenance")
        .when(~is_(r("exact_match") == (r("matched_effective_at") == F.col("effective_at"))), "inconsistent_match_flag")
        .when(~is_(F.trim(r("evidence_id")) != "") | ~authoritative(r("evidence_url")) | ~is_(host(r("evidence_url")) == host(F.col("_reference"))), "invalid_evidence")
    )
    told = joined.withColumn("reason", reason)
    given = [F.when(F.col("reason").isNull(), r(c)).alias(c) for c in ("matched_effective_at", "exact_match", "evidence_id", "evidence_url")]
    return told.select(*requests.columns, *given, "reason")


def registry_status(sources: DataFrame) -> DataFrame:
    """One row: how many sources are registered, sound and verified, and whether
    effective dates can be looked up at all; where not, evidence is by hand."""
    told = source_faults(sources)
    verified = F.count_if(F.col("fault").isNull() & (F.col("integration_status") == "verified"))
    return told.agg(F.count("*").alias("registered"), F.count_if(F.col("fault").isNull()).alias("sound"), verified.alias("verified"), (verified > 0).alias("automatic_lookup"))
