"""Manual approval of corporate actions: each request is held against the candidates
as they are at that moment, and what passes is published once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators.actions import revision_groups
from quantloom.operators.verification import authoritative, host, is_
from quantloom.sources import sinks

#: Fixed words of approvals.
CONFIRMATION, SOURCE, RULE_VERSION, REVIEWER = "CONFIRM_CORPORATE_ACTION", "dart", "manual-review-2026.1", "admin-api"
EXCHANGE_HOSTS = ["data.krx.co.kr", "global.krx.co.kr", "kind.krx.co.kr"]
FILING_HOST = "dart.fss.or.kr"
EVIDENCE = ["group_hint", "receipt_no", "filing_evidence_url", "exchange_evidence_url", "reviewed_by"]
ACTIONS = "symbol string, action_type string, event_id string, revision int, effective_at timestamp, announced_at timestamp, known_at timestamp, price_factor decimal(24,12), volume_factor decimal(24,12), status string, source string, rule_version string, evidence_hash string, group_hint string, receipt_no string, filing_evidence_url string, exchange_evidence_url string, reviewed_by string"


def of_host(url: Column, hosts: list[str]) -> Column:
    return authoritative(url) & is_(host(url).isin(hosts))


def filing_of(url: Column, receipt: Column) -> Column:
    """Whether the address is of the filing: at its host, and asking for the receipt
    once and for no other."""
    asked = F.regexp_extract_all(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), F.lit(r"(?:^|&)rcpNo=([^&]*)"), F.lit(1))
    return of_host(url, [FILING_HOST]) & is_((F.size(asked) == 1) & (F.get(asked, F.lit(0)) == receipt))


def reviewed(requests: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """requests with error (null if one may be approved) and, where it is null, the
    action that follows.

    requests: request_id, source, symbol, group_hint, receipt_no, effective_at,
    exchange_evidence_url, confirmation. candidates: as `actions.candidates` gives
    them, with source and evidence_url, read when this runs; their revision groups
    are made anew. In order: the confirmation phrase, the source, the time, the
    exchange's address, whether group and receipt still are what was reviewed,
    whether the factors are whole, whether the filing's address is the receipt's.
    The action is known from `now`, and announced on the filing's day in Seoul.
    """
    groups = revision_groups(candidates).select("group_hint", "symbol", "source", F.explode("receipt_nos").alias("receipt_no"))
    shown = candidates.select("source", "symbol", "receipt_no", *[F.col(c).alias(f"_{c}") for c in ("action_type", "filed_on", "price_factor", "volume_factor", "evidence_url")], F.lit(True).alias("_there"))
    shown = shown.dropDuplicates(["source", "symbol", "receipt_no"])
    named = requests.withColumn("symbol", F.upper(F.trim("symbol")))
    keys = ["source", "symbol", "receipt_no"]
    joined = named.join(groups.withColumn("_grouped", F.lit(True)).dropDuplicates(["group_hint", *keys]), ["group_hint", *keys], "left").join(shown, keys, "left")
    error = (
        F.when(~is_(F.col("confirmation") == CONFIRMATION), "confirmation").when(~is_(F.col("source") == SOURCE), "source").when(F.col("effective_at").isNull(), "effective_at")
        .when(~of_host(F.col("exchange_evidence_url"), EXCHANGE_HOSTS), "exchange_evidence").when(F.col("_grouped").isNull(), "group_changed").when(F.col("_there").isNull(), "receipt_changed")
        .when(F.col("_price_factor").isNull() | F.col("_volume_factor").isNull(), "factors_incomplete").when(~filing_of(F.col("_evidence_url"), F.col("receipt_no")), "filing_evidence")
    )
    filed, zero = F.col("_filed_on"), F.lit(0)
    midnight = F.make_timestamp_ltz(F.year(filed), F.month(filed), F.day(filed), zero, zero, zero, F.lit("Asia/Seoul"))
    event = F.concat(F.lit("reviewed:"), F.regexp_replace("group_hint", "^candidate:", ""))
    return joined.withColumn("error", error).select(
        *requests.columns, "error", F.col("_action_type").alias("action_type"), event.alias("event_id"), midnight.alias("announced_at"), now.alias("known_at"), F.col("_price_factor").alias("price_factor"), F.col("_volume_factor").alias("volume_factor"),
        F.lit("confirmed").alias("status"), F.lit(RULE_VERSION).alias("rule_version"), F.col("_evidence_url").alias("filing_evidence_url"), F.lit(REVIEWER).alias("reviewed_by"))


def hashed(found: DataFrame) -> DataFrame:
    """found with evidence_hash: 256 bits of the evidence and what it stands for,
    the same whenever the same is approved again."""
    what = [*EVIDENCE, "symbol", "action_type", "event_id", "effective_at", "price_factor", "volume_factor"]
    return found.withColumn("evidence_hash", F.sha2(F.to_json(F.struct(*sorted(what))), 256))


def fresh(found: DataFrame, stored: DataFrame) -> DataFrame:
    """The actions to add: of each evidence hash that isn't stored one, with the next
    revisions of its event."""
    new = found.where("error is null").withColumn("source", F.concat("source", F.lit("-reviewed"))).dropDuplicates(["evidence_hash"]).join(stored.select("evidence_hash"), "evidence_hash", "left_anti")
    last = stored.groupBy("symbol", "event_id").agg(F.max("revision").alias("_last"))
    turn = F.row_number().over(W.partitionBy("symbol", "event_id").orderBy("request_id"))
    numbered = new.join(last, ["symbol", "event_id"], "left").withColumn("revision", (F.coalesce("_last", F.lit(0)) + turn).cast("int"))
    return numbered.select(*stored.columns)


def outcomes(found: DataFrame, stored: DataFrame) -> DataFrame:
    """request_id, error, evidence_hash, created: created is true for the one request
    of each hash that adds an action, false for those that find it there."""
    there = stored.select("evidence_hash").distinct().withColumn("_there", F.lit(True))
    turn = F.row_number().over(W.partitionBy("evidence_hash").orderBy("request_id"))
    told = found.join(there, "evidence_hash", "left").withColumn("_turn", turn)
    ok = F.col("error").isNull()
    return told.select("request_id", "error", F.when(ok, F.col("evidence_hash")).alias("evidence_hash"), (ok & F.col("_there").isNull() & (F.col("_turn") == 1)).alias("created"))


def approve(spark: SparkSession, root: str, requests: DataFrame, candidates: Callable[[], DataFrame], now: Column | None = None, tries: int = 10) -> DataFrame:
    """Approves requests in one publication under root; request_id, error,
    evidence_hash and created come out (a table under root, so that it says what was
    done and not what would be).

    The candidates are read anew, and held against the requests anew, for each try:
    a try that another writer was ahead of is dropped whole and run again on what is
    stored by then. What is approved already, by its evidence hash, isn't added
    again, so a call that is repeated changes nothing. A request stands once.
    """
    told: list[str] = []
    clock = F.current_timestamp() if now is None else now

    def change(read):
        stored = read("actions", ACTIONS)
        # one job settles the clock, the candidates and the outcome of this try
        path = f"{root}/_reviews/{len(told)}-{spark.sparkContext.applicationId}-{sinks.token()}"
        hashed(reviewed(requests, candidates(), clock)).write.parquet(path)
        told.append(path)
        found = spark.read.parquet(path)
        outcomes(found, stored).write.parquet(f"{path}/_outcomes")
        return {"actions": stored.unionByName(fresh(found, stored))}

    sinks.updated(spark, root, change, tries)
    return spark.read.parquet(f"{told[-1]}/_outcomes")
