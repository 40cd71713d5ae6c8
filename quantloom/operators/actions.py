"""Corporate actions with two points in time: as-of selection, adjustment,
candidate factors, revision groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime
from decimal import ROUND_HALF_UP, Context, Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Narrow enough that a product or quotient of the two keeps 16 places or more.
WIDE, FACTOR = "decimal(24,14)", "decimal(18,12)"


def visible(actions: DataFrame, as_of: Column | datetime) -> DataFrame:
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    return actions.where((F.col("known_at") <= as_of) & (F.col("effective_at") <= as_of))


def as_of(actions: DataFrame, when: Column | datetime) -> DataFrame:
    """The latest visible revision of each event, if that one is confirmed."""
    latest = W.partitionBy("symbol", "source", "event_id").orderBy(F.desc("known_at"), F.desc("revision"))
    return visible(actions, when).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n").where("status = 'confirmed'")


def adjusted(bars: DataFrame, chosen: DataFrame, backward: bool) -> DataFrame:
    """Prices and volumes times the factors of the actions after each bar
    (backward), or over those up to it (forward), in decimals. Bars and actions
    of a symbol lie in one sorted stream and a fold carries the two products, so
    Spark's sort spills and Python holds one batch however many actions there are."""
    types = dict(bars.dtypes)
    cells = ["open", "high", "low", "close", "volume"]
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    places = bars.select("symbol", "ts", *cells, *[none(c, "string") for c in ("source", "event_id")], *[none(c, FACTOR) for c in ("price_factor", "volume_factor")], F.lit(False).alias("is_action"))
    acts = chosen.where("symbol is not null").select("symbol", F.col("effective_at").cast(types["ts"]).alias("ts"), *[none(c, types[c]) for c in cells], "source", F.col("event_id").cast("string").alias("event_id"), *[F.col(c).cast(FACTOR).alias(c) for c in ("price_factor", "volume_factor")], F.lit(True).alias("is_action"))
    # an action at the time of a bar counts forward and doesn't backward
    turn = [F.col("ts").desc_nulls_first(), "is_action"] if backward else [F.col("ts").asc_nulls_first(), F.desc("is_action")]
    line = places.unionByName(acts).repartition("symbol").sortWithinPartitions("symbol", *turn, "source", "event_id", "price_factor", "volume_factor")
    step_places, end_places = Decimal(1).scaleb(-21 if backward else -16), Decimal(1).scaleb(-14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = Context(prec=76, rounding=ROUND_HALF_UP)
        apply = exact.multiply if backward else exact.divide
        one = exact.quantize(Decimal(1), end_places)
        last, price, volume, applied = None, one, one, 0

        def step(now: Decimal | None, factor: Decimal | None) -> Decimal | None:
            return None if now is None or factor is None else exact.quantize(exact.quantize(apply(now, factor), step_places), end_places)

        for batch in batches:
            found = []
            for symbol, is_action, pf, vf in zip(*(batch.column(c).to_pylist() for c in ("symbol", "is_action", "price_factor", "volume_factor"))):
                if symbol != last:
                    last, price, volume, applied = symbol, one, one, 0
                if is_action:
                    price, volume, applied = step(price, pf), step(volume, vf), applied + 1
                else:
                    found.append((price, volume, applied))
            kept = batch.filter(pc.invert(batch.column("is_action"))).select(["symbol", "ts", *cells])
            products = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.decimal128(24, 14), pa.decimal128(24, 14), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *products], ["symbol", "ts", *cells, "pf", "vf", "applied"])

    df = line.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in ("symbol", "ts", *cells)) + f", pf {WIDE}, vf {WIDE}, applied int")
    price = lambda c: (F.col(c).cast("decimal(20,6)") * F.col("pf")).cast("decimal(38,12)").alias(c)
    return df.select("symbol", "ts", *[price(c) for c in cells[:4]], F.round(F.col("volume").cast("decimal(20,0)") * F.col("vf"), 0).cast("bigint").alias("volume"), "applied", F.lit("point_in_time_adjusted").alias("price_basis"))


def require_unadjusted(bars: DataFrame) -> DataFrame:
    """Fails the job at a bar of another price basis."""
    return bars.where(F.assert_true(F.col("price_basis") == "unadjusted", "adjustment needs unadjusted bars").isNull()) if "price_basis" in bars.columns else bars


def adjust_backward(bars: DataFrame, actions: DataFrame, when: datetime) -> DataFrame:
    return adjusted(require_unadjusted(bars), as_of(actions, when), True)


def revised_or_late(actions: DataFrame, when: datetime) -> DataFrame:
    """Events that forward adjustment rejects: more than one visible revision, or known too late."""
    return visible(actions, when).groupBy("symbol", "source", "event_id").agg(F.count("*").alias("revisions"), F.max((F.col("known_at") > F.col("effective_at")).cast("int")).alias("late")).where("revisions > 1 or late = 1")


def adjust_forward(bars: DataFrame, actions: DataFrame, when: datetime, strict: bool = True) -> DataFrame:
    """Look-ahead-safe adjustment. strict: the job fails if an event has been
    revised or was known late; else such events are left out."""
    own = visible(actions, when)
    key = ["symbol", "source", "event_id"]
    bad = revised_or_late(actions, when).select(*key, F.lit(1).alias("bad"))
    marked = own.join(bad, key, "left")
    if strict:
        marked = marked.where(F.assert_true(F.col("bad").isNull(), "revised or late-known action").isNull())
    return adjusted(require_unadjusted(bars), marked.where("bad is null and status = 'confirmed'").drop("bad"), False)


def affecting(actions: DataFrame, bars: DataFrame, when: datetime) -> DataFrame:
    """Visible confirmed actions that lie after some bar of their symbol."""
    first = bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"))
    chosen = as_of(actions, when)
    return chosen.join(first, (chosen.symbol == first.symbol) & (first.first_ts < chosen.effective_at), "left_semi")


def bonus_factors(ratio: Column) -> tuple[Column, Column]:
    """Price and volume factors of a bonus issue; null for a bad ratio."""
    more = (F.lit(1).cast("decimal(20,10)") + ratio).cast("decimal(20,10)")
    good = ratio > 0
    return F.when(good, (F.lit(1).cast(WIDE) / more).cast("decimal(24,12)")), F.when(good, more.cast("decimal(24,12)"))


def reduction_factors(before: Column, after: Column) -> tuple[Column, Column]:
    good = (before > 0) & (after > 0) & (after < before)
    ratio = lambda a, b: F.when(good, F.try_divide(a.cast("decimal(28,10)"), b.cast("decimal(28,10)")).cast("decimal(24,12)"))
    return ratio(before, after), ratio(after, before)


#: Fixed marks in titles and remarks of filings: corrected, corrected later, withdrawn.
CORRECTED, LATER, WITHDRAWN = "정정", "정", "철"


def candidates(rows: DataFrame, filings: DataFrame, limit: int | None = None, by: Sequence[str] = ("receipt_no",)) -> DataFrame:
    """Candidate actions from decision rows (symbol, kind, receipt_no, ratio,
    before, after, decision_date, record_date) and filings (receipt_no,
    report_name, remarks), newest first, with factors, hints and warnings.

    kind is bonus_issue or capital_reduction. A receipt number is 14 digits that
    start with the day; any other fails the job. limit: more candidates of a
    symbol than that fail it too, since a cut list would hide some. by: the columns
    of both that name a filing, where receipt numbers come more than once; they come
    out, and settle the order of one symbol's equal numbers, the largest first.
    """
    more = [c for c in by if c != "receipt_no"]
    meta = filings.groupBy(*by).agg(F.first("report_name").alias("report_name"), F.first("remarks").alias("remarks"))
    df = rows.join(meta, list(by), "left")
    sound = F.rlike("receipt_no", F.lit(r"^\d{14}$")) & F.try_to_timestamp(F.substring("receipt_no", 1, 8), F.lit("yyyyMMdd")).isNotNull()
    filed = F.when(sound, F.to_date(F.substring("receipt_no", 1, 8), "yyyyMMdd")).otherwise(F.raise_error(F.lit("invalid receipt number")).cast("date"))
    bonus = F.col("kind") == "bonus_issue"
    (bp, bv), (rp, rv) = bonus_factors(F.col("ratio")), reduction_factors(F.col("before"), F.col("after"))
    price, volume = F.when(bonus, bp).otherwise(rp), F.when(bonus, bv).otherwise(rv)
    says = lambda c, mark: F.coalesce(F.contains(F.col(c), F.lit(mark)), F.lit(False))
    warn = lambda when, name: F.when(when, F.lit(name))
    warnings = F.array_compact(F.array(
        F.lit("revision_reconciliation_required"), F.lit("exchange_effective_date_required"), warn(says("report_name", CORRECTED), "correction_title_requires_reconciliation"), warn(says("remarks", LATER), "later_correction_reported"),
        warn(says("remarks", WITHDRAWN), "withdrawal_report_reference_required"), warn(bonus & price.isNull(), "invalid_common_share_allocation_ratio"), warn(~bonus & price.isNull(), "invalid_outstanding_share_reduction"),
        warn(~bonus, "proportional_consolidation_evidence_required")))
    out = df.select(
        "symbol", "receipt_no", *more, F.when(bonus, "stock_dividend").otherwise("reverse_split").alias("action_type"), filed.alias("filed_on"), "decision_date", "record_date", price.alias("price_factor"), volume.alias("volume_factor"),
        "report_name", "remarks", says("report_name", CORRECTED).alias("correction_hint"), says("remarks", LATER).alias("superseded_hint"), warnings.alias("warnings"))
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("filed_on"), F.desc("receipt_no"), *[F.desc(c) for c in more]))
    out = out.withColumn("place", place)
    if limit is not None:
        out = out.withColumn("place", F.when(F.col("place") <= limit, F.col("place")).otherwise(F.raise_error(F.lit("more candidates than the limit")).cast("int")))
    return out


def reviewed_actions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions, rejected rows with a reason) of reviewed rows (symbol, source,
    event_id, revision, effective_at, known_at, price_factor, volume_factor,
    status): identity, revision and factors must be sound."""
    known = F.col("status").isin("announced", "confirmed", "cancelled")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reason = F.when(blank("symbol") | blank("event_id") | blank("source"), "identity").when(F.coalesce(F.col("revision"), F.lit(0)) < 1, "revision").when(~F.coalesce(known, F.lit(False)), "status")
    reason = reason.when(F.col("effective_at").isNull() | F.col("known_at").isNull(), "times").when(F.coalesce(F.least("price_factor", "volume_factor"), F.lit(0)) <= 0, "factors").when(F.col("price_factor").isNull() | F.col("volume_factor").isNull(), "factors")
    told = rows.withColumn("reason", reason)
    return told.where("reason is null").drop("reason").withColumn("symbol", F.upper("symbol")), told.where("reason is not null")


#: Fixed names of the source and rule of actions that are mapped from filings.
FILING_SOURCE, MAPPING_VERSION = "dart", "dart-corporate-action-2026.1"


def positive(text: Column) -> Column:
    """A number above 0 from text with commas, null if it is none."""
    value = F.regexp_replace(F.trim(text), ",", "").try_cast("decimal(28,10)")
    return F.when(value > 0, value)


def seoul_day(text: Column) -> Column:
    """The beginning of a day in Seoul, from yyyymmdd with or without dashes or dots."""
    bare = F.regexp_replace(F.trim(text), "[-.]", "")
    day = F.when(F.rlike(bare, F.lit(r"^\d{8}$")), F.try_to_timestamp(bare, F.lit("yyyyMMdd")).cast("date"))
    zero = F.lit(0)
    return F.make_timestamp_ltz(F.year(day), F.month(day), F.day(day), zero, zero, zero, F.lit("Asia/Seoul"))


def mapped_actions(rows: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(actions, rejected rows with a reason) of reviewed filing rows (kind, symbol,
    event_id, revision, known_at, effective_at, status, ratio, before, after,
    decided, proportional), whose numbers and days are texts as filed.

    A bonus_issue needs a ratio above 0; a capital_reduction needs evidence that all
    shares are consolidated in proportion, and fewer shares after than before. The
    day of the decision, a day in Seoul, may be blank but not broken. strict: the job
    that reads the actions fails at the first row that is rejected.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    bonus, cut = F.col("kind") == "bonus_issue", F.col("kind") == "capital_reduction"
    ratio, before, after = (positive(F.col(c)) for c in ("ratio", "before", "after"))
    reason = (
        F.when(~F.coalesce(bonus | cut, F.lit(False)), "kind").when(cut & ~F.coalesce("proportional", F.lit(False)), "proportional_consolidation").when(bonus & ratio.isNull(), "ratio")
        .when(cut & (before.isNull() | after.isNull()), "outstanding_shares").when(cut & (after >= before), "no_reduction").when(~blank("decided") & seoul_day(F.col("decided")).isNull(), "decision_date")
        .when(F.col("known_at").isNull() | F.col("effective_at").isNull(), "times").when(blank("symbol") | blank("event_id") | (F.coalesce(F.col("revision"), F.lit(0)) < 1), "identity")
        .when(~F.coalesce(F.col("status").isin("announced", "confirmed", "cancelled"), F.lit(False)), "status")
    )
    told = rows.withColumn("reason", reason)
    (bonus_price, bonus_volume), (cut_price, cut_volume) = bonus_factors(ratio.cast("decimal(20,10)")), reduction_factors(before, after)
    sound = told.where(F.assert_true(F.col("reason").isNull(), F.concat(F.lit("rejected action: "), F.col("reason"))).isNull()) if strict else told.where("reason is null")
    actions = sound.select(
        F.upper(F.trim("symbol")).alias("symbol"), F.when(bonus, "stock_dividend").otherwise("reverse_split").alias("action_type"), "event_id", "revision", "effective_at", seoul_day(F.col("decided")).alias("announced_at"), "known_at",
        F.when(bonus, bonus_price).otherwise(cut_price).alias("price_factor"), F.when(bonus, bonus_volume).otherwise(cut_volume).alias("volume_factor"), "status", F.lit(FILING_SOURCE).alias("source"), F.lit(MAPPING_VERSION).alias("rule_version"))
    return actions, told.where("reason is not null")


#: A fixed pattern of leading correction marks.
CORRECTION_MARKS = r"^\s*(?:\[[^\]]*정정[^\]]*\]\s*)+"


def normalized_title(title: Column) -> Column:
    """Without leading bracketed correction marks and white space, lower case."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), CORRECTION_MARKS, "")
    return F.lower(F.regexp_replace(bare, r"\s+", ""))


def revision_groups(candidates: DataFrame) -> DataFrame:
    """Receipts that look like revisions of one filing, in order of filing."""
    title = normalized_title(F.col("report_name"))
    anchor = F.coalesce("decision_date", "record_date")
    named = candidates.withColumns({"anchor_date": anchor, "discriminator": F.when(title != "", title).otherwise(F.col("receipt_no"))})
    keys = ["source", "symbol", "action_type", "discriminator", "anchor_date"]
    grouped = named.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("filed_on", "receipt_no"))).alias("filed"), F.max("superseded_hint").alias("superseded"), F.max("correction_hint").alias("corrected"))
    digest = F.sha2(F.concat_ws("|", *keys[:4], F.coalesce(F.col("anchor_date").cast("string"), F.lit("None"))), 256)
    n = F.size("filed")
    reasons = F.when(n == 1, F.array(F.lit("no_matching_receipt"))).otherwise(F.array_compact(F.array(F.lit("same_normalized_report_and_anchor"), F.when(F.col("superseded"), F.lit("original_reports_later_correction")), F.when(F.col("corrected"), F.lit("correction_title_detected")))))
    confidence = F.when(n == 1, "isolated").when(F.size("reasons") == 3, "likely_correction").otherwise("ambiguous_multiple_receipts")
    out = grouped.withColumn("reasons", reasons)
    return out.select(F.concat(F.lit("candidate:"), F.substring(digest, 1, 20)).alias("group_hint"), *keys[:3], "anchor_date", F.transform("filed", lambda x: x.receipt_no).alias("receipt_nos"), F.sequence(F.lit(1), n).alias("suggested_revisions"), confidence.alias("confidence"), "reasons")


def basis_metadata(bars: DataFrame, actions: DataFrame, mode: str, when: datetime) -> DataFrame:
    """symbol, mode, enabled, input_price_bases, output_price_basis,
    applied_actions: what a backtest on these bars rests on. Which actions apply
    are rows of `affecting`; here they are counted."""
    if mode not in ("none", "forward_point_in_time"):
        raise ValueError("mode must be none or forward_point_in_time")
    bases = bars.groupBy("symbol").agg(F.array_sort(F.collect_set("price_basis")).alias("input_price_bases"))
    on = mode != "none"
    if not on:
        return bases.select("symbol", F.lit(mode).alias("mode"), F.lit(False).alias("enabled"), "input_price_bases", F.lit(None).cast("string").alias("output_price_basis"), F.lit(0).cast("long").alias("applied_actions"))
    counted = affecting(actions, bars, when).groupBy("symbol").agg(F.count("*").alias("applied_actions"))
    return bases.join(counted, "symbol", "left").select("symbol", F.lit(mode).alias("mode"), F.lit(True).alias("enabled"), "input_price_bases", F.lit("point_in_time_adjusted").alias("output_price_basis"), F.coalesce("applied_actions", F.lit(0)).alias("applied_actions"))
