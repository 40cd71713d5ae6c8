"""Column helpers for numbers, dates and text that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def mean_of(*parts: Column) -> Column:
    """The mean of those that aren't null."""
    have = F.array_compact(F.array(*parts))
    return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have))


def amount(text: Column) -> Column:
    """A statement amount: commas dropped, '-' or blank null, (x) negative."""
    bare = F.regexp_replace(F.trim(text), ",", "")
    inner = F.regexp_extract(bare, r"^\((.*)\)$", 1)
    return F.when(bare.isin("", "-"), None).when(inner != "", -inner.try_cast("decimal(30,2)")).otherwise(bare.try_cast("decimal(30,2)"))


def signed(value: Column, code: Column) -> Column:
    """A decimal whose sign is given by a code: 4 and 5 are down."""
    number = F.trim(value).try_cast("decimal(24,6)")
    return F.when(code.isin("4", "5"), -F.abs(number)).otherwise(number)


def local_time(day: Column, time: Column, zone: str) -> Column:
    """yyyyMMdd and HHmmss of a zone as UTC, null where they don't parse."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat(day, F.substring(time, 1, 6)), F.lit("yyyyMMddHHmmss")), zone)


def mask(account: Column) -> Column:
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(account) - 4)), F.right(account, F.lit(4)))


def number_of(value: Column) -> Column:
    """A JSON number (as VARIANT) as a double; null for what is none, true, false and
    texts that look like numbers among them."""
    return F.when(F.rlike(F.to_json(value), F.lit(r"^-?\d")), F.try_variant_get(value, "$", "double"))
