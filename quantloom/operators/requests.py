"""Requests as rows: JSON payloads checked against bounds, with defaults filled in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """What a field may be. kind: int, float, decimal (20 digits, 6 of them behind the
    point), text, date, time. Bounds are inclusive unless open; text has a pattern, or
    a range of lengths. A field without a default has to be there."""

    kind: str
    default: object = None
    least: float | None = None
    most: float | None = None
    open_least: bool = False
    open_most: bool = False
    pattern: str | None = None


#: Fixed bounds, defaults and patterns of requests.
SYMBOL, ANY_SYMBOL = Field("text", pattern=r"^[0-9A-Z]{1,16}$"), Field("text", pattern=r"^[0-9A-Z.-]{1,16}$")
STRATEGY = Field("text", "ma_cross", pattern=r"^(ma_cross|buy_and_hold|pattern_reference)$")
MODE = Field("text", "none", pattern=r"^(none|forward_point_in_time)$")
ENGINE = r"^(vectorized|event_driven)$"
RUN = {
    "limit": Field("int", 240, 30, 365), "fast_period": Field("int", 5, 2, 60), "slow_period": Field("int", 20, 3, 200), "initial_capital": Field("float", 10_000_000.0, 0, open_least=True),
    "commission_rate": Field("float", 0.00015, 0, 1, open_most=True), "tax_rate": Field("float", 0.0018, 0, 1, open_most=True), "slippage_rate": Field("float", 0.0005, 0, 1, open_most=True), "corporate_action_mode": MODE,
}
PARTICIPATION = Field("float", 0.1, 0, 1, open_least=True)
BACKTEST = {"symbol": SYMBOL, "strategy": STRATEGY, "engine": Field("text", "vectorized", pattern=ENGINE), **RUN, "max_volume_participation": Field("float", 1.0, 0, 1, open_least=True)}
REQUESTS: dict[str, dict[str, Field]] = {
    "candles": {"limit": Field("int", 30, 1, 365)},
    "backtest": BACKTEST,
    "validation": {**BACKTEST, "n_splits": Field("int", 3, 2, 6), "warmup_candles": Field("int", 60, 21, 120)},
    "comparison": {"symbol": ANY_SYMBOL, "strategy": STRATEGY, **RUN, "max_volume_participation": PARTICIPATION},
    "strategy_comparison": {"symbol": ANY_SYMBOL, "engine": Field("text", "event_driven", pattern=ENGINE), **RUN, "max_volume_participation": PARTICIPATION},
    "watchlist": {"symbol": ANY_SYMBOL},
    "price_alert": {"symbol": ANY_SYMBOL, "condition": Field("text", pattern=r"^(above|below)$"), "target_price": Field("decimal", least=0, open_least=True)},
    "approval": {
        "start": Field("date"), "end": Field("date"), "group_hint": Field("text", pattern=r"^candidate:[0-9a-f]{20}$"), "receipt_no": Field("text", pattern=r"^[0-9]{14}$"), "effective_at": Field("time"),
        "exchange_evidence_url": Field("text", pattern=r"^(?s:.{12,2048})$"), "confirmation": Field("text", pattern=r"^CONFIRM_CORPORATE_ACTION$"),
    },
}
KINDS = {"int": "bigint", "float": "double", "decimal": "decimal(20,6)", "text": "string", "date": "date", "time": "timestamp"}


def typed(field: Field, raw: Column, text: Column) -> Column:
    """The value of a field from its JSON (text) and, for strings, what they say
    (raw); null where it isn't of its kind."""
    is_text = F.startswith(text, F.lit('"'))
    # true and false are no numbers
    number = F.when(F.rlike(F.trim(raw), F.lit(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")), F.trim(raw))
    if field.kind == "int":
        whole = number.try_cast("double")
        return F.when(whole == F.floor(whole), number.try_cast("decimal(38,6)").try_cast("bigint"))
    if field.kind == "float":
        value = number.try_cast("double")
        return F.when(F.abs(value) < float("inf"), value)
    if field.kind == "decimal":
        exact = number.try_cast("decimal(38,18)")
        return F.when(exact == exact.try_cast("decimal(20,6)"), exact.try_cast("decimal(20,6)"))
    said = F.when(is_text, raw)
    return {"text": said, "date": F.when(F.rlike(said, F.lit(r"^\d{4}-\d{2}-\d{2}$")), said.try_cast("date")), "time": said.try_cast("timestamp")}[field.kind]


def within(field: Field, value: Column) -> Column:
    """Whether a value that is there is within the field's bounds."""
    sound = F.lit(True)
    if field.least is not None:
        sound = sound & (value > field.least if field.open_least else value >= field.least)
    if field.most is not None:
        sound = sound & (value < field.most if field.open_most else value <= field.most)
    if field.pattern is not None:
        sound = sound & F.rlike(value, F.lit(field.pattern))
    return F.coalesce(sound, F.lit(False))


def checked(requests: DataFrame, kind: str, payload: str = "payload") -> DataFrame:
    """requests with request, a struct of the fields of its kind with defaults, and
    errors: the fields that are missing, of another type or out of bounds, by name;
    `payload` where it is no JSON object. Fields that the kind doesn't have are
    ignored; request is null where there are errors."""
    fields = REQUESTS[kind]
    raw, variants = F.from_json(payload, "map<string,string>"), F.from_json(payload, "map<string,variant>")
    sound = F.startswith(F.to_json(F.try_parse_json(payload)), F.lit("{"))
    parsed = requests.select("*", F.when(sound, raw).alias("_raw"), F.when(sound, F.transform_values(variants, lambda _, v: F.to_json(v))).alias("_text"))
    values, wrong = [], [F.when(F.col("_raw").isNull(), F.lit("payload"))]
    for name, field in fields.items():
        there = F.coalesce(F.map_contains_key("_raw", F.lit(name)), F.lit(False))
        value = typed(field, F.try_element_at("_raw", F.lit(name)), F.try_element_at("_text", F.lit(name)))
        lacks = F.lit(field.default is None)
        bad = F.when(there, value.isNull() | ~within(field, value)).otherwise(lacks)
        wrong.append(F.when(F.col("_raw").isNotNull() & bad, F.lit(name)))
        values.append(F.when(there, value).otherwise(F.lit(field.default).cast(KINDS[field.kind])).alias(name))
    told = parsed.withColumn("errors", F.array_compact(F.array(*wrong)))
    return told.select(*requests.columns, F.when(F.size("errors") == 0, F.struct(*values)).alias("request"), "errors")
