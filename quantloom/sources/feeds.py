"""Feed payloads parsed into rows: JSON quotes and holdings, RSS, tick frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.numeric import amount, local_time, signed

#: Fixed layout of tick frames: name: (fields a record, zone, positions).
DOMESTIC, OVERSEAS = "H0STCNT0", "HDFSCNT0"
LAYOUTS = {
    DOMESTIC: (46, "Asia/Seoul", {"price": 2, "sign": 3, "change": 4, "percent": 5, "volume": 13, "day": 33, "time": 1}),
    OVERSEAS: (25, "America/New_York", {"price": 10, "sign": 11, "change": 12, "percent": 13, "volume": 19, "day": 3, "time": 4}),
}

LONGEST_SYMBOL = 16
MOST_LISTED = 500  # subscriptions that a plan carries along; a feed takes 40


def frames(raw: DataFrame, frame: str = "frame") -> DataFrame:
    """raw with feed, count, fields and error: null where the frame is sound.

    What a frame is split into comes out of a generator, below which no condition is
    pushed: a frame is made and split once, however many columns and conditions use
    its parts.
    """
    whole = F.split(F.col(frame), r"\|", 4)
    parts = raw.select("*", F.inline(F.array(F.struct(whole.alias("_parts")))))
    cell = lambda i: F.get("_parts", F.lit(i))
    width = F.when(cell(1) == DOMESTIC, LAYOUTS[DOMESTIC][0]).when(cell(1) == OVERSEAS, LAYOUTS[OVERSEAS][0])
    df = parts.select("*", F.inline(F.array(F.struct(cell(1).alias("feed"), cell(2).try_cast("int").alias("count"), F.split(cell(3), r"\^").alias("fields"), width.alias("width")))))
    ignored = (F.size("_parts") < 4) | ~cell(0).isin("0", "1") | F.col("width").isNull()
    error = F.when(ignored, "ignored").when(F.col("count").isNull(), "record count").when((F.col("count") < 1) | (F.size("fields") < F.col("count") * F.col("width")), "too few fields")
    return df.withColumn("error", error).drop("_parts")


def ticks(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row a record of the sound frames: key, price, change, percent, volume, as_of."""
    sound = parsed.where("error is null").withColumn("record", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    own = F.slice("fields", F.col("record") * F.col("width") + 1, F.col("width"))
    df = sound.select("*", F.inline(F.array(F.struct(own.alias("v")))))

    def at(name: str) -> Column:
        return F.when(F.col("feed") == DOMESTIC, F.get(F.col("v"), F.lit(LAYOUTS[DOMESTIC][2][name]))).otherwise(F.get(F.col("v"), F.lit(LAYOUTS[OVERSEAS][2][name])))

    as_of = F.when(F.col("feed") == DOMESTIC, local_time(at("day"), at("time"), LAYOUTS[DOMESTIC][1])).otherwise(local_time(at("day"), at("time"), LAYOUTS[OVERSEAS][1]))
    return df.select(*keep, "feed", "record", F.get("v", F.lit(0)).alias("key"), F.trim(at("price")).try_cast("decimal(24,6)").alias("price"), signed(at("change"), at("sign")).alias("change"), signed(at("percent"), at("sign")).alias("percent"), F.trim(at("volume")).try_cast("decimal(24,6)").cast("bigint").alias("volume"), as_of.alias("as_of"))


def subscribed(rows: DataFrame, subscriptions: DataFrame, most_listed: int = MOST_LISTED) -> DataFrame:
    """rows with the subscription's symbol: by equal key, else the first of the
    feed, by ordinal, whose symbol ends the key.

    The subscriptions are read once. Up to most_listed different ones, many times
    what a feed takes, are looked up in maps within the plan, without a join; beyond
    that a key is joined once by itself and once by its ending of each length that a
    symbol has, at most LONGEST_SYMBOL. No row is multiplied either way.
    """
    by_key = subscriptions.groupBy("feed", "key").agg(F.min_by("symbol", "ordinal").alias("symbol"))
    by_end = subscriptions.where(F.length("symbol").between(1, LONGEST_SYMBOL)).groupBy("feed", "symbol").agg(F.min("ordinal").alias("ordinal"))
    both = by_key.select("feed", "key", "symbol", F.lit(None).cast("long").alias("ordinal")).unionByName(by_end.select("feed", F.lit(None).cast("string").alias("key"), "symbol", F.col("ordinal").cast("long").alias("ordinal")))
    listed = both.limit(2 * most_listed + 1).collect()
    if len(listed) <= 2 * most_listed:
        return listed_symbols(rows, listed)
    exact = by_key.withColumnRenamed("symbol", "_exact")
    out = rows.join(exact, ["feed", "key"], "left")
    found = []
    for n in range(1, LONGEST_SYMBOL + 1):
        end, turn = f"_end{n}", f"_turn{n}"
        own = by_end.where(F.length("symbol") == n).select("feed", F.col("symbol").alias(end), F.col("ordinal").alias(turn))
        out = out.withColumn(end, F.when(F.col("_exact").isNull(), F.right(F.col("key"), F.lit(n)))).join(own, ["feed", end], "left")
        found.append(F.when(F.col(turn).isNotNull(), F.struct(F.col(turn).alias("turn"), F.col(end).alias("symbol"))))
    return out.select(*rows.columns, F.coalesce("_exact", F.array_min(F.array_compact(F.array(*found))).getField("symbol")).alias("symbol"))


def listed_symbols(rows: DataFrame, listed: list) -> DataFrame:
    """rows with the symbol of a short list of (feed, key, symbol, ordinal): exact ones
    with a key, ordered ones without."""
    by_feed: dict[str, tuple[dict, list]] = {}
    for r in listed:
        exact, ends = by_feed.setdefault(r["feed"], ({}, []))
        if r["key"] is None:
            ends.append((r["ordinal"], r["symbol"]))
        else:
            exact[r["key"]] = r["symbol"]
    symbol = F.lit(None).cast("string")
    for feed, (exact, ends) in sorted(by_feed.items(), key=lambda x: x[0] or ""):
        whole = F.element_at(F.create_map(*[F.lit(x) for pair in exact.items() for x in pair]), F.col("key")) if exact else F.lit(None).cast("string")
        order = F.array(*[F.lit(s) for _, s in sorted(ends)]) if ends else F.array().cast("array<string>")
        ending = F.get(F.filter(order, lambda s: F.endswith(F.col("key"), s)), F.lit(0))
        symbol = F.when(F.col("feed") == feed, F.coalesce(whole, ending)).otherwise(symbol)
    return rows.select(*rows.columns, symbol.alias("symbol"))


QUOTE = "struct<symbol:string,lastPrice:string,change:string,volume:string,timestamp:string>"
HOLDING = "array<struct<symbol:string,currency:string,quantity:string,marketValue:struct<amount:string,profit:string>>>"


def quotes(raw: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Typed quotes of JSON payloads; error tells what does not parse."""
    q = F.from_json(payload, QUOTE)
    df = raw.select(*keep, q.symbol.alias("symbol"), q.lastPrice.try_cast("decimal(20,6)").alias("price"), q.change.try_cast("decimal(20,6)").alias("change"), q.volume.try_cast("decimal(24,6)").alias("volume"), q.timestamp.alias("at"))
    error = F.when(F.col("symbol").isNull(), "symbol").when(F.col("price").isNull(), "price").when(F.col("volume") != F.floor("volume"), "fractional volume")
    return df.withColumns({"error": error, "volume": F.col("volume").cast("bigint")})


TRADES = "array<struct<price:string,volume:string,timestamp:string>>"
INFO = "array<struct<symbol:string,name:string,market:string,listDate:string,currency:string>>"
WARNINGS = "array<struct<warningType:string,exchange:string,startDate:string,endDate:string>>"


def trades(raw: DataFrame, payload: str, keep: list[str], limit: int = 50) -> DataFrame:
    """One row a trade of JSON lists, in order; error tells what doesn't parse."""
    rows = raw.select(*keep, F.posexplode(F.slice(F.from_json(payload, TRADES), 1, limit)).alias("seq", "t"))
    price, quantity, at = F.col("t.price").try_cast("decimal(20,6)"), F.col("t.volume").try_cast("decimal(24,6)"), F.try_to_timestamp("t.timestamp")
    error = F.when(price.isNull(), "price").when(quantity.isNull(), "volume").when(at.isNull(), "timestamp")
    return rows.select(*keep, "seq", price.alias("price"), quantity.alias("quantity"), F.lit(None).cast("string").alias("side"), at.alias("executed_at"), error.alias("error"))


def stock_info(raw: DataFrame, payload: str, symbol: str, keep: list[str]) -> DataFrame:
    """The entry of the symbol asked for, with KRW where no currency is given;
    error where the list lacks it."""
    hit = F.get(F.filter(F.from_json(payload, INFO), lambda r: r.symbol == F.col(symbol)), F.lit(0))
    rows = raw.select(*keep, symbol, hit.alias("r"))
    error = F.when(F.col("r").isNull(), "not found").when(F.col("r.name").isNull() | F.col("r.market").isNull(), "name or market")
    return rows.select(*keep, symbol, "r.name", "r.market", F.to_date(F.try_to_timestamp("r.listDate", F.lit("yyyy-MM-dd"))).alias("listed_on"), F.when(error.isNull(), F.coalesce(F.nullif(F.col("r.currency"), F.lit("")), F.lit("KRW"))).alias("currency"), error.alias("error"))


def stock_warnings(raw: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """One row a warning; those without a type are left out."""
    rows = raw.select(*keep, F.explode(F.from_json(payload, WARNINGS)).alias("w")).where(F.col("w.warningType").isNotNull())
    day = lambda c: F.to_date(F.try_to_timestamp(F.col(f"w.{c}"), F.lit("yyyy-MM-dd")))
    return rows.select(*keep, F.col("w.warningType").alias("warning_type"), F.nullif(F.col("w.exchange"), F.lit("")).alias("exchange"), day("startDate").alias("start_date"), day("endDate").alias("end_date"))


def currency_totals(rows: DataFrame, keys: list[str], amount_: str) -> DataFrame:
    """keys and totals: a map from currency to the sum; null where any is."""
    sums = rows.groupBy(*keys, "currency").agg(F.when(F.count_if(F.col(amount_).isNull()) == 0, F.sum(amount_)).alias("total"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("currency", "total")))).alias("totals"))


def holdings(raw: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """One row a holding of nested JSON payloads."""
    one = F.explode(F.from_json(payload, HOLDING)).alias("h")
    return raw.select(*keep, one).select(*keep, "h.symbol", "h.currency", F.col("h.quantity").try_cast("decimal(24,6)").alias("quantity"), F.col("h.marketValue.amount").try_cast("decimal(24,6)").alias("market_value"), F.col("h.marketValue.profit").try_cast("decimal(24,6)").alias("profit"))


RSS = "struct<channel:struct<item:array<struct<title:string,link:string,pubDate:string,source:string,description:string>>>>"


def rss_items(raw: DataFrame, xml: str, keep: list[str], limit: int = 20) -> DataFrame:
    """The first `limit` items of RSS documents, of those that have a title and a
    link, with publisher, summary and time in UTC. Each item is read by itself,
    so what one lacks is not taken from another. published_at is null where the
    date is missing or doesn't parse."""
    read = F.from_xml(F.col(xml), RSS, {"rowTag": "rss", "ignoreAttributes": "false", "attributePrefix": "_at_", "nullValue": "\0"})
    rows = raw.select(*keep, F.posexplode(F.slice(F.coalesce(read.getField("channel").getField("item"), F.array().cast("array<struct<title:string,link:string,pubDate:string,source:string,description:string>>")), 1, limit)).alias("seq", "i")).select(*keep, "seq", "i.*")
    when = F.try_to_timestamp(F.regexp_replace(F.trim("pubDate"), r"^[A-Za-z]+, *", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    text = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    return rows.select(*keep, "seq", text("title").alias("title"), text("link").alias("url"), when.alias("published_at"), F.coalesce(text("source"), F.lit("RSS")).alias("publisher"), text("description").alias("summary")).where("title is not null and url is not null")


FILING = "struct<status:string,message:string,list:array<struct<rcept_no:string,rcept_dt:string,corp_code:string,corp_name:string,report_nm:string,flr_nm:string,rm:string>>>"
STATEMENT = "struct<status:string,message:string,list:array<struct<account_id:string,account_nm:string,thstrm_amount:string,currency:string>>>"
#: Fixed codes of the filing service: rows follow; there are none.
SOUND, NOTHING = "000", "013"


def disclosures(raw: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """One row a filing of JSON lists; a payload without rows gives none, one
    that is unsound a row with an error."""
    read = raw.select(*keep, F.from_json(payload, FILING).alias("p")).where(F.coalesce(F.col("p.status"), F.lit("")) != NOTHING)
    status = F.coalesce(F.col("p.status"), F.lit("invalid response"))
    error = F.when(status != SOUND, status).when(F.col("p.list").isNull(), "omitted rows")
    rows = read.select(*keep, error.alias("failed"), F.explode_outer(F.when(error.isNull(), F.col("p.list"))).alias("r")).where("failed is not null or r is not null")
    filed = F.try_to_timestamp("r.rcept_dt", F.lit("yyyyMMdd"))
    error = F.coalesce("failed", F.when(filed.isNull(), "disclosure date"))
    text = lambda c: F.when(F.col("failed").isNull(), F.coalesce(F.col(f"r.{c}"), F.lit("")))
    return rows.select(*keep, text("rcept_no").alias("receipt_no"), text("corp_code").alias("corp_code"), text("corp_name").alias("company_name"), text("report_nm").alias("report_name"), filed.alias("filed_at"), text("flr_nm").alias("filer_name"), F.nullif(F.col("r.rm"), F.lit("")).alias("remarks"), error.alias("error"))


def statements(raw: DataFrame, payload: str, kind: str, keys: list[str]) -> DataFrame:
    """keys, statement_type, currency, list, error: for each company and period
    the consolidated statement, or the separate one if there is no consolidated
    one. raw has a row for each of the two kinds (CFS, OFS) that was asked for.
    currency is the first that isn't empty, KRW if none is."""
    read = raw.select(*keys, F.col(kind).alias("kind"), F.from_json(payload, STATEMENT).alias("p"))
    code = lambda k: F.max(F.when(F.col("kind") == k, F.coalesce(F.col("p.status"), F.lit("invalid response"))))
    rows = lambda k: F.first(F.when((F.col("kind") == k) & (F.col("p.status") == SOUND), F.col("p.list")), ignorenulls=True)
    both = read.groupBy(*keys).agg(code("CFS").alias("c"), code("OFS").alias("o"), rows("CFS").alias("cl"), rows("OFS").alias("ol"))
    none = F.coalesce("c", F.lit(NOTHING)) == NOTHING
    chosen = F.when(F.col("c") == SOUND, "CFS").when(none & (F.col("o") == SOUND), "OFS")
    listed = F.when(F.col("c") == SOUND, F.col("cl")).when(none & (F.col("o") == SOUND), F.col("ol"))
    error = F.when(~none & (F.col("c") != SOUND), F.col("c")).when(none & ~F.coalesce(F.col("o"), F.lit(NOTHING)).isin(SOUND, NOTHING), F.col("o")).when(chosen.isNull(), "not found").when(listed.isNull(), "omitted rows")
    named = F.get(F.filter(F.transform("list", lambda r: r.currency), lambda c: c.isNotNull() & (c != "")), F.lit(0))
    return both.select(*keys, chosen.alias("statement_type"), listed.alias("list"), error.alias("error")).withColumn("currency", F.when(F.col("error").isNull(), F.coalesce(named, F.lit("KRW"))))


def statement_rows(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, account_id, account_nm, amount: the account rows of `statements`."""
    rows = found.select(*keys, F.posexplode("list").alias("seq", "r"))
    return rows.select(*keys, "seq", F.coalesce("r.account_id", F.lit("")).alias("account_id"), F.coalesce("r.account_nm", F.lit("")).alias("account_nm"), amount(F.col("r.thstrm_amount")).alias("amount"))


FLOW = "struct<rt_cd:string,msg1:string,output:struct<frgn_ntby_qty:string,orgn_ntby_qty:string,prsn_ntby_qty:string,frgn_hldn_qty:string,frgn_hldn_rate:string>>"


def investor_flow(raw: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Typed snapshots of investor flows: thousands separators go, the three net
    quantities must be there, the holdings may be missing."""
    q = F.from_json(payload, FLOW)
    cell = lambda c: F.regexp_replace(F.trim(F.col(f"q.output.{c}")), ",", "")
    number = lambda c: F.nullif(cell(c), F.lit("")).try_cast("decimal(24,6)")
    need = {"foreign_net_quantity": "frgn_ntby_qty", "institution_net_quantity": "orgn_ntby_qty", "individual_net_quantity": "prsn_ntby_qty"}
    may = {"foreign_holding_quantity": "frgn_hldn_qty", "foreign_holding_rate": "frgn_hldn_rate"}
    error = F.when(F.col("q.rt_cd").isNull(), "invalid response").when(F.col("q.rt_cd") != "0", F.coalesce("q.msg1", F.lit("request failed"))).when(F.col("q.output").isNull(), "omitted output")
    for c in need.values():
        error = error.when(F.coalesce(cell(c), F.lit("")) == "", f"omitted {c}").when(number(c).isNull(), f"invalid {c}")
    for c in may.values():
        error = error.when((F.coalesce(cell(c), F.lit("")) != "") & number(c).isNull(), f"invalid {c}")
    return raw.select(*keep, q.alias("q")).select(*keep, *[number(c).alias(n) for n, c in (need | may).items()], error.alias("error"))


def order_book(quotes_: DataFrame, tick: float, levels: int = 5) -> DataFrame:
    """Levels on either side of each price, a tick apart."""
    level = F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level")
    df = quotes_.select("symbol", "price", level)
    side = F.explode(F.array(F.struct(F.lit("ask").alias("side"), F.lit(1).alias("sign")), F.struct(F.lit("bid").alias("side"), F.lit(-1).alias("sign")))).alias("s")
    return df.select("symbol", "price", "level", side).select("symbol", "level", "s.side", F.round(F.col("price") + F.col("s.sign") * F.col("level") * tick, 2).alias("level_price"))


def change_percent(price: Column, change: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(change, price - change) * 100, F.lit(0.0)), 2)
