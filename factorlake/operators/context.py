"""Context feeds: derivatives, order books and on-chain metrics out of JSON payloads, and how fresh each source is.

Payload frames hold (symbol, inst_id, payload): the JSON text an exchange's
REST route returned. Times are milliseconds since the epoch, read as UTC.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions.numerics import div, number

FUNDING = "code string, msg string, data array<struct<instId:string,instType:string,fundingRate:string,realizedRate:string,premium:string,interestRate:string,nextFundingTime:string,fundingTime:string,ts:string>>"
INTEREST = "code string, msg string, data array<struct<instId:string,instType:string,oi:string,oiCcy:string,oiUsd:string,ts:string>>"
LISTS = "code string, msg string, data array<array<string>>"
BOOK = "code string, msg string, data array<struct<ts:string,bids:array<array<string>>,asks:array<array<string>>>>"
TRADES = "code string, msg string, data array<struct<px:string,sz:string,side:string,ts:string>>"
KEYS = ["timestamp", "symbol", "exchange", "inst_id", "inst_type"]


def millis(x: Column) -> Column:
    """Milliseconds as text to a UTC timestamp without zone."""
    n = x.cast("string").try_cast("long")
    return (F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(n / F.lit(1000)).cast("decimal(18,6)"))).cast("timestamp_ntz")


def parsed(frame: DataFrame, schema: str, name: str = "payload") -> DataFrame:
    """frame with its payload as `p`; raises at run time for an error reply."""
    p = F.from_json(F.col(name), schema)
    bad = p["code"].isNotNull() & (p["code"] != "0")
    return frame.withColumn("p", F.when(bad, F.raise_error(F.concat(F.lit("exchange error "), p["code"], F.lit(": "), F.coalesce(p["msg"], F.lit(""))))).otherwise(p))


def crowding(rate: str | Column) -> Column:
    r = F.col(rate) if isinstance(rate, str) else rate
    return F.when(r.isNull(), "UNKNOWN").when(r >= 0.25, "LONG_CROWDED").when(r >= 0.1, "LONG_WARM").when(r <= -0.25, "SHORT_CROWDED").when(r <= -0.1, "SHORT_WARM").otherwise("NEUTRAL")


def crowding_label(c: str) -> Column:
    return F.lower(F.replace(F.col(c), F.lit("_"), F.lit(" ")))


def derivatives_snapshot(funding: DataFrame, interest: DataFrame) -> DataFrame:
    """One row per instrument of the newest funding rate and open interest."""
    f = parsed(funding, FUNDING).select("symbol", "inst_id", F.get("p.data", F.lit(0)).alias("f"))
    o = parsed(interest, INTEREST).select("inst_id", F.get("p.data", F.lit(0)).alias("o"))
    j = f.join(o, "inst_id", "left")
    d = j.select(
        millis(F.greatest(F.col("f.ts").try_cast("long"), F.col("o.ts").try_cast("long"))).alias("timestamp"), "symbol", F.lit("okx").alias("exchange"), "inst_id", F.coalesce("f.instType", "o.instType", F.lit("SWAP")).alias("inst_type"),
        number("f.fundingRate").alias("funding_rate"), (number("f.fundingRate") * 3 * 365).alias("annualized_funding_rate"), number("f.premium").alias("premium"), number("f.interestRate").alias("interest_rate"),
        millis(F.col("f.nextFundingTime")).alias("next_funding_time"), number("o.oi").alias("oi_contracts"), number("o.oiCcy").alias("oi_ccy"), number("o.oiUsd").alias("oi_usd"),
    )
    d = d.withColumn("crowding", crowding("annualized_funding_rate")).withColumn("crowding_label", crowding_label("crowding"))
    rate = F.coalesce(F.format_string("annualised funding %.1f%%", F.col("annualized_funding_rate") * 100), F.lit("no funding rate"))
    size = F.coalesce(F.format_string("open interest %.2fB USD", F.col("oi_usd") / 1e9), F.lit("no open interest"))
    rate, size = F.when(F.col("annualized_funding_rate").isNull(), "no funding rate").otherwise(rate), F.when(F.col("oi_usd").isNull(), "no open interest").otherwise(size)
    return d.withColumn("interpretation", F.concat_ws("; ", "crowding_label", rate, size))


def derivatives_history(funding: DataFrame, interest: DataFrame, ratios: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Funding, open interest and long/short ratio by time, outer-joined; [start, end)."""
    key = lambda kind: [F.lit("okx").alias("exchange"), "inst_id", kind]
    f = parsed(funding, FUNDING).select("symbol", "inst_id", F.explode("p.data").alias("x"))
    f = f.select(millis(F.col("x.fundingTime")).alias("timestamp"), "symbol", *key(F.coalesce("x.instType", F.lit("SWAP")).alias("inst_type")), number("x.fundingRate").alias("funding_rate"), number("x.realizedRate").alias("realized_rate"), (number("x.fundingRate") * 3 * 365).alias("annualized_funding_rate"))

    def rows(frame: DataFrame, names: list[str]) -> DataFrame:
        x = parsed(frame, LISTS).select("symbol", "inst_id", F.explode("p.data").alias("x")).filter(F.size("x") > len(names))
        return x.select(millis(F.get("x", F.lit(0))).alias("timestamp"), "symbol", *key(F.lit("SWAP").alias("inst_type")), *(number(F.get("x", F.lit(i + 1))).alias(n) for i, n in enumerate(names)))

    out = f.join(rows(interest, ["oi_contracts", "oi_ccy", "oi_usd"]), KEYS, "full_outer").join(rows(ratios, ["long_short_ratio"]), KEYS, "full_outer")
    if start is not None:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col("timestamp") < F.lit(end).cast("timestamp_ntz"))
    return out


def levels(raw: Column) -> Column:
    """[[price, size, ...], ...] of text to [(p, q)], without levels that lack either."""
    made = F.transform(raw, lambda x: F.struct(number(F.get(x, F.lit(0))).alias("p"), number(F.get(x, F.lit(1))).alias("q")))
    return F.coalesce(F.filter(made, lambda x: x["p"].isNotNull() & x["q"].isNotNull()), F.array().cast("array<struct<p:double,q:double>>"))


def depth(side: Column) -> Column:
    return F.aggregate(side, F.lit(0.0), lambda a, x: a + x["p"] * x["q"])


def book_label(spread: Column, imbalance: Column, buys: Column, sells: Column) -> Column:
    return F.when(spread.isNull(), "UNKNOWN").when(spread > 8, "WIDE_SPREAD").when((imbalance > 0.2) & (buys >= sells), "BID_DOMINANT").when((imbalance < -0.2) & (sells >= buys), "ASK_DOMINANT").otherwise("BALANCED")


def microstructure(books: DataFrame, trades: DataFrame) -> DataFrame:
    """One row per instrument of a book snapshot and its recent trades; the first trade is the last one done."""
    b = parsed(books, BOOK).select("symbol", "inst_id", F.get("p.data", F.lit(0)).alias("b"))
    t = parsed(trades, TRADES).select("inst_id", F.coalesce("p.data", F.array().cast("array<struct<px:string,sz:string,side:string,ts:string>>")).alias("t"))
    d = b.join(t, "inst_id", "left").select("symbol", "inst_id", "b", "t", levels(F.col("b.bids")).alias("bids"), levels(F.col("b.asks")).alias("asks"), F.get("t", F.lit(0)).alias("l"))
    side = lambda s: F.coalesce(F.size(F.filter("t", lambda x: F.lower(x["side"]) == s)), F.lit(0)).cast("long")
    d = d.withColumns({"best_bid": F.get("bids", F.lit(0))["p"], "best_ask": F.get("asks", F.lit(0))["p"], "bid_depth_usd": depth(F.col("bids")), "ask_depth_usd": depth(F.col("asks")), "buy_trade_count": side("buy"), "sell_trade_count": side("sell")})
    d = d.withColumn("mid_price", (F.col("best_bid") + F.col("best_ask")) / 2)
    d = d.withColumns({"spread_bps": div(F.col("best_ask") - F.col("best_bid"), "mid_price") * 10_000, "depth_imbalance": div(F.col("bid_depth_usd") - F.col("ask_depth_usd"), F.col("bid_depth_usd") + F.col("ask_depth_usd"))})
    d = d.withColumn("microstructure_label", book_label(F.col("spread_bps"), F.col("depth_imbalance"), F.col("buy_trade_count"), F.col("sell_trade_count")))
    said = F.concat_ws(
        "; ", F.lower("microstructure_label"), F.when(F.col("spread_bps").isNull(), "spread unknown").otherwise(F.format_string("spread %.2f bps", "spread_bps")),
        F.format_string("depth %.1fM bid, %.1fM ask", F.col("bid_depth_usd") / 1e6, F.col("ask_depth_usd") / 1e6), F.format_string("%d buys, %d sells", "buy_trade_count", "sell_trade_count"),
    )
    return d.select(
        millis(F.greatest(F.col("b.ts").try_cast("long"), F.col("l.ts").try_cast("long"))).alias("timestamp"), "symbol", F.lit("okx").alias("exchange"), "inst_id", "best_bid", "best_ask", "mid_price", "spread_bps", "bid_depth_usd", "ask_depth_usd",
        "depth_imbalance", number("l.px").alias("last_trade_price"), number("l.sz").alias("last_trade_size"), F.lower("l.side").alias("last_trade_side"), F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("recent_trade_count"),
        "buy_trade_count", "sell_trade_count", "microstructure_label", said.alias("interpretation"),
    )


def onchain(active: DataFrame, count: DataFrame) -> DataFrame:
    """(timestamp, symbol, provider, asset, ...) of two metric frames, with seven-row changes and a label."""
    d = active.join(count, ["timestamp", "symbol", "provider", "asset"], "full_outer")
    w = Window.partitionBy("symbol").orderBy("timestamp")

    def change(c: str) -> Column:
        return div(c, F.lag(c, 7).over(w)) - 1

    d = d.withColumns({f"__{c}": F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in ("active_addresses", "tx_count")})
    d = d.withColumns({"active_address_change": change("__active_addresses"), "tx_count_change": change("__tx_count")}).drop("__active_addresses", "__tx_count")
    a, t = F.coalesce("active_address_change", F.lit(0.0)), F.coalesce("tx_count_change", F.lit(0.0))
    up, down = (a > 0.05).cast("int") + (t > 0.05).cast("int"), (a < -0.05).cast("int") + (t < -0.05).cast("int")
    label = F.when(up >= 2, "EXPANSION").when(down >= 2, "CONTRACTION").when(up > down, "STRONG").when(down > up, "WEAK").otherwise("NEUTRAL")
    said = lambda c, name: F.when(F.col(c).isNull(), F.lit(f"{name} unknown")).otherwise(F.format_string(f"{name} %+.1f%%", F.col(c) * 100))
    d = d.withColumn("onchain_label", label).withColumn("interpretation", F.concat_ws("; ", F.lower("onchain_label"), said("active_address_change", "addresses over 7 rows"), said("tx_count_change", "transactions over 7 rows")))
    return d.select("timestamp", "symbol", "provider", "asset", "active_addresses", "active_address_change", "tx_count", "tx_count_change", "onchain_label", "interpretation")


MARKET_STALE = {"1m": 10, "5m": 30, "1h": 180, "1d": 4320}
CONTEXT_STALE = {"derivatives_snapshot": 720, "derivatives_history": 5760, "microstructure": 30, "onchain": 5760}


def source_status(provider: str, frequency: str, market: DataFrame, contexts: dict[str, DataFrame | None], generated_at: datetime) -> DataFrame:
    """(scope, symbol, provider, status, rows, latest_timestamp, freshness_minutes, message): one row per scope and symbol.

    A context of None is switched off; an empty one gives a single MISSING row.
    """
    now = F.unix_micros(F.lit(generated_at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz").cast("timestamp"))

    def rows(scope: str, frame: DataFrame, limit: int) -> DataFrame:
        g = frame.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("timestamp").cast("timestamp_ntz")).alias("latest_timestamp"))
        minutes = F.greatest((now - F.unix_micros(F.col("latest_timestamp").cast("timestamp"))) / 60e6, F.lit(0.0))
        d = g.withColumn("freshness_minutes", minutes)
        fresh = F.when(F.col("freshness_minutes") <= limit, "OK").otherwise("STALE")
        if scope == "market":
            fresh = F.when(F.col("freshness_minutes").isNull(), "MISSING").otherwise(F.lit("SIMULATED") if provider == "synthetic" else fresh)
        return d.select(F.lit(scope).alias("scope"), "symbol", F.lit(provider).alias("provider"), fresh.alias("status"), "rows", "latest_timestamp", "freshness_minutes")

    def single(scope: str, status: str) -> DataFrame:
        spark = market.sparkSession
        return spark.createDataFrame([(scope, "ALL", provider, status, 0, None, None)], "scope string, symbol string, provider string, status string, rows long, latest_timestamp timestamp_ntz, freshness_minutes double")

    def or_missing(scope: str, found: DataFrame) -> DataFrame:
        # A row of its own only where there is none, without asking first.
        none = single(scope, "MISSING").join(found.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select("n"), how="inner").drop("n")
        return found.unionByName(none)

    out = or_missing("market", rows("market", market, MARKET_STALE.get(frequency, 1440)))
    for scope, limit in CONTEXT_STALE.items():
        frame = contexts.get(scope)
        out = out.unionByName(single(scope, "SKIPPED") if frame is None else or_missing(scope, rows(scope, frame, limit)))
    age = F.when(F.col("freshness_minutes") < 90, F.format_string("%.0f minutes", "freshness_minutes")).when(F.col("freshness_minutes") < 4320, F.format_string("%.1f hours", F.col("freshness_minutes") / 60)).otherwise(F.format_string("%.1f days", F.col("freshness_minutes") / 1440))
    return out.withColumn("message", F.when(F.col("freshness_minutes").isNull(), F.concat(F.lower("status"), F.lit(" "), "scope")).otherwise(F.concat(F.lit("last updated "), age, F.lit(" ago"))))


def overall_status(rows: DataFrame, provider: str) -> DataFrame:
    any_of = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    status = F.when(F.count(F.lit(1)) == 0, "MISSING").when(F.lit(provider == "synthetic"), "SIMULATED").when(any_of("MISSING"), "WARN").when(any_of("STALE"), "STALE").otherwise("OK")
    return rows.agg(status.alias("status"))
