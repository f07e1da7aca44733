"""Realtime feeds as Structured Streaming: message routing, latest books, bounded last-N buffers, windows.

Messages are JSON text with an `arg` (channel, instId) and `data`. Each channel
has a parser that is a plain projection, so batch and stream share it; text
that is no message, pings and errors fall to the events side. The newest book
per instrument goes by the feed's sequence, not by arrival, so late messages
can't put an old book back.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorlake.functions import workdir
from factorlake.functions.numerics import div, number
from factorlake.operators.context import depth, levels, millis
from factorlake.streaming.state import SERVED

MESSAGE = "event string, code string, msg string, arg struct<channel:string,instId:string,instType:string>, data array<string>"
BOOKS = ("books", "books5", "bbo-tbt")
BOOK = "ts string, seqId string, bids array<array<string>>, asks array<array<string>>"
TRADE = "instId string, px string, sz string, side string, tradeId string, ts string"
LIQUIDATION = "instId string, instType string, details array<struct<side:string,sz:string,bkPx:string,ts:string,instId:string,instType:string>>"


def spot_id(symbol: str, quote: str = "USDT") -> str:
    s = symbol.strip().upper().replace("/", "-")
    if s.endswith("-USD"):
        return f"{s[:-4]}-{quote}"
    return s if "-" in s else f"{s}-{quote}"


def swap_id(symbol: str) -> str:
    s = spot_id(symbol)
    return s if s.endswith("-SWAP") else f"{s}-SWAP"


def subscriptions(symbols: list[str], channels: tuple[str, ...] = ("books5", "trades"), liquidations: bool = True, limit: int = 8) -> list[dict[str, str]]:
    """Deduplicated subscription arguments of at most `limit` symbols."""
    allowed = [c for c in dict.fromkeys(channels) if c in (*BOOKS, "trades")]
    names = list(dict.fromkeys(s.strip().upper() for s in symbols if s.strip()))[:limit]
    out = [{"channel": c, "instId": spot_id(s)} for s in names for c in allowed]
    if liquidations and names:
        out.append({"channel": "liquidation-orders", "instType": "SWAP"})
    return list({json.dumps(a, sort_keys=True): a for a in out}.values())


def route(messages: DataFrame, text: str = "value") -> DataFrame:
    """messages with `m` (parsed, null where it isn't one) and `kind`: book, trade, liquidation, pong, invalid, error, event or other."""
    m = F.from_json(F.col(text), MESSAGE, {"mode": "PERMISSIVE"})
    d = messages.withColumn("m", m)
    bad = F.col("m").isNull() | (F.col("m.event").isNull() & F.col("m.arg").isNull() & F.col("m.data").isNull())
    channel = F.col("m.arg.channel")
    kind = (
        F.when(F.trim(text) == "pong", "pong").when(bad, "invalid").when(F.col("m.event") == "error", "error").when(F.col("m.event").isNotNull(), "event")
        .when(channel.isin(*BOOKS), "book").when(channel == "trades", "trade").when(channel == "liquidation-orders", "liquidation").otherwise("other")
    )
    return d.withColumn("kind", kind)


def _items(routed: DataFrame, kind: str, schema: str) -> DataFrame:
    seq = ["seq"] if "seq" in routed.columns else []
    return routed.filter(F.col("kind") == kind).select(*seq, "m.arg", F.explode("m.data").alias("raw")).select(*seq, "arg", F.from_json("raw", schema).alias("x"))


def books(routed: DataFrame) -> DataFrame:
    d = _items(routed, "book", BOOK).select(F.col("arg.instId").alias("inst_id"), "x", levels(F.col("x.bids")).alias("b"), levels(F.col("x.asks")).alias("a"))
    bid, ask = F.get("b", F.lit(0))["p"], F.get("a", F.lit(0))["p"]
    d = d.select(millis(F.col("x.ts")).alias("timestamp"), "inst_id", bid.alias("best_bid"), ask.alias("best_ask"), ((bid + ask) / 2).alias("mid_price"), depth(F.col("b")).alias("bid_depth_usd"), depth(F.col("a")).alias("ask_depth_usd"), F.col("x.seqId").try_cast("long").alias("seq_id"))
    return d.withColumn("spread_bps", div(F.col("best_ask") - F.col("best_bid"), "mid_price") * 10_000)


def trades(routed: DataFrame) -> DataFrame:
    x = _items(routed, "trade", TRADE)
    return x.select(millis(F.col("x.ts")).alias("timestamp"), F.coalesce("x.instId", "arg.instId").alias("inst_id"), number("x.px").alias("price"), number("x.sz").alias("size"), F.lower("x.side").alias("side"), F.col("x.tradeId").alias("trade_id"))


def liquidations(routed: DataFrame) -> DataFrame:
    x = _items(routed, "liquidation", LIQUIDATION).select("arg", "x", F.explode("x.details").alias("d"))
    return x.select(
        millis(F.col("d.ts")).alias("timestamp"), F.coalesce("d.instId", "x.instId", "arg.instId").alias("inst_id"), F.coalesce("d.instType", "x.instType", "arg.instType").alias("inst_type"), F.lower("d.side").alias("side"),
        number("d.sz").alias("size"), number("d.bkPx").alias("bankruptcy_price"),
    )


def liquidation_items(routed: DataFrame) -> DataFrame:
    """(inst_id, seq, item) of each liquidation, as text, for a buffer; messages have a seq."""
    x = _items(routed, "liquidation", LIQUIDATION).select("seq", "arg", "x", F.explode("x.details").alias("d"))
    return x.select(F.coalesce("d.instId", "x.instId", "arg.instId").alias("inst_id"), "seq", F.concat_ws(" ", F.lower("d.side"), "d.sz", "d.bkPx").alias("item"))


def event_items(routed: DataFrame) -> DataFrame:
    """(inst_id, seq, item) of what is no book, trade or liquidation: the kind stands for the instrument, the text is the item."""
    return routed.filter(~F.col("kind").isin("book", "trade", "liquidation")).select(F.col("kind").alias("inst_id"), "seq", F.substring("value", 1, 200).alias("item"))


def latest_books(rows: DataFrame) -> DataFrame:
    """The book of the highest sequence per instrument; state is one row per instrument."""
    fields = [c for c in rows.columns if c != "inst_id"]
    return rows.groupBy("inst_id").agg(F.max_by(F.struct(*fields), F.struct("seq_id", "timestamp")).alias("b")).select("inst_id", "b.*")


def last_n_batch(rows: DataFrame, n: int = SERVED, order: str = "seq") -> DataFrame:
    """The same of a finished table."""
    w = Window.partitionBy("inst_id").orderBy(F.col(order).desc(), F.col("item").desc())
    kept = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    return kept.groupBy("inst_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "item"))), lambda x: x["item"]).alias("items"))


def tumbling_bars(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """OHLCV bars of a stream (ts timestamp, symbol, price, size, seq) by event time."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "symbol")
    o = F.struct("ts", "seq")
    bars = g.agg(F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"), F.sum("size").alias("volume"))
    return bars.select(F.col("w.start").cast("timestamp_ntz").alias("timestamp"), "symbol", "open", "high", "low", "close", "volume")


def sliding(events: DataFrame, width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "symbol", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "symbol", "n", "total")


def dedup(events: DataFrame, *keys: str, late: str | None = None) -> DataFrame:
    """The first row of each key; with `late`, state is held for that long only and a key may come again after it."""
    if late:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys)).select(*keys)
    return events.dropDuplicates(list(keys)).select(*keys)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream."""
    # As a pattern, since a stream's plain path has to be a folder.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run(stream: DataFrame, mode: str = "append", finish: Callable[[DataFrame], DataFrame] | None = None, key: str | tuple[str, ...] | None = None) -> DataFrame:
    """All that is there now, through the stream, as a table: complete mode keeps the last batch, others all batches, of which each key's last row counts where there is a key."""
    keys = (key,) if isinstance(key, str) else key
    spark = stream.sparkSession
    out = workdir.fresh(spark, "stream-out")

    def write(batch: DataFrame, epoch: int) -> None:
        # A batch that runs again replaces what it wrote before.
        batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else f'epoch={epoch}'}")

    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", workdir.fresh(spark, "stream-state")).foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    if keys:
        rows = spark.read.schema(T.StructType([*stream.schema, T.StructField("epoch", T.LongType())])).option("basePath", out).parquet(f"{out}/epoch=*")
        table = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "epoch").alias("row")).select("row.*")
    else:
        table = spark.read.schema(stream.schema).parquet(f"{out}/all" if mode == "complete" else f"{out}/*")
    return finish(table) if finish else table


def as_messages(events: DataFrame) -> DataFrame:
    """Feed messages out of an events table: books, trades, liquidations, pings and broken text by event_id."""
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").cast("string")
    inst = F.concat(F.upper("event_type"), F.lit("-USDT"))
    text = lambda c: F.round(c, 4).cast("string")
    price = F.col("value") + 1.0
    level = lambda p, q: F.array(text(p), q)
    book = F.to_json(
        F.struct(
            F.struct(F.lit("books5").alias("channel"), inst.alias("instId")).alias("arg"),
            F.array(F.struct(ms.alias("ts"), F.col("event_id").cast("string").alias("seqId"), F.array(level(price, F.lit("2")), level(price - 0.5, F.lit("3"))).alias("bids"), F.array(level(price + 0.5, F.lit("1")), F.array(F.lit("bad"), F.lit("1"))).alias("asks"))).alias("data"),
        )
    )
    trade = F.to_json(F.struct(F.struct(F.lit("trades").alias("channel"), inst.alias("instId")).alias("arg"), F.array(F.struct(text(price).alias("px"), F.lit("1.5").alias("sz"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("SELL").alias("side"), F.col("event_id").cast("string").alias("tradeId"), ms.alias("ts"))).alias("data")))
    detail = lambda s: F.struct(F.lit(s).alias("side"), F.lit("4").alias("sz"), text(price).alias("bkPx"), ms.alias("ts"))
    liquidation = F.to_json(F.struct(F.struct(F.lit("liquidation-orders").alias("channel"), F.lit("SWAP").alias("instType")).alias("arg"), F.array(F.struct(F.concat(inst, F.lit("-SWAP")).alias("instId"), F.array(detail("buy"), detail("sell")).alias("details"))).alias("data")))
    k = F.col("event_id") % 10
    return events.select(F.col("event_id").alias("seq"), F.when(k == 0, "pong").when(k == 1, "{broken").when(k == 2, F.lit('{"event":"error","code":"1","msg":"x"}')).when(k == 3, liquidation).when(k < 7, trade).otherwise(book).alias("value"))


