"""One row per symbol that brings its card, technicals, signals, book, funding and chain together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions.numerics import div
from factorlake.operators.decisions import LONG_HOT, SHORT_HOT

# What a view says where a stance, or else a theme, decides the regime.
STANCES = {"WATCH_LONG": "upward, but wait", "WATCH_SHORT": "downward, but wait", "LEAN_LONG": "upward", "LEAN_SHORT": "downward"}
THEMES = {"trend": "trend structure", "volatility": "volatility structure", "liquidity": "liquidity structure"}
COLUMNS = ("symbol", "timestamp", "last_close", "last_change", "bias", "confidence", "regime", "primary_factor", "conflicts", "folds_positive", "folds")


def _newest(frame: DataFrame, **columns: str) -> DataFrame:
    """(symbol, columns) of each symbol's newest row, under their new names."""
    return frame.groupBy("symbol").agg(F.max_by(F.struct(*(F.col(c).alias(n) for n, c in columns.items())), "timestamp").alias("x")).select("symbol", "x.*")


def _said(column: str, texts: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in texts.items() for x in kv)), F.col(column))


def view(market: DataFrame, cards: DataFrame, signals: DataFrame, states: DataFrame, micro: DataFrame, derivatives: DataFrame, onchain: DataFrame, folds: DataFrame) -> DataFrame:
    """The view of every symbol of market.

    Bias and confidence are the card's, else the technicals', else what signals,
    crowding and the book let infer. The regime goes by the card's stance, the trend, the strongest signal's theme, then the
    book's, the chain's and the crowding's label. last_change needs three bars. Conflicts
    are tags. Of folds those with a positive test Sharpe count.
    """
    own = Window.partitionBy("symbol").orderBy("timestamp")
    bars = market.select("symbol", "timestamp", "close", F.lag("close").over(own).alias("before"), (F.lag("close", 2).over(own).isNotNull()).alias("three"))
    d = _newest(bars, timestamp="timestamp", last_close="close", before="before", three="three")
    first = F.struct("signal_score", "confidence", F.col("factor"))
    side = lambda s: F.count_if(F.col("signal") == s)
    heard = signals.groupBy("symbol").agg(side("BULLISH").alias("bulls"), side("BEARISH").alias("bears"), F.max("confidence").alias("sure"), F.max_by(F.struct("theme", "factor"), first).alias("top"))
    d = d.join(heard, "symbol", "left")
    d = d.join(cards.select("symbol", "stance", F.col("confidence").alias("card_sure"), "primary_factor", "risk_note"), "symbol", "left")
    d = d.join(states.select("symbol", "technical_bias", F.col("confidence").alias("technical_sure"), "trend_state"), "symbol", "left")
    d = d.join(_newest(micro, book="microstructure_label", spread="spread_bps"), "symbol", "left")
    d = d.join(_newest(derivatives, rate="annualized_funding_rate", crowding="crowding", crowded="crowding_label"), "symbol", "left")
    d = d.join(_newest(onchain, chain="onchain_label").withColumn("on_chain", F.lit(True)), "symbol", "left")
    d = d.join(F.broadcast(folds.agg(F.count_if(F.col("test_sharpe") > 0).alias("folds_positive"), F.count(F.lit(1)).alias("folds"))), how="cross")  # one row
    bulls, bears = F.coalesce("bulls", F.lit(0)), F.coalesce("bears", F.lit(0))
    inferred = (
        F.when((bulls > bears) & F.col("crowding").isin(*LONG_HOT), "WATCH_LONG").when((bears > bulls) & F.col("crowding").isin(*SHORT_HOT), "WATCH_SHORT").when(bulls > bears, "LEAN_LONG")
        .when(bears > bulls, "LEAN_SHORT").when(F.col("book") == "BID_DOMINANT", "WATCH_LONG").when(F.col("book") == "ASK_DOMINANT", "WATCH_SHORT").otherwise("NEUTRAL")
    )
    family = lambda c: F.when(F.contains(F.col(c), F.lit("LONG")), "LONG").when(F.contains(F.col(c), F.lit("SHORT")), "SHORT").otherwise(F.col(c))
    conflicts = F.concat_ws(
        " ", F.when(F.col("risk_note") != "none", F.col("risk_note")), F.when(family("stance") != family("technical_bias"), F.concat(F.lit("technicals="), F.lower("technical_bias"))),
        F.when(F.abs("rate") > 0.1, "funding=extreme"), F.when(F.col("spread") > 8, "book=thin"), F.when(F.col("on_chain").isNull(), "chain=missing"),
    )
    return d.select(
        "symbol", "timestamp", "last_close", F.when(F.col("three"), div("last_close", "before") - 1.0).alias("last_change"), F.coalesce("stance", "technical_bias", inferred).alias("bias"),
        F.coalesce("card_sure", "technical_sure", "sure").alias("confidence"),
        F.coalesce(_said("stance", STANCES), "trend_state", _said("top.theme", THEMES), "book", "chain", "crowded", F.lit("waiting")).alias("regime"),
        F.coalesce("primary_factor", "top.factor").alias("primary_factor"), conflicts.alias("conflicts"), "folds_positive", "folds",
    )
