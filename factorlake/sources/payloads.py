"""Candle payloads of an exchange's REST route to market bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.functions.numerics import number
from factorlake.operators.context import LISTS, millis, parsed
from factorlake.operators.prepare import normalise

FIELDS = 9


def candles(replies: DataFrame, asset_class: str, frequency: str, unconfirmed: bool = False) -> DataFrame:
    """(symbol, inst_id, payload) to bars: rows short of fields leave, and open candles unless asked for; of equal times the larger row stays."""
    x = parsed(replies, LISTS).select("symbol", "inst_id", F.explode("p.data").alias("x")).filter(F.size("x") >= FIELDS)
    at = lambda i: F.get("x", F.lit(i))
    d = x.select(
        millis(at(0)).alias("timestamp"), "symbol", *(number(at(i + 1)).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"))), F.lit(asset_class).alias("asset_class"), F.lit(frequency).alias("frequency"),
        F.lit("okx").alias("exchange"), F.col("inst_id").alias("okx_inst_id"), (at(8) == "1").alias("okx_confirmed"),
    )
    return normalise(d if unconfirmed else d.filter("okx_confirmed"))
