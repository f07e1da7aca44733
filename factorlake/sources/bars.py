"""OHLCV bars out of tick-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build(ticks: DataFrame, symbol: Column, at: Column, price: Column, size: Column, order: list[Column], asset_class: str, frequency: str) -> DataFrame:
    """One bar for each symbol and time; open and close by `order`, which must be total among a bar's ticks.

    A single aggregation with map-side partials: a hot symbol costs no more than its bars.
    """
    t = ticks.select(symbol.alias("symbol"), at.cast("timestamp_ntz").alias("timestamp"), price.cast("double").alias("p"), size.cast("double").alias("v"), F.struct(*order).alias("o"))
    bars = t.groupBy("timestamp", "symbol").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").alias("volume"))
    return bars.withColumns({"asset_class": F.lit(asset_class), "frequency": F.lit(frequency)})


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return build(e, F.col("event_type"), F.date_trunc("hour", "ts"), F.col("value"), F.lit(1.0), [F.col("ts"), F.col("event_id")], "crypto", "1h")


def lineitem_daily(spark: SparkSession, sf_dir: str, symbol: Column | None = None) -> DataFrame:
    t = read(spark, sf_dir, "lineitem")
    symbol = F.concat("l_returnflag", "l_linestatus") if symbol is None else symbol
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]
    return build(t, symbol, F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), order, "equity", "1d")


def suppliers_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide cross-section: one symbol for each supplier."""
    return lineitem_daily(spark, sf_dir, F.col("l_suppkey").cast("string"))
