"""Normalisation and scenario adjustments of market bars."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions.numerics import finite, number
from factorlake.schemas import OHLCV, PRICES, REQUIRED


def normalise(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Typed, complete rows, one per (timestamp, symbol): of duplicates the one with the largest `order` stays.

    A row order is no property of a table, so `order` names the column that
    says which row came last; without it ties go by the row's own values.
    """
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    typed = raw.withColumns(
        {"timestamp": F.col("timestamp").cast("string").try_cast("timestamp_ntz"), "symbol": F.col("symbol").cast("string")} | {c: number(c) for c in OHLCV} | {c: F.lit(None).cast("string") for c in ("asset_class", "frequency") if c not in raw.columns}
    ).dropna(subset=list(REQUIRED))
    last = F.struct(*([F.col(order)] if order else []), *(F.col(c) for c in OHLCV))
    keep = typed.withColumn("__n", F.row_number().over(Window.partitionBy("timestamp", "symbol").orderBy(last.desc())))
    return keep.filter("__n = 1").drop("__n")


@dataclass(frozen=True)
class Adjustment:
    symbol: str
    field: str
    operation: str
    value: float
    start: datetime | None = None
    end: datetime | None = None
    note: str | None = None


def parse_adjustments(raw: object) -> list[Adjustment]:
    """Validated rules; raises ValueError for anything a rule can't be."""
    if raw is None:
        return []
    if not isinstance(raw, list):
        raise ValueError("adjustments are a list of rules")
    out = []
    for r in raw:
        if not isinstance(r, dict) or not str(r.get("symbol") or "").strip():
            raise ValueError("a rule names its symbol")
        if r.get("field") not in OHLCV:
            raise ValueError(f"unknown field {r.get('field')!r}")
        operation = str(r.get("operation", "multiply"))
        if operation not in ("multiply", "add", "set"):
            raise ValueError(f"unknown operation {operation!r}")
        try:
            value = float(r["value"])
        except (KeyError, TypeError, ValueError):
            raise ValueError("a rule has a numeric value") from None
        start, end = (datetime.fromisoformat(str(r[k])) if r.get(k) else None for k in ("start", "end"))
        if start and end and start > end:
            raise ValueError("a rule's start is not after its end")
        out.append(Adjustment(str(r["symbol"]).strip(), r["field"], operation, value, start, end, r.get("note")))
    return out


def adjust(market: DataFrame, rules: list[Adjustment]) -> DataFrame:
    """Rules in their order, each on the result of those before; with any rule, all bars are made consistent."""
    if not rules:
        return market
    out = market
    for r in rules:
        hit = F.col("symbol") == r.symbol
        if r.start:
            hit = hit & (F.col("timestamp") >= F.lit(r.start).cast("timestamp_ntz"))
        if r.end:
            hit = hit & (F.col("timestamp") <= F.lit(r.end).cast("timestamp_ntz"))
        x = F.col(r.field)
        new = {"multiply": x * r.value, "add": x + r.value, "set": F.lit(r.value)}[r.operation]
        out = out.withColumn(r.field, F.when(hit, new).otherwise(x))
    out = out.withColumns({"volume": F.greatest("volume", F.lit(0.0))} | {c: F.greatest(c, F.lit(0.01)) for c in PRICES})
    out = out.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")})
    return out.withColumns({c: finite(c) for c in OHLCV}).dropna(subset=list(REQUIRED))
