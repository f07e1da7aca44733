"""Technical indicators and the indicator state table.

Rolling indicators are window expressions over one specification, so one sort
serves them. The smoothers asked for are linear recurrences: bars are dealt to
ranges of (symbol, timestamp), a task composes its range's steps as an
associative scan, and small tables with one row a range carry the bar before it
and the smoothers' states over, so a long symbol is the work of many tasks.
Smoothers of smoothed values (signal line, ADX) are carried once their inputs
are. SuperTrend alone depends on its own past in no linear way: it runs in order
over each symbol's bars, a batch at a time, carrying a few numbers; a symbol's
history is never held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions import ranges, workdir
from factorlake.functions.numerics import clamp, div, finite, rolling, series
from factorlake.functions.ranges import RANGE
from factorlake.functions.recurrences import Smoothing, joined, smooth, span

SMOOTHED = ("ema_20", "ema_50", "ema_200", "rsi_14", "macd", "macd_signal", "macd_hist", "atr_14", "supertrend_10_3", "supertrend_direction_10_3", "adx_14", "plus_di_14", "minus_di_14")
INDICATORS = (
    "ema_20", "ema_50", "ema_200", "sma_20", "sma_50", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_mid_20", "bb_upper_20", "bb_lower_20", "bb_percent_b_20", "atr_14", "atr_percent_14", "supertrend_10_3",
    "supertrend_direction_10_3", "vwap_20", "obv", "obv_slope_20", "adx_14", "plus_di_14", "minus_di_14", "mfi_14", "stoch_rsi_k_14", "stoch_rsi_d_14", "donchian_high_20", "donchian_low_20", "donchian_position_20",
)


CORE = ("timestamp", "symbol", "open", "high", "low", "close", "volume")
# What is smoothed first, and what is made of that and smoothed again.
FIRST = {
    "ema_20": span(20), "ema_50": span(50), "ema_200": span(200), "fast": span(12, 12), "slow": span(26, 26), "band_atr": Smoothing(1 / 10, 10),
    "gain": Smoothing(1 / 14, 14), "loss": Smoothing(1 / 14, 14), "atr_14": Smoothing(1 / 14, 14), "plus": Smoothing(1 / 14, 14), "minus": Smoothing(1 / 14, 14),
}
SECOND = {"macd_signal": span(9, 9), "adx_14": Smoothing(1 / 14, 14)}
_SOURCE = {"macd_signal": "macd", "adx_14": "dx"}
_DI = ("atr_14", "plus", "minus")
NEEDS = {
    "ema_20": ("ema_20",), "ema_50": ("ema_50",), "ema_200": ("ema_200",), "rsi_14": ("gain", "loss"), "macd": ("fast", "slow"), "macd_signal": ("fast", "slow", "macd_signal"), "macd_hist": ("fast", "slow", "macd_signal"),
    "atr_14": ("atr_14",), "supertrend_10_3": ("band_atr",), "supertrend_direction_10_3": ("band_atr",), "adx_14": (*_DI, "adx_14"), "plus_di_14": _DI, "minus_di_14": _DI,
}


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, missing where b is 0."""
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def _inputs(names: set[str], bars: dict[str, np.ndarray], before: tuple[float, ...], starts: np.ndarray) -> dict[str, np.ndarray]:
    """What the first smoothers take, of a block of bars after the bar `before` (high, low, close)."""
    high, low, close = bars["high"], bars["low"], bars["close"]
    was = {k: np.where(starts, np.nan, np.append(v, bars[k][:-1])) for k, v in zip(("high", "low", "close"), before)}
    change, up, down = close - was["close"], high - was["high"], was["low"] - low
    out = dict.fromkeys(("ema_20", "ema_50", "ema_200", "fast", "slow"), close)
    out |= {"gain": np.maximum(change, 0.0), "loss": np.maximum(-change, 0.0), "plus": np.where((up > down) & (up > 0), up, 0.0), "minus": np.where((down > up) & (down > 0), down, 0.0)}
    out["atr_14"] = out["band_atr"] = np.fmax(np.fmax(high - low, np.abs(high - was["close"])), np.abs(low - was["close"]))
    return {k: out[k] for k in names & set(FIRST)}


def _made(names: set[str], first: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Indicators and the second smoothers' inputs, out of the first ones."""
    out = dict(first)
    if {"gain", "loss"} <= names:
        out["rsi_14"] = 100.0 - 100.0 / (1.0 + _over(first["gain"], first["loss"]))
    if {"fast", "slow"} <= names:
        out["macd"] = first["fast"] - first["slow"]
    if set(_DI) <= names:
        out["plus_di_14"], out["minus_di_14"] = (100.0 * _over(first[k], first["atr_14"]) for k in ("plus", "minus"))
        out["dx"] = 100.0 * _over(np.abs(out["plus_di_14"] - out["minus_di_14"]), out["plus_di_14"] + out["minus_di_14"])
    return out


def _blocks(batch: pa.RecordBatch, symbol: str | None, whole: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A batch cut where the range's first symbol ends (`whole`: it still lasts) and where the batch's last one starts; with where symbols start."""
    who = np.array(batch.column("symbol").to_pylist(), object)
    starts = np.append(who[0] != symbol, who[1:] != who[:-1])
    cuts = np.flatnonzero(starts[1:]) + 1
    edges = sorted({0, *cuts[:whole].tolist(), *cuts[-1:].tolist(), len(who)})
    for i, j in zip(edges, edges[1:]):
        yield batch.slice(i, j - i), starts[i:j]


def _scan(names: set[str], columns: list[str], tell: str) -> Callable:
    """Kernel over one range in order. tell: "first" or "second" for (symbol, RANGE, n, first, y) of these smoothers' pieces at the range's ends, "rows" for the bars with `columns`."""
    first = sorted(names & set(FIRST))
    second = sorted(names & set(SECOND)) if tell != "first" else []
    told = {"first": first, "second": second, "rows": []}[tell]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, number, before = None, None, (np.nan,) * 3
        states: dict[str, tuple[int, float]] = {}
        begun: dict[str, float] = {}  # the first x of the present piece
        pieces: list[tuple] = []

        def piece() -> tuple:
            return symbol, number, [states[k][0] for k in told], [begun.get(k) for k in told], [states[k][1] if states[k][0] else None for k in told]

        for batch in batches:
            for block, starts in _blocks(batch, symbol, not pieces) if batch.num_rows else ():
                if number is None:  # the range's first bar has what comes before it
                    number = block.column(RANGE)[0].as_py()
                    carried = {k: block.column(f"__{k}")[0].as_py() for k in ("bar", "first", "second") if f"__{k}" in block.schema.names}
                    if carried.get("bar") is not None:
                        before, starts[0] = tuple(np.nan if carried["bar"][k] is None else carried["bar"][k] for k in ("high", "low", "close")), False
                    for level, of in (("first", first), ("second", second)):
                        if carried.get(level) is not None:
                            states |= {k: (n, np.nan if y is None else y) for k, n, y in zip(of, carried[level]["n"], carried[level]["y"])}
                elif starts[0]:
                    if not pieces and told:
                        pieces.append(piece())
                    begun = {}
                bars = {k: block.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("high", "low", "close")}
                made = _inputs(names, bars, before, starts)
                for level, hows in ((first, FIRST), (second, SECOND)):
                    smoothed = {}
                    for k in level:
                        x = made[_SOURCE.get(k, k)]
                        smoothed[k], *state = smooth(x, starts, hows[k], *states.get(k, (0, np.nan)))
                        states[k] = tuple(state)
                        if k in told and k not in begun and not np.isnan(x).all():
                            begun[k] = float(x[np.flatnonzero(~np.isnan(x))[0]])
                    made = _made(names, smoothed) if level is first else made | smoothed
                symbol, before = block.column("symbol")[-1].as_py(), tuple(bars[k][-1] for k in ("high", "low", "close"))
                if not told:
                    if "macd_signal" in made:
                        made["macd_hist"] = made["macd"] - made["macd_signal"]
                    new = [pa.array(made[c], mask=~np.isfinite(made[c])) for c in columns]
                    yield pa.RecordBatch.from_arrays([*(block.column(c) for c in CORE), *new], names=[*CORE, *columns])
        if told and number is not None:
            pieces.append(piece())
            kinds = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names=["symbol", RANGE, "n", "first", "y"])

    return kernel


def _carry(pieces: DataFrame, hows: list[Smoothing], name: str) -> DataFrame:
    """(symbol, RANGE, name): the states before each range that goes on with a symbol."""

    def compose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(RANGE)
        states, out = [(0, np.nan)] * len(hows), []
        for at, n, first, y in zip(f[RANGE], f["n"], f["first"], f["y"]):
            out.append((f["symbol"].iloc[0], at, [s[0] for s in states], [s[1] if s[0] else None for s in states]))
            states = [joined(s, p, h) for s, p, h in zip(states, zip(n, first, y), hows)]
        rows = out[1:]
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(("symbol", RANGE, "n", "y"))})

    # Each range tells of its two ends, so a group has as many rows as there are ranges of one symbol.
    found = pieces.groupBy("symbol").applyInPandas(compose, f"symbol string, {RANGE} int, n array<long>, y array<double>")
    return found.select("symbol", RANGE, F.struct("n", "y").alias(name))


def smoothed(market: DataFrame, wanted: tuple[str, ...] = SMOOTHED) -> DataFrame:
    """Core columns of market with the recursive indicators `wanted`, and no others computed."""
    names = {n for w in wanted for n in NEEDS[w]}
    trend = [c for c in wanted if c.startswith("supertrend")]
    columns = [c for c in wanted if c not in trend] + (["band_atr"] if trend else [])
    at = ("symbol",)
    bars = ranges.dealt(market.select(*CORE), at, ("timestamp",))
    ends = bars.groupBy(*at, RANGE).agg(F.max_by(F.struct("high", "low", "close"), "timestamp").alias("bar"))
    rows = ranges.met(bars, ranges.carried(ends, at, __bar=F.last("bar").over(ranges.earlier(at))), at)
    pieces = f"symbol string, {RANGE} int, n array<long>, first array<double>, y array<double>"
    for level, hows in (("first", FIRST), ("second", SECOND)):
        of = sorted(names & set(hows))
        if of:
            told = rows.mapInArrow(_scan(names, [], level), pieces)
            rows = ranges.met(rows, workdir.written(_carry(told, [hows[k] for k in of], f"__{level}")), at)
    out = rows.mapInArrow(_scan(names, columns, "rows"), "timestamp timestamp_ntz, symbol string, open double, high double, low double, close double, volume double, " + ", ".join(f"{c} double" for c in columns))
    return _trended(out, trend) if trend else out


def _trend(multiplier: float = 3.0) -> Callable:
    """Kernel over bars by symbol and time, a batch at a time: SuperTrend's line and direction out of band_atr."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, way, top, floor, was = None, 0, np.nan, np.nan, np.nan
        for f in frames:
            lines, ways = [], []
            for s, high, low, close, atr in zip(f["symbol"], f["high"], f["low"], f["close"], f["band_atr"]):
                if s != symbol:
                    symbol, way, top, floor, was = s, 0, np.nan, np.nan, np.nan
                if atr != atr:
                    lines.append(np.nan)
                    ways.append(0)
                else:
                    # Bands only tighten while closes stay inside; the trend flips where a close crosses the opposite band.
                    mid = (high + low) / 2.0
                    upper, lower = mid + multiplier * atr, mid - multiplier * atr
                    if way == 0:
                        way = 1 if close >= lower else -1
                    else:
                        upper = upper if upper < top or was > top else top
                        lower = lower if lower > floor or was < floor else floor
                        way = 1 if way < 0 and close > upper else -1 if way > 0 and close < lower else way
                    top, floor = upper, lower
                    lines.append(lower if way > 0 else upper)
                    ways.append(way)
                was = close
            yield f.assign(supertrend_10_3=lines, supertrend_direction_10_3=np.array(ways, "int32"))

    return kernel


def _trended(rows: DataFrame, wanted: list[str]) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ordered = rows.repartition("symbol").sortWithinPartitions("symbol", "timestamp")
    made = ordered.mapInPandas(_trend(), f"{fields}, supertrend_10_3 double, supertrend_direction_10_3 int")
    # What pandas gives back as NaN is NULL again.
    made = made.withColumns({c: finite(c) for c, kind in made.dtypes if kind == "double"})
    return made.select(*(c for c in rows.columns if c != "band_atr"), *wanted)


# What rolls over smoothed values.
_ROLLED = {"atr_percent_14": "atr_14", "stoch_rsi_k_14": "rsi_14", "stoch_rsi_d_14": "rsi_14"}


def panel(market: DataFrame, indicators: tuple[str, ...] = INDICATORS) -> DataFrame:
    """Core columns of market with the indicators asked for."""
    w = series()
    wanted = {_ROLLED.get(c, c) for c in indicators} & set(SMOOTHED)
    d = smoothed(market, tuple(c for c in SMOOTHED if c in wanted)) if wanted else market.select(*CORE)
    d = d.withColumns({c: F.lit(None).cast("double") for c in ("rsi_14", "atr_14") if c not in wanted})  # for what nobody asks
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    change = F.col("close") - F.lag("close").over(w)
    d = d.withColumns({"tp": typical, "flow": typical * F.col("volume"), "signed": F.coalesce(F.signum(change) * F.col("volume"), F.lit(0.0))})
    d = d.withColumn("tp_change", F.col("tp") - F.lag("tp").over(w))
    d = d.withColumns({"up_flow": F.when(F.col("tp_change") > 0, F.col("flow")).otherwise(0.0), "down_flow": F.when(F.col("tp_change") < 0, F.col("flow")).otherwise(0.0)})
    mid, spread = rolling(F.avg, "close", 20, 10), rolling(F.stddev_pop, "close", 20, 10)
    top, bottom = rolling(F.max, "high", 20, 10), rolling(F.min, "low", 20, 10)
    lowest, highest = rolling(F.min, "rsi_14", 14, 14), rolling(F.max, "rsi_14", 14, 14)
    d = d.withColumns(
        {
            "sma_20": mid, "sma_50": rolling(F.avg, "close", 50, 20), "bb_mid_20": mid, "bb_upper_20": mid + 2.0 * spread, "bb_lower_20": mid - 2.0 * spread,
            "bb_percent_b_20": div(F.col("close") - (mid - 2.0 * spread), (mid + 2.0 * spread) - (mid - 2.0 * spread)), "atr_percent_14": div("atr_14", "close"),
            "vwap_20": div(rolling(F.sum, "flow", 20, 5), rolling(F.sum, "volume", 20, 5)), "obv": F.sum("signed").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "mfi_14": _mfi(), "stoch_raw": div(F.col("rsi_14") - lowest, highest - lowest), "donchian_high_20": top, "donchian_low_20": bottom, "donchian_position_20": div(F.col("close") - bottom, top - bottom),
        }
    )
    d = d.withColumns({"obv_slope_20": F.col("obv") - F.lag("obv", 20).over(w), "stoch_rsi_k_14": rolling(F.avg, "stoch_raw", 3, 1)})
    d = d.withColumn("stoch_rsi_d_14", rolling(F.avg, "stoch_rsi_k_14", 3, 1))
    return d.select("timestamp", "symbol", "open", "high", "low", "close", "volume", *indicators)


def _mfi() -> Column:
    up, down = rolling(F.sum, "up_flow", 14, 14), rolling(F.sum, "down_flow", 14, 14)
    return F.lit(100.0) - div(F.lit(100.0), F.lit(1.0) + div(up, down))


def _first(*names: str) -> Column:
    return F.coalesce(*(F.col(n) for n in names))


def states(indicators: DataFrame) -> DataFrame:
    """One row per symbol: what its latest bar's indicators say."""
    latest = indicators.filter("close is not null").groupBy("symbol").agg(F.max_by(F.struct(*(F.col(c) for c in indicators.columns if c != "symbol")), "timestamp").alias("b")).select("symbol", "b.*")
    c, e20, e50, e200 = (F.col(x) for x in ("close", "ema_20", "ema_50", "ema_200"))
    align = (
        F.when(c.isNull() | e20.isNull() | e50.isNull(), "UNKNOWN").when((c > e20) & (e20 > e50) & (e50 > e200), "BULL_STACK").when((c < e20) & (e20 < e50) & (e50 < e200), "BEAR_STACK")
        .when((c > e20) & (e20 > e50), "BULL_SETUP").when((c < e20) & (e20 < e50), "BEAR_SETUP").otherwise("MIXED")
    )
    direction, vwap, rsi, hist, adx, atr = (F.col(x) for x in ("supertrend_direction_10_3", "vwap_20", "rsi_14", "macd_hist", "adx_14", "atr_percent_14"))
    slope, mfi, k, pb, position = (F.col(x) for x in ("obv_slope_20", "mfi_14", "stoch_rsi_k_14", "bb_percent_b_20", "donchian_position_20"))
    d = latest.withColumn("ema_alignment", align)
    a = F.col("ema_alignment")
    sign = lambda x, size: F.when(x > 0, size).when(x < 0, -size).otherwise(0.0)
    points = (
        F.when(a == "BULL_STACK", 2.0).when(a == "BULL_SETUP", 1.0).when(a == "BEAR_STACK", -2.0).when(a == "BEAR_SETUP", -1.0).otherwise(0.0)
        + sign(direction, 1.0) + sign(c - vwap, 0.75) + sign(hist, 0.75)
        + F.when((rsi >= 52) & (rsi <= 68), 0.5).when((rsi >= 32) & (rsi <= 48), -0.5).when(rsi >= 78, -0.35).when(rsi <= 22, 0.35).otherwise(0.0)
        + F.when(position >= 0.8, 0.5).when(position <= 0.2, -0.5).otherwise(0.0) + sign(slope, 0.35)
    )
    d = d.withColumn("points", F.when(adx >= 25, points * 1.08).otherwise(points))
    s = F.col("points")
    bias = F.when(s >= 3, "LEAN_LONG").when(s >= 1.5, "WATCH_LONG").when(s <= -3, "LEAN_SHORT").when(s <= -1.5, "WATCH_SHORT").otherwise("NEUTRAL")
    sure = F.least(F.abs(s) / 5.25, F.lit(1.0)) + F.coalesce(clamp((adx - 15.0) / 40.0, 0.0, 0.2), F.lit(0.0))
    up, down = a.isin("BULL_STACK", "BULL_SETUP"), a.isin("BEAR_STACK", "BEAR_SETUP")
    strength = F.when(adx >= 25, "STRONG").otherwise("WEAK")
    or_null = lambda x, test: x.isNull() | test
    d = d.withColumns(
        {
            "technical_bias": bias, "technical_score": F.bround(s, 4), "confidence": clamp(F.when(atr > 0.12, sure * 0.85).otherwise(sure), 0.0, 1.0), "above_vwap": F.coalesce(c >= vwap, F.lit(False)),
            "trend_state": F.when(up & or_null(direction, direction >= 0), F.concat(F.lit("UP_"), strength)).when(down & or_null(direction, direction <= 0), F.concat(F.lit("DOWN_"), strength)).otherwise("MIXED"),
            "momentum_state": F.when(rsi >= 72, "OVERBOUGHT").when(rsi <= 28, "OVERSOLD").when((hist > 0) & or_null(k, k >= 0.5), "RISING").when((hist < 0) & or_null(k, k <= 0.5), "FALLING").otherwise("NEUTRAL"),
            "volatility_state": F.when(atr >= 0.08, "HIGH").when((pb >= 1) | (pb <= 0), "BREAKOUT").otherwise("NORMAL"),
            "volume_state": F.when((slope > 0) & or_null(mfi, mfi >= 50), "CONFIRMING").when((slope < 0) & or_null(mfi, mfi <= 50), "DIVERGING").otherwise("NEUTRAL"),
            "support_level": _first("supertrend_10_3", "vwap_20", "ema_20", "donchian_low_20"), "resistance_level": _first("donchian_high_20", "bb_upper_20", "ema_20"),
        }
    )
    label = F.element_at(F.create_map(*(F.lit(x) for kv in BIAS_LABELS.items() for x in kv)), F.col("technical_bias"))
    said = F.concat_ws("; ", F.concat(F.lit("averages "), a), F.concat(F.lit("trend "), "trend_state"), F.concat(F.lit("momentum "), "momentum_state"), F.when(F.col("above_vwap"), "at or above VWAP").otherwise("below VWAP"))
    d = d.withColumns({"technical_bias_label": label, "interpretation": said, "last_close": c, "supertrend_direction": direction} | {k: F.lit(v) for k, v in TRIGGERS.items()})
    return d.select(*STATE_COLUMNS)


BIAS_LABELS = {"LEAN_LONG": "leans long", "WATCH_LONG": "watch for longs", "LEAN_SHORT": "leans short", "WATCH_SHORT": "watch for shorts", "NEUTRAL": "neutral"}
TRIGGERS = {"trigger_long": "a close above resistance on rising volume", "trigger_short": "a close below support on rising volume", "invalidation_long": "a close below support", "invalidation_short": "a close above resistance"}
STATE_COLUMNS = (
    "timestamp", "symbol", "last_close", "technical_bias", "technical_bias_label", "technical_score", "confidence", "trend_state", "momentum_state", "volatility_state", "volume_state", "ema_alignment", "above_vwap",
    "supertrend_direction", "rsi_14", "macd_hist", "bb_percent_b_20", "atr_percent_14", "vwap_20", "obv_slope_20", "adx_14", "mfi_14", "stoch_rsi_k_14", "donchian_position_20", "support_level", "resistance_level",
    *TRIGGERS, "interpretation",
)
