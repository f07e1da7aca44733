"""Operator factors and forward returns, all over one window specification, so one sort serves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.functions.numerics import div, finite, rolling, series

DESCRIPTIONS = {
    "return_1": "one-bar return",
    "mom": "return over the window",
    "reversal": "negative return over the window",
    "volatility": "standard deviation of one-bar returns",
    "ma_gap": "close against its moving average",
    "volume_zscore": "volume in standard deviations from its mean",
    "range_position": "close within the window's range",
    "amihud": "mean absolute return per unit of volume",
}


def least_periods(window: int) -> int:
    return max(2, min(window, max(3, window // 2)))


def names(windows: list[int]) -> list[str]:
    return ["return_1", *(f"{k}_{w}" for w in windows if w > 1 for k in list(DESCRIPTIONS)[1:])]


def factor_columns(windows: list[int]) -> dict[str, Column]:
    """Expressions by factor name, over a frame with return_1 and amihud_1."""
    out: dict[str, Column] = {}
    for w in windows:
        if w <= 1:
            continue
        mp = least_periods(w)
        mom = div("close", F.lag("close", w).over(series())) - 1
        low, high = rolling(F.min, "low", w, mp), rolling(F.max, "high", w, mp)
        mean, spread = rolling(F.avg, "volume", w, mp), rolling(F.stddev_pop, "volume", w, mp)
        out |= {
            f"mom_{w}": mom,
            f"reversal_{w}": -mom,
            f"volatility_{w}": rolling(F.stddev_pop, "return_1", w, mp),
            f"ma_gap_{w}": div("close", rolling(F.avg, "close", w, mp)) - 1,
            f"volume_zscore_{w}": div(F.col("volume") - mean, spread),
            f"range_position_{w}": div(F.col("close") - low, high - low),
            f"amihud_{w}": rolling(F.avg, "amihud_1", w, mp),
        }
    return {k: finite(v) for k, v in out.items()}


def with_returns(market: DataFrame) -> DataFrame:
    out = market.withColumn("return_1", finite(div("close", F.lag("close").over(series())) - 1))
    return out.withColumn("amihud_1", div(F.abs("return_1"), "volume"))


def panel(market: DataFrame, windows: list[int], horizons: tuple[int, ...] = ()) -> DataFrame:
    """(timestamp, symbol, factors..., fwd_return_h...): one row per bar."""
    if not windows:
        raise ValueError("at least one window is needed")
    made = with_returns(market).withColumns(factor_columns(windows) | {f"fwd_return_{h}": forward_return(h) for h in horizons})
    return made.select("timestamp", "symbol", *names(windows), *(f"fwd_return_{h}" for h in horizons))


def forward_return(h: int) -> Column:
    if h <= 0:
        raise ValueError("a horizon is positive")
    return finite(div(F.lead("close", h).over(series()), "close") - 1)


def forward_returns(market: DataFrame, horizon: int) -> DataFrame:
    return market.select("timestamp", "symbol", forward_return(horizon).alias(f"fwd_return_{horizon}"))


def long_panel(wide: DataFrame, factors: list[str]) -> DataFrame:
    """(timestamp, symbol, factor, value, other columns), without null values."""
    rest = [c for c in wide.columns if c not in factors]
    return wide.unpivot(rest, factors, "factor", "value").filter("value is not null")


def candidates(spark, windows: list[int]) -> DataFrame:
    rows = [(n, "operator", DESCRIPTIONS[n if n == "return_1" else n.rpartition("_")[0]]) for n in names(windows)]
    return spark.createDataFrame(rows, "name string, source string, description string")


def combine(panels: list[DataFrame]) -> DataFrame:
    """Full outer join of panels on (timestamp, symbol)."""
    if not panels:
        raise ValueError("no panel to combine")
    out = panels[0]
    for p in panels[1:]:
        out = out.join(p, ["timestamp", "symbol"], "full_outer")
    return out
