"""Signal radar: where each symbol's factors stand in their own history, weighed by how the factor did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions.numerics import clamp
from factorlake.operators.factors import long_panel

THEMES = {"mom_": "trend", "ma_gap_": "trend", "range_position_": "trend", "reversal_": "reversal", "volume_": "volume", "amihud_": "liquidity", "volatility_": "volatility", "ml_": "machine learning"}
COLUMNS = (
    "timestamp", "symbol", "factor", "theme", "value", "percentile", "signal", "signal_label", "setup", "direction", "direction_label", "confidence", "confidence_label", "signal_score", "sharpe", "score", "total_return",
    "max_drawdown", "win_rate", "horizon", "interpretation",
)


def best_backtests(backtests: DataFrame) -> DataFrame:
    """The best row of each factor without an error."""
    ok = backtests.filter("error is null or error = ''")
    order = Window.partitionBy("factor").orderBy(F.col("sharpe").desc_nulls_last(), F.col("score").desc_nulls_last(), "horizon")
    return ok.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def confidence() -> Column:
    some = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    sharpe = clamp(some("sharpe", 0.0) / 3.0, 0.0, 1.0)
    score = clamp(F.abs(some("score", 0.0)) / 5.0, 0.0, 1.0)
    win = F.coalesce(clamp((F.col("win_rate") - 0.45) / 0.25, 0.0, 1.0), F.lit(0.5))
    drawdown = F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.abs(some("max_drawdown", 0.0)) / 0.35, F.lit(1.0)))
    return clamp(0.45 * sharpe + 0.25 * score + 0.2 * win + 0.1 * drawdown, 0.0, 1.0)


def radar(wide: DataFrame, factors: list[str], backtests: DataFrame, min_history: int = 20, limit: int = 8) -> DataFrame:
    """The `limit` strongest signals of each symbol; a limit of 0 keeps all."""
    long = long_panel(wide.select("timestamp", "symbol", *factors), factors)
    keys = ("symbol", "factor")
    # The latest value's rank is a count of smaller and equal ones: no history is sorted.
    last = long.groupBy(*keys).agg(F.max_by(F.struct("timestamp", "value"), "timestamp").alias("b"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_history)
    met = long.select(*keys, F.col("value").alias("x")).join(last, list(keys))
    rank = F.sum((F.col("x") < F.col("b.value")).cast("long")) + (F.sum((F.col("x") == F.col("b.value")).cast("long")) + 1) / F.lit(2.0)
    latest = met.groupBy(*keys, "b", "n").agg(rank.alias("r")).select(*keys, "b.*", "r", "n")
    d = latest.withColumn("percentile", F.col("r") / F.col("n")).join(best_backtests(backtests).select("factor", "direction", "sharpe", "score", "total_return", "max_drawdown", "win_rate", "horizon"), "factor")
    p, up = F.col("percentile"), F.col("direction") >= 0
    side = F.when(up, F.when(p >= 0.8, "BULLISH").when(p <= 0.2, "BEARISH")).otherwise(F.when(p <= 0.2, "BULLISH").when(p >= 0.8, "BEARISH"))
    theme = F.coalesce(*(F.when(F.startswith("factor", F.lit(k)), v) for k, v in THEMES.items()), F.lit("other"))
    d = d.withColumns({"signal": F.coalesce(side, F.lit("NEUTRAL")), "confidence": confidence(), "theme": theme})
    d = d.withColumns(
        {
            "signal_label": F.lower("signal"), "setup": F.when(p >= 0.8, "high in its history").when(p <= 0.2, "low in its history").otherwise("mid-range"), "direction_label": F.when(up, "high_value_bullish").otherwise("low_value_bullish"),
            "confidence_label": F.when(F.col("confidence") >= 0.7, "high").when(F.col("confidence") >= 0.4, "medium").otherwise("low"),
            "signal_score": F.abs(p - 0.5) * 2.0 * F.col("confidence") * F.when(F.col("signal") == "NEUTRAL", 0.45).otherwise(1.0),
        }
    )
    said = F.format_string("%s; at %.0f%% of its history, %s, confidence %s", F.col("signal_label"), p * 100, F.when(up, "high values favour returns").otherwise("low values favour returns"), F.col("confidence_label"))
    d = d.withColumn("interpretation", said)
    if limit > 0:
        order = Window.partitionBy("symbol").orderBy(F.col("signal_score").desc_nulls_last(), F.col("confidence").desc_nulls_last(), F.col("sharpe").desc_nulls_last(), "factor")
        d = d.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= limit)
    return d.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), *COLUMNS[1:])
