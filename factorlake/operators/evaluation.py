"""Information coefficients and quantile spreads: all factors and horizons in one job.

The wide panel is unpivoted once; factor and horizon are grouping keys, so no
driver loop runs a job per factor. Ranks pooled over symbols and times come from
ranges and prefix sums, so no task sorts all values of a factor. Rank
correlations are ratios of exact sums, so factors that mirror each other have
the same score to the last bit, and ties go by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.functions import workdir
from factorlake.functions.numerics import correlation, div, doubled_rank, quantile_bucket, rank_correlation
from factorlake.functions.ranks import doubled_ranks, places
from factorlake.operators.factors import long_panel

KEYS = ("horizon", "factor")


def observations(wide: DataFrame, factors: list[str], horizons: tuple[int, ...], min_observations: int = 30) -> DataFrame:
    """(horizon, factor, timestamp, symbol, value, target) of rows with both; factors with too few rows leave."""
    parts = [
        long_panel(wide.select("timestamp", "symbol", *factors, F.col(f"fwd_return_{h}").alias("target")).filter("target is not null"), factors).withColumn("horizon", F.lit(h)) for h in horizons
    ]
    rows = reduce(DataFrame.unionByName, parts)
    # One row for each horizon and factor.
    counts = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_observations)
    return rows.join(F.broadcast(counts), list(KEYS)).select(*KEYS, "timestamp", "symbol", "value", "target", "n")


def _rank_correlations(rows: DataFrame, *keys: str) -> DataFrame:
    ranked = rows.select(*keys, doubled_rank("value", *keys).alias("a"), doubled_rank("target", *keys).alias("b"))
    return ranked.groupBy(*keys).agg(rank_correlation("a", "b").alias("ic"), F.count(F.lit(1)).alias("n"))


def pooled(rows: DataFrame) -> DataFrame:
    ranked = doubled_ranks(rows.select(*KEYS, "value", "target"), KEYS, a="value", b="target")
    return ranked.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("observations"), correlation("value", "target").alias("pooled_pearson"), rank_correlation("a", "b").alias("pooled_spearman"))


def cross_section_ic(rows: DataFrame, min_assets: int = 3) -> DataFrame:
    """(horizon, factor, timestamp, ic, n): rank correlation within each timestamp that has one."""
    return _rank_correlations(rows, *KEYS, "timestamp").filter((F.col("n") >= min_assets) & F.col("ic").isNotNull())


def cross_section_summary(series: DataFrame) -> DataFrame:
    sd = F.stddev_samp("ic")
    return series.groupBy(*KEYS).agg(
        F.avg("ic").alias("cs_ic"), F.when((F.count("ic") > 1) & (sd > 0), div(F.avg("ic"), sd)).alias("ic_ir"), F.avg((F.round("ic", 12) > 0).cast("double")).alias("positive_cross_section_ic_ratio")
    )


def time_series_ic(rows: DataFrame, min_observations: int = 30) -> DataFrame:
    by_symbol = _rank_correlations(rows, *KEYS, "symbol").filter(F.col("n") >= max(20, min_observations // 4))
    return by_symbol.groupBy(*KEYS).agg(F.avg("ic").alias("mean_time_series_ic"))


def quantile_spread(rows: DataFrame) -> DataFrame:
    """Mean target of the top bucket less the bottom one; buckets by first-come ranks."""
    kinds = rows.groupBy(*KEYS).agg(F.least(F.lit(5), F.count_distinct("value")).alias("q"))
    ranked = places(rows, KEYS, ("value", "timestamp", "symbol")).withColumn("r", F.col("before") + 1)
    b = ranked.join(F.broadcast(kinds), list(KEYS)).filter("q >= 2").withColumn("b", quantile_bucket(F.col("r"), F.col("n"), F.col("q")))
    return b.groupBy(*KEYS).agg((F.avg(F.when(F.col("b") == F.col("q") - 1, F.col("target"))) - F.avg(F.when(F.col("b") == 0, F.col("target")))).alias("quantile_spread"))


def evaluate(wide: DataFrame, factors: list[str], horizons: tuple[int, ...], min_observations: int = 30, min_assets: int = 3) -> DataFrame:
    """One row for each horizon and factor with enough observations, by horizon, best score first."""
    rows = observations(wide, factors, horizons, min_observations).persist()
    keys = list(KEYS)
    out = pooled(rows).join(cross_section_summary(cross_section_ic(rows, min_assets)), keys, "left").join(time_series_ic(rows, min_observations), keys, "left").join(quantile_spread(rows), keys, "left")
    spearman = F.col("pooled_spearman")
    out = out.select(
        "factor", "horizon", "observations", "pooled_pearson", "pooled_spearman",
        F.coalesce("cs_ic", "pooled_spearman").alias("mean_cross_section_ic"), "ic_ir", "positive_cross_section_ic_ratio", "mean_time_series_ic", "quantile_spread",
        F.when(spearman >= 0, 1).otherwise(-1).alias("direction"), (F.abs(spearman) * F.sqrt(F.col("observations").cast("double"))).alias("score"),
    ).orderBy("horizon", F.col("score").desc_nulls_last(), "factor")
    # One row for each horizon and factor, which choices, sweeps and reports read again and again.
    found = workdir.written(out)
    rows.unpersist()
    return found


def select_top(evaluation: DataFrame, horizon: int) -> DataFrame:
    """One row: the best score of a horizon, ties by name. Reading it fails where no factor was evaluated at that horizon."""
    best = evaluation.filter(F.col("horizon") == horizon).orderBy(F.col("score").desc_nulls_last(), "factor").limit(1)
    one = best.agg(F.first(F.struct(*best.columns)).alias("best"))
    return one.select(F.coalesce("best", F.raise_error(F.lit(f"no factor was evaluated at horizon {horizon}"))).alias("best")).select("best.*")
