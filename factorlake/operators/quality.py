"""Data quality of raw bars: per symbol, as issues and in sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions import ranges, ranks
from factorlake.functions.numerics import div, number
from factorlake.functions.ranges import RANGE
from factorlake.schemas import FREQUENCIES, OHLCV, PRICES

PENALTIES = {"duplicate_timestamps": 1.0, "missing_values": 1.0, "invalid_prices": 1.5, "zero_or_negative_volume": 0.6, "extreme_returns": 0.8, "estimated_missing_bars": 0.5}
ISSUES = {"duplicate_timestamps": "high", "missing_values": "high", "invalid_prices": "high", "zero_or_negative_volume": "medium", "extreme_returns": "medium", "large_time_gaps": "medium", "estimated_missing_bars": "medium"}


def _coerced(raw: DataFrame) -> DataFrame:
    cols = {"timestamp": F.col("timestamp").cast("string").try_cast("timestamp_ntz"), "symbol": F.col("symbol").cast("string")} | {c: number(c) for c in OHLCV}
    return raw.withColumns(cols | {c: F.lit(None).cast("string") for c in ("asset_class", "frequency") if c not in raw.columns})


def _yes(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("long"))


def symbols(raw: DataFrame) -> DataFrame:
    """One row per symbol: counts of each defect, score and status."""
    rows = _coerced(raw)
    o, h, low, c = (F.col(x) for x in PRICES)
    bad = (o <= 0) | (h <= 0) | (low <= 0) | (c <= 0) | (h < F.greatest(o, c)) | (low > F.least(o, c)) | (low > h)
    order = Window.partitionBy("symbol").orderBy("timestamp", *(F.col(x) for x in OHLCV))
    # Returns run over the last known close, as a missing one is carried forward.
    known = F.last("close", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("known", known).withColumn("move", F.abs(div("known", F.lag("known").over(order)) - 1))
    kind = F.first("asset_class", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("limit", F.when(F.lower(kind) == "crypto", 0.6).when(F.lower(kind) == "equity", 0.35).otherwise(0.5))
    base = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
        (F.count(F.lit(1)) - F.count_distinct("timestamp") - F.max(F.col("timestamp").isNull().cast("long"))).alias("duplicate_timestamps"),
        _yes(F.greatest(*(F.col(x).isNull() for x in OHLCV))).alias("missing_values"), _yes(bad).alias("invalid_prices"), _yes(F.col("volume") <= 0).alias("zero_or_negative_volume"),
        _yes(F.col("move") > F.col("limit")).alias("extreme_returns"), F.first("asset_class", ignorenulls=True).alias("asset_class"), F.min("frequency").alias("frequency"),
    )
    out = base.join(gaps(rows), "symbol", "left").fillna(0, ["large_time_gaps", "estimated_missing_bars"])
    penalty = sum((F.col(k) * F.lit(w) for k, w in PENALTIES.items()), F.lit(0.0))
    out = out.withColumn("quality_score", F.greatest(F.lit(0.0), F.lit(1.0) - div(penalty, "rows")))
    return out.withColumn("status", status("quality_score")).drop("asset_class", "frequency")


def steps(rows: DataFrame) -> DataFrame:
    """(symbol, timestamp, frequency, asset_class, step): seconds since the symbol's last distinct time, over ranges, so a long history is in no one task."""
    known = rows.filter("timestamp is not null and symbol is not null").groupBy("symbol", "timestamp").agg(F.min("frequency").alias("frequency"), F.min("asset_class").alias("asset_class"))
    at, by = ("timestamp",), ("symbol",)
    dealt = ranges.dealt(known, by, at)
    last = dealt.groupBy(*by, RANGE).agg(F.max("timestamp").alias("t"))
    carry = ranges.carried(last, by, __before=F.last("t").over(ranges.earlier(by)))
    own = F.lag("timestamp").over(Window.partitionBy(*by, RANGE).orderBy(*at))
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    return ranges.met(dealt.withColumn("__own", own), carry, by).select(*by, *at, "frequency", "asset_class", (seconds(F.col("timestamp")) - seconds(F.coalesce("__own", "__before"))).alias("step"))


def medians(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median) of non-null whole values, exact: counts of distinct values and their places in order, and of these the one or two in the middle."""
    counts = values.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    all_ = counts.groupBy(key).agg(F.sum("c").alias("n"))
    placed = ranks.places(counts, (key,), (value,), "c").join(all_, key)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("c")), F.col(value)))
    return placed.groupBy(key).agg(((holds(low) + holds(high)) / F.lit(2.0)).alias("median"))


def gaps(rows: DataFrame) -> DataFrame:
    """(symbol, large_time_gaps, estimated_missing_bars) over distinct times; the expected step is the frequency's, else the median."""
    found = steps(rows)
    per = found.groupBy("symbol").agg(F.min("frequency").alias("f"), F.min("asset_class").alias("a")).join(medians(found, "symbol", "step"), "symbol", "left")
    expected = F.coalesce(*(F.when(F.col("f") == k, float(v)) for k, v in FREQUENCIES.items()), F.col("median"))
    per = per.withColumn("expected", expected).withColumn("wide", F.when((F.col("a") == "equity") & (F.col("f") == "1d"), 3.2).otherwise(1.8) * F.col("expected"))
    # Counts of distinct steps meet their symbol, not the steps themselves.
    counted = found.filter("step is not null").groupBy("symbol", "step").agg(F.count(F.lit(1)).alias("c")).join(per.select("symbol", "expected", "wide"), "symbol")
    large = F.col("step") > F.col("wide")
    missing = F.greatest(F.lit(0), F.bround(div("step", "expected")) - 1).cast("long")
    return counted.groupBy("symbol").agg(F.sum(F.when(large, F.col("c")).otherwise(0)).alias("large_time_gaps"), F.sum(F.when(large, missing * F.col("c")).otherwise(0)).alias("estimated_missing_bars"))


def status(score: str) -> Column:
    s = F.col(score)
    return F.when(s >= 0.98, "PASS").when(s >= 0.9, "WARN").otherwise("FAIL")


def issues(report: DataFrame) -> DataFrame:
    """(symbol, issue, severity, count) of what a report counts."""
    long = report.select("symbol", *(F.col(k).cast("long").alias(k) for k in ISSUES)).unpivot(["symbol"], list(ISSUES), "issue", "count").filter("count > 0")
    severity = F.when(F.col("issue").isin([k for k, v in ISSUES.items() if v == "high"]), "high").otherwise("medium")
    return long.select("symbol", "issue", severity.alias("severity"), "count")


def summary(report: DataFrame) -> DataFrame:
    """One row: how many symbols, rows and issues, the worst symbol, and the worst status."""
    worst = F.min(F.struct(F.col("quality_score"), F.col("symbol")))
    level = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    counted = sum((F.col(k) for k in ISSUES if k != "large_time_gaps"), F.lit(0))
    g = report.agg(F.count(F.lit(1)).alias("symbol_count"), F.sum("rows").alias("row_count"), F.sum(counted).cast("long").alias("issue_count"), worst.alias("w"), level.alias("l"))
    return g.select("symbol_count", "row_count", "issue_count", F.col("w.symbol").alias("worst_symbol"), F.col("w.quality_score").alias("worst_score"), F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.col("l") + 1).alias("status"))
