"""Ranks within keys whose groups no task can hold: ranges in order, their totals, and a prefix sum over these.

A window over one key sorts all of its rows in one task. Here rows are dealt to
ranges of (keys, order), each range is summed by itself, and a row's place is
what all earlier ranges of its key hold plus its place in its own range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions import ranges
from factorlake.functions.ranges import RANGE


def places(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], size: str | None = None) -> DataFrame:
    """rows with `before`: how many rows of the same keys (or how much of `size`) come earlier by `order`, which has no nulls and no ties."""
    n = F.lit(1) if size is None else F.col(size)
    dealt = ranges.dealt(rows, keys, order)
    totals = dealt.groupBy(*keys, RANGE).agg(F.sum(n).alias("__n"))
    base = ranges.carried(totals, keys, __base=F.sum("__n").over(ranges.earlier(keys)))
    own = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("__own", F.coalesce(F.sum(n).over(own), F.lit(0)))
    return ranges.met(within, base, keys).withColumn("before", F.coalesce("__base", F.lit(0)) + F.col("__own")).drop(RANGE, "__own", "__base")


def doubled_ranks(rows: DataFrame, keys: tuple[str, ...], **named: str) -> DataFrame:
    """rows with twice their 1-based ranks within keys, ties averaged, so they are whole: each name=column adds one. Ranked columns have no nulls.

    Ranks are of distinct values with their counts, so ties are summed before
    anything moves.
    """
    given = rows
    for name, x in named.items():
        counts = given.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("__c"))
        ranked = places(counts, keys, (x,), "__c").select(*keys, x, (2 * F.col("before") + F.col("__c") + 1).cast("long").alias(name))
        rows = rows.join(ranked, [*keys, x])
    return rows


def average_ranks(rows: DataFrame, keys: tuple[str, ...], **named: str) -> DataFrame:
    """The same as ranks: half of doubled_ranks."""
    return doubled_ranks(rows, keys, **named).withColumns({name: F.col(name) / F.lit(2.0) for name in named})
