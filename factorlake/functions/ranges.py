"""Rows dealt to ranges in order, and what a range has to know of those before it.

A window over one key puts all of that key's rows into one task. Where a value
follows from the rows before it by something that can be put together piece by piece (a
last value, a product, a maximum, a linear recurrence), each range works on its
own rows, and a table with one row for each piece carries the rest over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions import workdir

#: Number of the range, in order of (keys, order).
RANGE = "__range"


def dealt(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """rows in ranges of (keys, order), one a partition and sorted, with RANGE.

    Ranges are cut from a sample, so they are written down: made anew they could lie elsewhere.
    """
    workdir.shared_dir(rows.sparkSession)
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return ordered.withColumn(RANGE, F.spark_partition_id()).checkpoint()


def earlier(keys: tuple[str, ...]):
    """Window over a key's earlier ranges, for tables with one row for each key and range."""
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def own(keys: tuple[str, ...], order: tuple[str, ...]):
    """Window over a row's own range up to the row."""
    return Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def carried(pieces: DataFrame, keys: tuple[str, ...], **columns: Column) -> DataFrame:
    """(keys, RANGE, columns) of pieces (one row for each key and range) that continue an earlier range's key; columns are over earlier(keys).

    Only the first key of a range can, so there is one row a range at most and the result may be broadcast.
    """
    seen = F.count(F.lit(1)).over(earlier(keys))
    return pieces.select(*keys, RANGE, *(c.alias(n) for n, c in columns.items()), seen.alias("__seen")).filter("__seen > 0").drop("__seen")


def met(rows: DataFrame, carry: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows with the carried columns, null where nothing is carried."""
    return rows.join(F.broadcast(carry), [*keys, RANGE], "left")
