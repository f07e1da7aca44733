"""Folds by doc_id and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod modulus is the remainder; false for a null id, which no label names."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most per_class learning rows of either class, least hash first; and how many rows each class has in all.

    Learning rows are those outside the held-out fold. Of conflicting labels of
    one doc_id the larger counts; of rows that share a doc_id the one with the
    least hash of its text does.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    picked = None
    for c in (0, 1):
        one = rows.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # At most 2 * per_class small rows, so the broadcast is bounded.
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return sample.select("doc_id", "text", "label"), sizes
