"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Each source has a target size: weights share out a total, targets stop at a
multiple of their source's size, and what is over is shared again by weight.
A document's expected copies are target / source size; within a source these
are summed along a fixed order, one offset per source is added, and a document
is taken once for each integer that its stretch of the sum crosses.

All documents of a source expect the same copies, so the prefix sum is
(rank x rate). Ranks come from counts: the order is (size descending, md5 of
doc_id, md5 of text), a cell is (source, size, leading digits of the first md5),
and a document's rank is the count of earlier cells plus its place in its cell. The number of digits follows the row count, so no window holds a whole source,
however large. Ordering by size keeps the taken size within about one document
of its target.

Edge cases: null text has size 0; null source is a source of its own, ordered
last; sources of size 0 have target 0 and nothing is taken; repeated rows are
documents of their own; which of
two rows that agree in doc_id and text comes first is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.llm import session

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2
ROWS_PER_CELL = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """(src, source, source_size, target) of (src, source, source_size): one row per source, so a small table."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    # Water-filling: in order of cap / weight, the first source whose cap is above its share of the rest fixes the level.
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    total = F.sum("source_size").over(everyone)
    level = (F.lit(share) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    t = sources.withColumn("w", w).withColumn("cap", F.lit(float(ceiling)) * F.col("source_size")).withColumn("level", level)
    t = t.withColumn("least", F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everyone)["level"])
    target = F.when(F.col("least").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("least")))
    return t.select("src", "source", "source_size", target.alias("target"))


def offset(src: Column) -> Column:
    """In [0, 1): 32 bits of the md5 of the source, the same in each run."""
    return F.conv(F.substring(F.md5(src.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Each row of docs as struct `row` (columns `keep`), with size, source_size, target and copies: how often the mix takes it."""
    n = docs.count()
    digits = next((d for d in range(1, 8) if 16**d * rows_per_cell >= n), 8)
    text = F.coalesce(F.col("text"), F.lit(""))
    k1 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep))).alias("row"),
        F.col("source"),
        # A key that is never null, for the joins below.
        F.coalesce(F.concat(F.lit("s:"), "source"), F.lit("null")).alias("src"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.substring(k1, 1, digits).alias("cell"),
        k1.alias("k1"),
        F.md5(text.cast("binary")).alias("k2"),
    )
    cells = session.cut(rows.groupBy("src", "source", "size", "cell").agg(F.count(F.lit(1)).alias("n")))
    per_size = cells.groupBy("src", "source", "size").agg(F.sum("n").alias("n"))
    sums = per_size.groupBy("src", "source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    per_source = targets(sums, weights, share, ceiling)
    before = (Window.unboundedPreceding, -1)
    in_size = F.coalesce(F.sum("n").over(Window.partitionBy("src", "size").orderBy("cell").rowsBetween(*before)), F.lit(0))
    larger = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy(F.col("size").desc()).rowsBetween(*before)), F.lit(0))
    sizes = per_size.select("src", "size", larger.alias("larger"))
    cells = cells.select("src", "size", "cell", in_size.alias("earlier")).join(sizes, ["src", "size"]).select("src", "size", "cell", (F.col("larger") + F.col("earlier")).alias("base"))
    place = F.row_number().over(Window.partitionBy("src", "size", "cell").orderBy("k1", "k2"))
    ranked = rows.drop("source").withColumn("place", place).join(cells, ["src", "size", "cell"])
    rate = F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))
    rank, u = F.col("base") + F.col("place"), F.col("u")
    copies = F.coalesce((F.floor(rate * rank + u) - F.floor(rate * (rank - 1) + u)).cast("long"), F.lit(0).cast("long"))
    per_source = per_source.withColumn("u", offset(F.col("src"))).drop("source")
    return ranked.join(per_source, "src").select("row", "size", "source_size", "target", copies.alias("copies"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it."""
    out = mix(docs).filter("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s:' || source, 'null') AS src, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT src, source, sum(size)::BIGINT AS source_size FROM d GROUP BY src, source),
w AS (SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS DOUBLE) AS w,
             2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, (SELECT arg_min(level, cap / w) FROM l WHERE cap > w * level) AS least FROM l),
g AS (SELECT src, source_size, CASE WHEN least IS NULL THEN cap ELSE least(cap, w * least) END AS target,
             CAST(('0x' || substr(md5(src), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM t),
r AS (SELECT d.*, row_number() OVER (PARTITION BY src ORDER BY size DESC, md5(coalesce(doc_id::VARCHAR, 'null')), md5(t)) AS k FROM d)
SELECT doc_id, size, source_size, target,
       (size * coalesce(floor(target / nullif(source_size, 0) * k + u) - floor(target / nullif(source_size, 0) * (k - 1) + u), 0))::BIGINT AS taken
FROM r JOIN g USING (src)
"""
