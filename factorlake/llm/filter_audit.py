"""Filter interaction audit: what five filters remove in every order, from counts of failure masks.

Texts are sorted once, over ranges: rows are dealt by (fingerprint, doc_id) and each
range is sorted by (fingerprint, full text, doc_id). The ranges' bounds come from a sample of
keys that goes to the driver, so the text itself is no range key; equal
texts have equal fingerprints and stay neighbours. A range is read in order, and
each row is compared with its predecessor: of equal texts the least doc_id is
carried along. Boundaries: the runs of a range's first and last fingerprint are
told to all by their texts, and the least doc_id over the ranges that a text
spans corrects the rows of the first run. A text that holds a third of all rows
is spread over many ranges.

The same pass judges each text once (copies share the result) and gives five
bits to each document. Counters of (part, mask) add up over tasks; all
orders follow from at most 32 counters of each part, as a document is removed by the
first failing filter of an order.

Edge cases: null text is empty; a null source is the part ''; a null doc_id is no
copy and nothing is a copy of it; rows that share doc_id and text are not
copies of each other; several labels of a document: any 1 counts; long texts are
judged whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.llm import session

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # distinct words in a hundred
MOST_CAPITALS = 5  # capitals in a hundred code points
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = re.compile(rb"[#$%&*|]")
_ROW, _HEAD, _TAIL = range(3)
_JUDGED = "kind int, pid int, run int, fp long, text string, doc_id long, least long, part string, mask int"


def failures(raw: bytes, points: int) -> int:
    """Bits 1, 2, 4, 8 for the filters A, B, C, D that a text of so many code points fails."""
    words = raw.split()  # at bytes 9 to 13 and 32
    n = len(words)
    return (
        (n < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1
        | (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > MOST_CAPITALS * points) << 2
        | (_SIGNS.search(raw) is not None) << 3
    )


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range in order of (fp, text, doc_id): a row for each document, then marks of the runs at both ends."""
    pid = TaskContext.get().partitionId()
    heads: list[tuple] | None = None  # runs of the first fingerprint, once it is over
    runs: list[list] = []  # runs of the present one: fp, text, least doc_id
    raw, fp, mask, least = None, None, 0, None
    for batch in batches:
        points = pc.utf8_length(batch.column("text")).to_pylist()
        masks, leasts, numbers = [], [], []
        for f, text, doc_id, n in zip(batch.column("fp").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("doc_id").to_pylist(), points):
            if f != fp or text != raw:
                if f != fp:
                    if fp is not None and heads is None:
                        heads = runs
                    runs, fp = [], f
                raw, mask, least = text, failures(text, n), None
                runs.append([f, text, None])
            if least is None and doc_id is not None:  # nulls stand first
                least = runs[-1][2] = doc_id
            masks.append(mask)
            leasts.append(least)
            numbers.append(len(runs) - 1 if heads is None else -1)
        size = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([_ROW] * size, pa.int32()), pa.array([pid] * size, pa.int32()), pa.array(numbers, pa.int32()), batch.column("fp"), pa.nulls(size, pa.string()), batch.column("doc_id"), pa.array(leasts, pa.int64()),
                batch.column("part"), pa.array(masks, pa.int32()),
            ],
            names=_NAMES,
        )
    marks = [(kind, pid, k, f, text.decode(), None, low, None, None) for kind, of in ((_HEAD, runs if heads is None else heads), (_TAIL, runs)) for k, (f, text, low) in enumerate(of)]
    if marks:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*marks), _TYPES)], names=_NAMES)


_NAMES = [f.split()[0] for f in _JUDGED.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in _JUDGED.split(", ")]


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of each row of (doc_id, text, source)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("fp"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    ordered = rows.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    # Ranges are cut from a sample: made anew they could lie elsewhere, so what is judged is written.
    judged = session.cut(ordered.mapInArrow(_judge, _JUDGED))
    marks = judged.filter(F.col("kind") != _ROW)
    first = marks.groupBy("fp", "text").agg(F.min("least").alias("earliest"))
    heads = marks.filter(F.col("kind") == _HEAD).join(first, ["fp", "text"]).select("pid", "run", "earliest")
    # A head for each range, unless unlike texts share a fingerprint: as many rows as there are tasks.
    found = judged.filter(F.col("kind") == _ROW).join(F.broadcast(heads), ["pid", "run"], "left")
    copy = F.coalesce(F.col("doc_id") > F.least("earliest", "least"), F.lit(False))
    return found.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"))


def counters(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, counts): at most 32 structs of mask, documents, those labelled good and those labelled toxic."""
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    added = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    per_mask = masked.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), added("good").alias("good"), added("toxic").alias("toxic"))
    return per_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step, from (doc_id, text, source) and (doc_id, quality, toxic)."""
    steps = counters(masks(docs), labels).withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    bit = "shiftleft(1, ascii(substr(filter_order, {}, 1)) - 65)"
    steps = steps.withColumns({"own": F.expr(bit.format("step")), "through": F.expr(f"aggregate(sequence(1, step), 0, (a, k) -> a | {bit.format('k')})")}).withColumn("before", F.expr("through ^ own"))
    total = lambda test, of="c.n": F.expr(f"aggregate(filter(counts, c -> {test}), 0L, (a, c) -> a + {of})")
    fails, lost = "c.mask & own <> 0", "c.mask & own <> 0 AND c.mask & before = 0"
    return steps.select(
        "part", "filter_order", "step", total("c.mask & through = 0").alias("kept"), total(lost).alias("removed"), total(f"{fails} AND c.mask & before <> 0").alias("redundant"), total("c.mask = own").alias("unique_fails"),
        total(lost, "c.good").alias("good_lost"), total(lost, "c.toxic").alias("toxic_lost"),
        # In 1/k of all orders a filter stands before the other k - 1 that a document fails.
        total(fails, f"c.n * ({len(ORDERS)} div bit_count(c.mask))").alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(docs, session.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


ORACLE = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
k AS (SELECT doc_id, part, CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM k LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT filter_order, s::INT AS step, (1 << (ascii(filter_order[s]) - 65)) AS own, list_sum(list_transform(range(1, s), lambda j: 1 << (ascii(filter_order[j]) - 65))) AS b4
  FROM (VALUES {", ".join(f"('{x}')" for x in ORDERS)}) t(filter_order), range(1, 6) r(s)),
x AS (SELECT c.*, o.filter_order, o.step, o.own, coalesce(o.b4, 0)::BIGINT AS b4, mask & own <> 0 AS fails, mask & coalesce(o.b4, 0)::BIGINT <> 0 AS gone FROM c, o)
SELECT part, filter_order, step, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN fails AND NOT gone THEN bad ELSE 0 END)::BIGINT AS toxic_lost, sum(CASE WHEN fails THEN n * (120 // bit_count(mask::INT)) ELSE 0 END)::BIGINT AS shapley
FROM x GROUP BY ALL"""
