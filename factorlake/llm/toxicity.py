"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed 4- and 6-grams of code points, A-Z lower-cased, a
blank at both ends; an n-gram that occurs twice, and one that occurs four times, are
features of their own, as a word that clean texts hold once by chance may mark a
text that repeats it. On a bounded sample of labelled rows the log ratio of document
counts in either class is taken for each n-gram; n-grams whose ratio is not clear
of chance leave. A logistic regression is fitted on the indicator times its ratio,
the sample reweighted to the classes' true shares: the sample's rows stay in Spark
as packed blocks, each step's risk and gradient are sums over them, and the driver
holds numbers by clear n-gram only. Texts are scored whole. LENGTHS, LEVELS, CLEAR
and PENALTY were chosen by cross-validation within the learning rows, never on the
held-out fold.

Edge cases: null and empty texts score as a text without any known n-gram;
without rows of both classes every score is 0; texts of any length are scored in
one pass and are a block of their own; rows are independent, so ties and repeated
rows do not matter to scores, and of rows that share a doc_id one is learned from;
an empty table gives no rows; extra columns are not read, and pass through `score`
in a struct, so no name of theirs can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.llm import session
from factorlake.llm.bytesblock import blocks, char_grams, utf8
from factorlake.llm.folds import held_out, labelled
from factorlake.llm.linear import lbfgs, total

LENGTHS = (4, 6)  # short ones meet inflections, long ones whole words of common parts
LEVELS = (1, 2, 4)  # occurrences
BITS = 22
PER_CLASS = 6000  # bound of the sample, rows of either class
CLEAR = 3.0  # standard errors
PENALTY = 3e-5
PARTS = 6  # of the sample, whose rows are bounded: a step sends the driver one gradient of each
FOLD = (3, 1)
CUT = 0.7


_MASK = (1 << BITS) - 1
_ODD = 2654435761  # invertible modulo a power of two


def _level(bucket: np.ndarray, k: int) -> np.ndarray:
    """The bucket of an n-gram's k-th level; one to one."""
    return (bucket * pow(_ODD, k, 1 << BITS) + 77 * k) & _MASK


def _base(bucket: np.ndarray) -> np.ndarray:
    """For each n-gram's bucket whether one of its levels is in `bucket`."""
    out = np.zeros(1 << BITS, bool)
    for k in range(len(LEVELS)):
        out[((bucket - 77 * k) * pow(_ODD, -k, 1 << BITS)) & _MASK] = True
    return out


def _sets(body: np.ndarray, offs: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
    """Sorted text << BITS | bucket of the features of a block's texts, of those n-grams only that base marks."""
    grams, count = char_grams(body, offs, LENGTHS, BITS, ends=True)
    if base is None:
        doc = np.repeat(np.arange(len(count)), count)
    else:
        known = np.flatnonzero(base[grams])
        doc, grams = np.searchsorted(np.cumsum(count), known, side="right"), grams[known]
    pair, n = np.unique(doc << BITS | grams, return_counts=True)
    parts = [pair]
    for k, least in enumerate(LEVELS[1:], 1):
        more = pair[n >= least]
        parts.append(more & ~_MASK | _level(more & _MASK, k))
    return np.unique(np.concatenate(parts))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, label, n): how many texts of a class have an n-gram of the bucket."""
    sums = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        label = batch.column("label").to_numpy()
        body, offs = utf8(batch.column("text"))
        for i, j, b, o in blocks(body, offs):
            pair = _sets(b, o)
            for c in (0, 1):
                own, n = np.unique(pair[label[i:j][pair >> BITS] == c] & _MASK, return_counts=True)
                sums[c][own] += n.astype(np.int32)
    for c in (0, 1):
        for at in np.array_split(np.flatnonzero(sums[c]), 32):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), c, np.int32)), pa.array(sums[c][at].astype(np.int64))], names=["bucket", "label", "n"])


def _packed(bucket: np.ndarray):
    """Kernel: blocks of texts -> labels, how many clear n-grams each text has, and their places in bucket."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, clear = _base(bucket), np.zeros(1 << BITS, bool)
        clear[bucket] = True
        for batch in batches:
            body, offs = utf8(batch.column("text"))
            label = batch.column("label").to_numpy()
            for i, j, b, o in blocks(body, offs):
                pair = _sets(b, o, base)
                pair = pair[clear[pair & _MASK]]
                size = np.bincount(pair >> BITS, minlength=j - i).astype(np.int32)
                place = np.searchsorted(bucket, pair & _MASK).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (label[i:j].astype(np.int8), size, place)], names=["label", "size", "place"])

    return kernel


def logistic(label: np.ndarray, size: np.ndarray, place: np.ndarray, scale: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Weighted log loss of some rows and its gradient, end to end; a row is the set of its places, an entry worth scale, the last coefficient the intercept."""
    row = np.repeat(np.arange(len(size)), size)
    z = np.bincount(row, (scale * beta[:-1])[place], len(size)) + beta[-1]
    w = weight[label]
    d = w * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
    return np.concatenate(([(w * (np.logaddexp(0, z) - label * z)).sum()], np.bincount(place, d[row], len(scale)) * scale, [d.sum()]))


def fit(sample: DataFrame, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, ascending, their weights, intercept). Only clear n-grams and sums by them reach the driver."""
    none = np.zeros(0, np.int64), np.zeros(0, np.float32), -40.0
    if not (sizes.get(0) and sizes.get(1)):
        return none
    sample = session.cut(sample.repartition(PARTS).sortWithinPartitions("doc_id"))
    classes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(classes) < 2:
        return none
    n = np.array([classes[0], classes[1]], float)
    counted = sample.mapInArrow(session.tidy(_frequencies), "bucket int, label int, n long").groupBy("bucket").agg(*(F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)))
    # Likelihood-ratio statistic of the two counts against the classes' sizes; sound for zero counts.
    part = lambda c: F.when(F.col(f"n{c}") > 0, F.col(f"n{c}") * F.log(F.col(f"n{c}") * F.lit(float(n.sum() / n[c])) / (F.col("n0") + F.col("n1")))).otherwise(0.0)
    clear = counted.filter("n0 + n1 >= 4").filter(F.lit(2.0) * (part(0) + part(1)) > CLEAR**2).toArrow().sort_by("bucket")
    bucket, df = clear.column("bucket").to_numpy().astype(np.int64), [clear.column(f"n{c}").to_numpy().astype(float) for c in (0, 1)]
    scale = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
    packed = session.cut(sample.mapInArrow(_packed(bucket), "label binary, size binary, place binary"))
    weight = np.array([sizes[0], sizes[1]], float) / sum(sizes.values()) / n

    def risk(beta: np.ndarray) -> tuple[float, np.ndarray]:
        of = lambda a, b, c: logistic(np.frombuffer(a, np.int8), np.frombuffer(b, np.int32), np.frombuffer(c, np.int32), scale, weight, beta)
        s = total(packed, of, len(scale) + 2)
        held = PENALTY * np.append(beta[:-1], 0.0)
        return s[0] + held @ beta / 2, s[1:] + held

    beta = lbfgs(risk, np.append(np.zeros(len(scale)), np.log(sizes[1] / sizes[0])))
    return bucket, (beta[:-1] * scale).astype(np.float32), float(beta[-1])


def _scorer(bucket: np.ndarray, weights: np.ndarray, bias: float, with_text: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, table = _base(bucket), np.zeros(1 << BITS, np.float32)
        table[bucket] = weights
        for batch in batches:
            body, offs = utf8(batch.column("text"))
            scores = np.zeros(batch.num_rows)
            for i, j, b, o in blocks(body, offs):
                pair = _sets(b, o, base)
                scores[i:j] = np.bincount(pair >> BITS, table[pair & _MASK], j - i)
            scores = 1 / (1 + np.exp(-np.clip(scores + bias, -40, 40)))
            rest = [n for n in batch.schema.names if with_text or n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(scores)], names=[*rest, "score"])

    return kernel


def score(docs: DataFrame, labels: DataFrame, keep: list[str], text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Struct `row` of columns `keep` of each row of docs, its text if asked for, and its score."""
    sample, sizes = labelled(docs.select("doc_id", F.col(text_col).alias("text")), labels, "toxic", *FOLD, PER_CLASS)
    model = fit(sample, sizes)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(session.tidy(_scorer(*model, with_text)), f"row {kind}, {'text string, ' if with_text else ''}score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(session.table(spark, sf_dir, "documents"), session.table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("row.doc_id", held_out(F.col("row.doc_id"), *FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score is under the cut."""
    rest = [c for c in docs.columns if c != "text"]
    out = score(docs, session.table(spark, sf_dir, "labels"), rest, with_text=True).filter(F.col("score") < CUT)
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
