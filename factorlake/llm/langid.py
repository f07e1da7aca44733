"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of 2- and 3-grams of code points (A-Z lower-cased) in 65,536 buckets come from
every learning row, summed by Spark for each language. The smoothed
log-probability matrix (buckets x languages) is broadcast; scoring gathers its
rows for all n-grams of a batch and sums them by text. Over GROUP languages take
turns: a matrix of GROUP languages at a time is on the driver and broadcast, and each
text carries its best language and the mass of all so far to the next turn. So memory
does not follow the number of languages; the texts are written once a turn.

Edge cases: null texts and texts without a letter are `und` with score 0, and
so is everything when no row has a language to learn; null lang is not learned
from; ties go to the first language in code point order; texts of any length are
scored whole, in blocks of their own; repeated rows count as often as they stand
and score alike; an empty table gives no rows; extra columns pass in a struct, so
no name of theirs can clash. The names of languages and their numbers of documents
reach the driver, a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.llm import session
from factorlake.llm.bytesblock import blocks, char_grams, utf8
from factorlake.llm.folds import held_out

BITS = 16
FOLD = (4, 2)
SMOOTH = 0.5
LENGTHS = (2, 3)
GROUP = 64  # languages at a time: 16 MB of broadcast, at most 4.2 million sums on the driver


def _buckets(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return char_grams(body, offs, LENGTHS, BITS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for name, s in sums.items():
            at = np.flatnonzero(s)
            # Bucket -1 holds the number of documents.
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(s[at], docs[name]))], names=["lang", "bucket", "n"]
            )
        sums.clear()
        docs.clear()

    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), object)
        body, offs = utf8(batch.column("text"))
        for i, j, b, o in blocks(body, offs):
            grams, count = _buckets(b, o)
            own = lang[i:j]
            for name in sorted(set(own.tolist())):
                if len(sums) >= GROUP and name not in sums:
                    yield from told()
                mine = own == name
                sums.setdefault(name, np.zeros(1 << BITS, np.int64))
                sums[name] += np.bincount(grams[np.repeat(mine, count)], minlength=1 << BITS)
                docs[name] = docs.get(name, 0) + int(mine.sum())
    yield from told()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) of (text, lang) rows, written; bucket -1 has the number of documents."""
    return session.cut(docs.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def languages(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """(names by code point, log priors)."""
    of = {r["lang"]: r["n"] for r in counts.filter("bucket = -1").collect()}
    names = sorted(of)
    prior = np.array([of[n] for n in names], float)
    return names, np.log(prior / max(prior.sum(), 1))


def matrix_of(counts: DataFrame, names: list[str]) -> np.ndarray:
    """Smoothed log probabilities, buckets x names."""
    own = counts.filter(F.col("lang").isin(names) & (F.col("bucket") >= 0)).toArrow()
    at = {n: k for k, n in enumerate(names)}
    column = np.array([at[x] for x in own.column("lang").to_pylist()], np.int64)
    matrix = np.full((1 << BITS, len(names)), SMOOTH)
    matrix[own.column("bucket").to_numpy(), column] += own.column("n").to_numpy()
    return np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def _turn(shared, names: list[str], prior: np.ndarray):
    """Kernel of one turn: the best of names and of what the row brings, and the mass of all in units of the best."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.float32).reshape(-1, len(names))
        limit = max(1 << 14, (1 << 21) // len(names))
        for batch in batches:
            texts = batch.column("text")
            able = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            body, offs = utf8(texts)
            best, top, mass = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, j, b, o in blocks(body, offs, limit):
                grams, count = _buckets(b, o)
                total = np.tile(prior, (j - i, 1))
                full = np.flatnonzero(count)
                if len(full):
                    starts = (np.cumsum(count) - count)[full]
                    for k in range(len(names)):
                        total[full, k] += np.add.reduceat(table[grams, k].astype(np.float64), starts)
                best[i:j] = total.argmax(axis=1)
                top[i:j] = total.max(axis=1)
                mass[i:j] = np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            old = batch.column("top").to_numpy(zero_copy_only=False)
            wins = top > old  # at a tie the earlier language stays
            most = np.maximum(top, old)
            mass = mass * np.exp(top - most) + batch.column("mass").to_numpy(zero_copy_only=False) * np.exp(old - most)
            pred = np.where(able, np.where(wins, np.array(names, object)[best], np.array(batch.column("lang_pred").to_pylist(), object)), None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), texts, pa.array(pred, pa.string()), pa.array(most), pa.array(mass)], names=["row", "text", "lang_pred", "top", "mass"])

    return kernel


def predict(docs: DataFrame, learn: DataFrame, keep: list[str], text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Struct `row` of columns `keep` of each row of docs, with lang_pred and score; learn has (text, lang)."""
    counts = counted(learn.select(F.coalesce("text", F.lit("")).alias("text"), "lang").filter("lang is not null"))
    names, prior = languages(counts)
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("mass"),
    )
    for at in range(0, len(names), group):
        own = names[at : at + group]
        shared = docs.sparkSession.sparkContext.broadcast(matrix_of(counts, own).tobytes())
        rows = rows.mapInArrow(_turn(shared, own, prior[at : at + group]), rows.schema)
        if at + group < len(names):
            rows = session.cut(rows)
            shared.unpersist()
    known = F.col("lang_pred").isNotNull()
    return rows.select("row", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.when(known, 1.0 / F.col("mass")).otherwise(0.0).alias("score"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.table(spark, sf_dir, "documents")
    fold = held_out(F.col("doc_id"), *FOLD)
    out = predict(docs, docs.filter(~fold), ["doc_id"])
    return out.select("row.doc_id", held_out(F.col("row.doc_id"), *FOLD).alias("held_out"), "lang_pred", "score")
