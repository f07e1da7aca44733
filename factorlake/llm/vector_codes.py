"""Vector code compression: product codebooks, searched by partial distances.

Components become floor(256 x); a vector is cut into 16 equal consecutive
parts, and each part position has a codebook of 64 entries. It starts as that
part of the 64 smallest vec_ids, and each round assigns every part to its
nearest entry and replaces entries by the floored means of their parts.

The search of a block of vectors takes a part's dimensions in descending
variance of the codebook. It holds (vector, entry) pairs with the distance
accumulated so far, and a complete distance per vector, the best known: that of
the entry which leads after 1, 2, 4 ... dimensions. After each dimension a mask
drops the pairs whose sum strictly exceeds it, so an entry as near as the best
stays and ties still go to the lower index. All is done in integers.

Every row is assigned and counts in the means. A task adds up its own parts and
sends at most one row for each entry; only the codebooks (64 vectors) come to the
driver and go out with the tasks.

Edge cases: vectors null or with null or non-finite components are dropped, and
so is nothing else; a null vec_id comes after all others; rows of one vec_id
are rows of their own, in the order of their components; with fewer than 64 rows the
codebook has as many entries; vectors of unlike length, or of one that 16 doesn't
divide, are compared as if padded with zeros; null labels are one label; an
empty table gives no rows; other columns are not read. Components so large that
a distance would not fit 64 bits raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.llm import session

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of (vec_id, embedding, label): the rows kept, components as floored integers."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    wrong = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = vectors.filter(F.col("embedding").isNotNull()).filter(~wrong)
    large = lambda x: F.abs(F.floor(x * scale)) >= F.lit(float(2**31))
    v = F.when(F.exists(e, large), F.raise_error(F.lit("a component is too large for integer distances"))).otherwise(F.transform(e, lambda x: F.floor(x * scale)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row of x's nearest row of book, ties to the lower index, by partial distances."""
    n, width = x.shape
    order = np.argsort(-book.var(axis=0), kind="stable")
    if not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    d = order[0]
    row, entry = (a.ravel() for a in np.indices((n, len(book))))
    sums = ((x[:, d, None] - book[None, :, d]) ** 2).ravel()
    best = np.full(n, np.iinfo(np.int64).max)
    starts = np.arange(n) * len(book)
    for done in range(1, width + 1):
        if done & (done - 1) == 0 or done == width:
            # The leading entry's complete distance: there is one pair at least for each vector.
            least = np.minimum.reduceat(sums, starts)
            at = np.flatnonzero(sums == least[row])
            first = at[np.searchsorted(row[at], np.arange(n))]
            best = np.minimum(best, ((x - book[entry[first]]) ** 2).sum(axis=1))
        alive = sums <= best[row]
        row, entry, sums = row[alive], entry[alive], sums[alive]
        starts = np.searchsorted(row, np.arange(n))
        if done < width:
            d = order[done]
            sums = sums + (x[row, d] - book[entry, d]) ** 2
    # Complete now; pairs are in order of the entries, so the first of the least wins.
    least = np.minimum.reduceat(sums, starts)
    at = np.flatnonzero(sums == least[row])
    first = at[np.searchsorted(row[at], np.arange(n))]
    return entry[first], sums[first]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows, padded with zeros."""
    offs = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offs)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]]
    return out


def _assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts) codes and squared distances."""
    parts = x.reshape(len(x), len(books), -1)
    found = [nearest(parts[:, p], b) for p, b in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(books: np.ndarray) -> Callable:
    """Kernel: (v) -> (part, entry, n, sums) of one task's rows, used entries only."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column("v"), books.shape[0] * books.shape[2])
                codes, _ = _assigned(x, books)
                for p in range(len(books)):
                    np.add.at(sums[p], codes[:, p], x.reshape(len(x), len(books), -1)[:, p])
                    counts[p] += np.bincount(codes[:, p], minlength=books.shape[1])
        part, entry = np.nonzero(counts)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    return kernel


def _codes(books: np.ndarray) -> Callable:
    """Kernel: (vec_id, label, v) -> (vec_id, label, code, error)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = _assigned(_rows(batch.column("v"), books.shape[0] * books.shape[2]), books)
            text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text), pa.array(errors.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return kernel


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """(parts x entries x width) codebooks of integers() rows; None for no rows."""
    sizes = kept.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    if sizes["dim"] is None:
        return None
    width = max(1, -(-sizes["dim"] // parts))
    if 4 * (sizes["most"] or 0) ** 2 * width * parts >= 2**63:
        raise ArithmeticError("a distance would not fit 64 bits")
    # At most `entries` vectors.
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for k, r in enumerate(first):
        start[k, : len(r["v"])] = r["v"]
    books = np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        own = kept.select("v").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        total = own.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))
        books = books.copy()
        for r in total.collect():  # one row for each entry in use
            books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of integers() rows."""
    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(_codes(books), f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of (vec_id, embedding, label)."""
    kept = integers(vectors, scale)
    books = train(kept, parts, entries, rounds)
    if books is None:
        books = np.zeros((parts, 1, 1), np.int64)  # of no rows
    coded = session.cut(encode(kept, books))
    # Written, so that the join's sides are both dealt anew and Spark may split a label that many rows share.
    totals = session.cut(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "__label")
    met = coded.hint("merge").join(totals, coded["label"].eqNullSafe(totals["__label"])).drop("__label")
    return met.withColumn("codebooks_sha256", F.lit(digest(books)))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = session.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return compress(rows).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round_sql(k: int) -> str:
    """CTEs b{k} (assignments by codebook c{k}) and c{k+1}."""
    return f"""b{k} AS (SELECT rid, part, x, (min({{'d': list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'i': i}})) AS best
  FROM p JOIN c{k} USING (part) GROUP BY rid, part, x),
m{k} AS (SELECT part, best.i AS i, j, sum(x[j])::BIGINT AS s, count(*)::BIGINT AS n FROM b{k}, range(1, 5) t(j) GROUP BY ALL),
n{k} AS (SELECT part, i, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM m{k} GROUP BY ALL),
c{k + 1} AS (SELECT part, i, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN n{k} n USING (part, i))"""


ORACLE = f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS rid, * FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS (SELECT rid, k AS part, e[4 * k + 1 : 4 * k + 4] AS x FROM v, range(16) t(k)),
c0 AS (SELECT part, rid AS i, x AS c FROM p WHERE rid < 64),
{_round_sql(0)},
{_round_sql(1)},
{_round_sql(2)},
code AS (SELECT rid, string_agg(printf('%02x', best.i::INT), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM b2 GROUP BY rid),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, i)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN code USING (rid), book"""
