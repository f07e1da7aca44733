"""Exact top-k inner products by a three-phase uniform threshold.

Components become floor(64 x), so scores are integers. Dimensions are dealt to
m slices; a slice's part of the inner product is that slice's local score.
Candidates are packed into blocks and dealt once to a number of shares that
follows the cluster, not the data; blocks of queries are sent to every share, and
a task goes through its share's blocks for one block of queries after another.

Phase 1, local score lists: from every slice's list of a share's k best local
scores for a query, the candidates met are scored in full. The k-th best of these over
all shares is a safe cutoff t: at least k candidates reach it. Phase 2: t goes
back to the shares with the queries; a candidate that reaches t has a local score of at
least t/m in some slice, so only such entries are collected, slice by slice, and a
candidate stays while the slices known and, for the others, less than t/m each can
still reach t. Phase 3: what stays is scored exactly, and of those that reach t a
share returns a query's k best by score and vec_id; the best k over shares are
the result.

A stated query set meets all rows, in blocks; nothing is sampled or capped, and
no list grows beyond k for a query and share.

Edge cases: vectors null, empty or with null or non-finite components take no
part; vectors of unlike length are compared as if padded with zeros; ties go to
the smaller vec_id; rows that share a vec_id are rows of their own, and only
the query's own row is left out; a null vec_id takes no part; an empty table, or
one without queries, gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.llm import session

K = 20
SCALE = 64
SLICES = 4
BLOCK = 2048
_FIELDS = ("dim", "kind", "vec_ids", "rids", "data")
_BLOCK_SCHEMA = "block long, dim int, kind string, vec_ids binary, rids binary, data binary"


def _pack(scale: int, size: int):
    """Kernel: (vec_id, rid, embedding) -> blocks of up to `size` integer vectors, in the least integer type that holds them."""

    def made(ids: np.ndarray, rids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        most = int(np.abs(rows).max())
        kind = next(k for k in ("int8", "int16", "int32", "int64") if most <= np.iinfo(k).max)
        columns = [pa.array([rids[0]], pa.int64()), pa.array([rows.shape[1]], pa.int32()), pa.array([kind]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, rids, rows.astype(kind)))]
        return pa.RecordBatch.from_arrays(columns, names=["block", *_FIELDS])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            dim = max(x[2].shape[1] for x in held)
            rows = np.concatenate([np.pad(x[2], ((0, 0), (0, dim - x[2].shape[1]))) for x in held])
            ids, rids = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            held.clear()
            return made(ids, rids, rows)

        for batch in batches:
            vectors = batch.column("embedding")
            offs = vectors.offsets.to_numpy().astype(np.int64)
            flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null is nan
            wrong = np.append(0, np.cumsum(~np.isfinite(flat)))
            good = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False) & (np.diff(offs) > 0) & (np.diff(wrong[offs]) == 0))
            for i in range(0, len(good), size):
                some = good[i : i + size]
                n = np.diff(offs)[some]
                inside = np.arange(n.max())[None, :] < n[:, None]
                rows = np.zeros(inside.shape, np.int64)
                at = np.concatenate([np.arange(a, b) for a, b in zip(offs[some], offs[some + 1])])
                rows[inside] = np.clip(np.floor(scale * flat[at]), -(2.0**62), 2.0**62).astype(np.int64)
                held.append((batch.column("vec_id").to_numpy(zero_copy_only=False)[some].astype(np.int64), batch.column("rid").to_numpy()[some], rows))
                if sum(len(x[0]) for x in held) >= size:
                    yield flush()
        if held:
            yield flush()

    return kernel


class Block:
    def __init__(self, row: dict, side: str):
        self.ids = np.frombuffer(row[f"{side}_vec_ids"], np.int64)
        self.rids = np.frombuffer(row[f"{side}_rids"], np.int64)
        self.data = np.frombuffer(row[f"{side}_data"], row[f"{side}_kind"]).reshape(len(self.ids), -1)
        self.most = float(np.abs(self.data.astype(np.float64)).max(initial=0))


def local_scores(q: Block, c: Block, slices: int) -> Iterator[np.ndarray]:
    """(queries x candidates) local scores of one slice after another; floating point only where it holds every sum exactly."""
    dim = min(q.data.shape[1], c.data.shape[1])
    bound = q.most * c.most * dim
    kind = np.float32 if bound < 2.0**24 else np.float64 if bound < 2.0**53 else np.int64
    for part in np.array_split(np.arange(dim), slices):
        yield q.data[:, part].astype(kind) @ c.data[:, part].astype(kind).T


def _best(lists: list[np.ndarray], k: int) -> np.ndarray:
    """Per row the k largest of the lists' entries, largest first."""
    all_ = np.concatenate(lists, axis=1)
    return -np.sort(-all_, axis=1)[:, :k]


_LEAST = -(2**63) + 1


def met_scores(q: Block, c: Block, k: int, slices: int) -> np.ndarray:
    """Phase 1 for one pair of blocks: per query the k best full scores (else _LEAST) of candidates in some slice's k best local ones."""
    local = list(local_scores(q, c, slices))
    own = q.rids[:, None] == c.rids[None, :]
    take = min(k, len(c.ids))
    met = []
    for p in local:
        masked = np.where(own, p.min() - 1, p)
        met.append(np.argpartition(-masked, take - 1, axis=1)[:, :take])
    at = np.sort(np.concatenate(met, axis=1), axis=1)
    score = sum(np.take_along_axis(p, at, axis=1).astype(np.int64) for p in local)
    again = np.append(np.zeros((len(at), 1), bool), at[:, 1:] == at[:, :-1], axis=1)
    score[again | np.take_along_axis(own, at, axis=1)] = _LEAST
    return _best([score], k)


def reaching(q: Block, c: Block, cut: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 for one pair of blocks: (query, candidate, score) of the pairs with a score of at least the query's cutoff."""
    parts = list(local_scores(q, c, slices))
    share = (cut.astype(np.float64) / len(parts))[:, None]
    entries = [p >= share for p in parts]  # what each slice would send
    row, col = np.nonzero(np.logical_or.reduce(entries))
    bound = np.zeros(len(row))
    for p, sent in zip(parts, entries):
        bound += np.where(sent[row, col], p[row, col], share[row, 0])
    stay = (bound >= cut[row] - 1e-6 * np.abs(cut[row].astype(np.float64))) & (q.rids[row] != c.rids[col])
    row, col = row[stay], col[stay]
    score = sum(p[row, col].astype(np.int64) for p in parts)
    good = score >= cut[row]
    return row[good], col[good], score[good]


def _phase_one(k: int, slices: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, best = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(q.ids), now)), pa.array(q.rids), pa.array(best.tolist(), pa.list_(pa.int64()))], names=["q_block", "rid", "best"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["q_block"] != now:
                    if now is not None:
                        yield out()
                    now, q = row["q_block"], Block(row, "q")
                    best = np.full((len(q.ids), 0), _LEAST, np.int64)
                best = _best([best, met_scores(q, Block(row, "c"), k, slices)], k)
        if now is not None:
            yield out()

    return kernel


def _phase_two(k: int, slices: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, cut, held = None, None, None, None

        def keep(found: tuple) -> tuple:
            row, ids, score = (np.concatenate(x) for x in zip(held, found))
            order = np.lexsort((ids, -score, row))
            row, ids, score = row[order], ids[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            return row[place < k], ids[place < k], score[place < k]

        def out() -> pa.RecordBatch:
            row, ids, score = held
            return pa.RecordBatch.from_arrays([pa.array(q.rids[row]), pa.array(q.ids[row]), pa.array(ids), pa.array(score)], names=["rid", "query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["q_block"] != now:
                    if now is not None:
                        yield out()
                    now, q = row["q_block"], Block(row, "q")
                    cuts = {x["rid"]: x["cut"] for x in row["cuts"]}
                    cut = np.array([cuts[r] for r in q.rids.tolist()], np.int64)
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                c = Block(row, "c")
                i, j, score = reaching(q, c, cut, slices)
                held = keep((i, c.ids[j], score))
        if now is not None:
            yield out()

    return kernel


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, scale: int = SCALE, slices: int = SLICES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for (vec_id, rid, embedding) rows; a query's own row has its rid."""
    spark = vectors.sparkSession
    parts = lambda df, most: max(1, min(most, -(-df.count() // block)))
    shares = parts(vectors, 2 * spark.sparkContext.defaultParallelism)
    packed = lambda df, n, s: df.repartition(n).mapInArrow(_pack(scale, block), _BLOCK_SCHEMA).select(F.col("block").alias(f"{s}_block"), *(F.col(x).alias(f"{s}_{x}") for x in _FIELDS))
    c = session.cut(packed(vectors, shares, "c").withColumn("share", F.spark_partition_id()))
    q = session.cut(packed(queries, parts(queries, 2**20), "q"))
    # Each block of queries goes to every share. A share's blocks come one after another for each of them.
    sent = lambda df: df.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).hint("merge").join(c, "share")
    lists = sent(q).mapInArrow(_phase_one(k, slices), "q_block long, rid long, best array<long>")
    # A query's lists, k scores of each share, give the cutoff (none with fewer than k candidates).
    every = F.sort_array(F.flatten(F.collect_list("best")), asc=False)
    cuts = lists.groupBy("q_block", "rid").agg(F.coalesce(F.get(every, F.lit(k - 1)), F.lit(_LEAST)).alias("cut"))
    by_block = session.cut(cuts.groupBy("q_block").agg(F.collect_list(F.struct("rid", "cut")).alias("cuts")))  # a block's queries, at most `block`
    found = sent(q.join(by_block, "q_block")).mapInArrow(_phase_two(k, slices), "rid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.col("score").desc(), "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = session.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = session.cut(rows.withColumn("rid", F.monotonically_increasing_id()))
    return top_k(rows.filter("vec_id % 20 = 0"), rows)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
