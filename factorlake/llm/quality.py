"""Quality: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled rows of quality 1, a bounded sample of them; the
rest of the evidence is unlabelled text, all rows of it. Both are taken outside
the held-out fold. Moments, scores above each cut, risk, gradient and Hessian of
the unlabelled side are sums over all rows, one Spark job each time. The class prior of the unlabelled text is estimated from the scores of a first
classifier of positives against unlabelled rows: above any cut, the share of
unlabelled rows is at least the prior times the share of positives, and near
the top of the range of cuts the bound is tight. A logistic model of surface
features then minimises  prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]).

Features are shares and counts over a text's bytes and words: capitals, digits,
marks, bars, symbols, lines, repeated neighbours, distinct words and so on.

Edge cases: null and empty texts have zero features and a score like any other;
without positives or unlabelled text every score is 0.5; rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.llm import session
from factorlake.llm.bytesblock import Rolling, blocks, utf8
from factorlake.llm.folds import held_out
from factorlake.llm.linear import total
from factorlake.llm.neardup import words

FOLD = (5, 0)
CUT = 0.3
SAMPLE = 8000  # bound of the sample of labelled positives, rows
RIDGE = 1e-4
_KINDS = [range(65, 91), range(97, 123), range(48, 58), b"!", b"|", b"#$%&*@^~=+<>{}[]\\_", b".,;:?", b" ", b"\n", b"\t\r\x0b\x0c", range(128, 256)]
WIDTH = len(_KINDS) + 5


def features(body: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of features for each text of a block."""
    n = len(offs) - 1
    out = np.zeros((n, WIDTH))
    size = np.diff(offs)
    length = np.maximum(size, 1)
    for k, kind in enumerate(_KINDS):
        lut = np.zeros(256, np.int64)
        lut[list(kind)] = 1
        sums = np.append(0, np.cumsum(lut[body]))
        out[:, k] = np.log1p(100 * np.diff(sums[offs]) / length)
    starts, stops, count = words(body, offs)
    w = Rolling(body)(starts, stops)
    first = np.append(0, np.cumsum(count))
    again = np.append(False, w[1:] == w[:-1])
    again[first[:-1][count > 0]] = False
    sums = np.append(0, np.cumsum(again))
    many = np.maximum(count, 1)
    out[:, -5] = np.log1p(100 * np.diff(sums[first]) / many)
    distinct = np.fromiter((len(np.unique(w[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist())), float, n)
    out[:, -4] = distinct / many
    out[:, -3] = np.log1p((np.append(0, np.cumsum(stops - starts))[first[1:]] - np.append(0, np.cumsum(stops - starts))[first[:-1]]) / many)
    out[:, -2] = np.log1p(count)
    out[:, -1] = (np.log1p(count) * distinct) / many
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offs = utf8(batch.column("text"))
        for i, j, b, o in blocks(body, offs):
            made = features(b, o)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([r.tobytes() for r in made], pa.binary())], names=["doc_id", "x"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of a block's texts as one value."""
    for batch in batches:
        body, offs = utf8(batch.column("text"))
        for _, _, b, o in blocks(body, offs):
            yield pa.RecordBatch.from_arrays([pa.array([features(b, o).tobytes()], pa.binary())], names=["x"])


def _sums(packed: DataFrame, of, width: int) -> np.ndarray:
    """Sum over all rows of packed features: of(matrix) gives the `width` sums of some of them."""
    return total(packed, lambda x: of(np.frombuffer(x, np.float64).reshape(-1, WIDTH)), width)


def _moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0)))


def _matrix(sample: DataFrame) -> np.ndarray:
    """Features of a bounded sample, in a fixed order."""
    rows = sorted(sample.mapInArrow(_rows, "doc_id long, x binary").collect(), key=lambda r: (r["doc_id"], r["x"]))
    return np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float64).reshape(-1, WIDTH)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _one(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.append(np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1)), axis=1)


def _softplus(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Sum of log(1 + exp(g)) over the rows, its gradient and its Hessian, end to end."""
    g = x @ beta
    s = _sigmoid(g)
    return np.concatenate(([np.logaddexp(0, g).sum()], x.T @ s, ((x * (s * (1 - s))[:, None]).T @ x).ravel()))


def _newton(risk, width: int, steps: int = 40) -> np.ndarray:
    """Least ridged risk from 0 on. risk(beta) gives value, gradient, Hessian and whether beta may be taken."""
    ridge = RIDGE * np.append(np.ones(width - 1), 0)

    def at(beta: np.ndarray):
        value, g, h, allowed = risk(beta)
        return value + (ridge * beta * beta).sum() / 2, g + ridge * beta, h + np.diag(ridge + 1e-9), allowed

    beta = np.zeros(width)
    value, g, h, _ = at(beta)
    for _ in range(steps):
        step, gain = np.linalg.solve(h, g), None
        for halving in range(12):
            next_beta = beta - step / 2**halving
            found = at(next_beta)
            if found[3] and found[0] < value:
                gain = value - found[0]
                beta, (value, g, h, _) = next_beta, found
                break
        if gain is None or gain < 1e-9:
            break
    return beta


def class_prior(p: np.ndarray, above, n: int) -> float:
    """Share of positives among the n unlabelled rows, from the scores of both under a classifier of one against the other.
    above(cuts) gives how many unlabelled rows reach each cut."""
    cuts = np.quantile(p, np.linspace(0.0, 0.5, 51))
    above_p = (p[None, :] >= cuts[:, None]).mean(axis=1)
    above_u = above(cuts) / n
    slack = np.sqrt(above_u * (1 - above_u) / n) / above_p
    return float(np.clip((above_u / above_p + slack).min(), 0.05, 0.98))


def fit(p: np.ndarray, packed: DataFrame, moments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, coefficients with the intercept last, estimated prior); moments are those of all packed rows."""
    n = int(moments[0])
    first, second = ((_moments(p)[1:] / len(p) + moments[1:] / n) / 2).reshape(2, WIDTH)
    mean, scale = first, np.sqrt(np.maximum(second - first**2, 0)) + 1e-6
    width = WIDTH + 1
    xp = _one(p, mean, scale)

    def unlabelled(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = _sums(packed, lambda x: _softplus(_one(x, mean, scale), beta), 1 + width + width * width) / n
        return s[0], s[1 : 1 + width], s[1 + width :].reshape(width, width)

    def positive(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = _softplus(xp, beta) / len(xp)
        return s[0], s[1 : 1 + width], s[1 + width :].reshape(width, width)

    slope = xp.mean(axis=0)

    def against(beta: np.ndarray):
        u, p = unlabelled(beta), positive(beta)
        return u[0] + p[0] - slope @ beta, u[1] + p[1] - slope, u[2] + p[2], True

    beta = _newton(against, width)
    prior = class_prior(xp @ beta, lambda cuts: _sums(packed, lambda x: ((_one(x, mean, scale) @ beta)[None, :] >= cuts[:, None]).sum(axis=1), len(cuts)), n)

    def non_negative(beta: np.ndarray):
        # l(g) - l(-g) = -g, so where the negative part is not below 0 the risk is convex; steps stay on that side.
        u = unlabelled(beta)
        return u[0] - prior * (slope @ beta), u[1] - prior * slope, u[2], u[0] >= prior * positive(beta)[0]

    return mean, scale, _newton(non_negative, width), prior


def _scorer(mean: np.ndarray, scale: np.ndarray, beta: np.ndarray):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offs = utf8(batch.column("text"))
            out = np.zeros(batch.num_rows)
            for i, j, b, o in blocks(body, offs):
                out[i:j] = np.clip((features(b, o) - mean) / scale, -8, 8) @ beta[:-1] + beta[-1]
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(_sigmoid(out))], names=[*rest, "score"])

    return kernel


def score(docs: DataFrame, labels: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Struct `row` of columns `keep` of each row of docs, with its score."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull())
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), *FOLD)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # At most SAMPLE ids, so the broadcast is bounded.
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # Of rows that share a doc_id the one with the least hash of its text counts, so there are at most SAMPLE texts, the same in each run.
    p = _matrix(texts.join(F.broadcast(good), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    # Each step sends one vector a task to the driver, so tasks follow the cluster, not the input.
    packed = session.cut(texts.filter(~held_out(F.col("doc_id"), *FOLD)).select("text").mapInArrow(_packed, "x binary")).coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    moments = _sums(packed, _moments, 1 + 2 * WIDTH)
    if len(p) and moments[0]:
        mean, scale, beta, _ = fit(p, packed, moments)
    else:
        mean, scale, beta = np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scorer(mean, scale, beta), f"row {rows.schema['row'].dataType.simpleString()}, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(session.table(spark, sf_dir, "documents"), session.table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("row.doc_id", held_out(F.col("row.doc_id"), *FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
