import hashlib
import math
import random

import numpy as np
import pytest

from factorlake.llm import vector_codes

FIELDS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    """The contract in plain Python."""
    kept = []
    for vec_id, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = [(i, v, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[2], p) for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for _, _, v, _ in kept:
                met.setdefault(best(v, p)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(met[k]) for c in zip(*met[k])] if k in met else e for k, e in enumerate(books[p])]
    out = []
    for i, _, v, label in kept:
        found = [best(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = {}
    for *_, error, label in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, sums[label], digest) for i, code, error, label in out]


def held(spark, rows, tmp_path, fields=FIELDS):
    spark.createDataFrame(rows, fields).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()), key=str)


def corpus(n, dim, seed=1):
    r = random.Random(seed)
    vectors = [[r.gauss(0, 0.2) for _ in range(dim)] for _ in range(n)]
    rows = [(k * 3 % n, v, r.choice([0, 0, 0, 1, 2, None])) for k, v in enumerate(vectors)]
    rows += [(7, vectors[3], 1), (7, vectors[3], 1), (None, vectors[5], None), (900, [0.0] * dim, 2), (901, [0.25] * dim, 2)]
    return rows + [(1000, None, 1), (1001, [None] * dim, 1), (1002, [float("nan")] * dim, 1), (1003, [0.1] * (dim - 1) + [float("inf")], 1)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = corpus(170, 64)
    assert held(spark, rows, tmp_path) == sorted(plain(rows), key=str)


def test_few_rows_unlike_lengths_and_empty_vectors(spark, tmp_path):
    rows = [(3, [0.5] * 20, 1), (1, [], 1), (2, [-0.3] * 33, None), (2, [0.1], None), (5, [0.5] * 20, 4)]
    assert held(spark, rows, tmp_path) == sorted(plain(rows), key=str)


def test_no_row_kept(spark, tmp_path):
    assert held(spark, [(1, None, 1), (2, [float("nan")], 2)], tmp_path) == []


def test_other_columns_are_not_read(spark, tmp_path):
    rows = corpus(80, 16, 3)
    wide = [(*r, "x", 1.5, [1], 3) for r in rows]
    assert held(spark, wide, tmp_path, FIELDS + ", code string, error double, v array<int>, label_error int") == sorted(plain(rows), key=str)


def test_a_component_too_large_raises(spark, tmp_path):
    with pytest.raises(Exception, match="too large"):
        held(spark, [(1, [3e30, 0.0], 1)], tmp_path)


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 12])
def test_partial_distances_find_what_full_ones_do(width):
    r = np.random.default_rng(width)
    for spread in (2, 30, 1000):  # with many ties, and with few
        x, book = r.integers(-spread, spread, (300, width)), r.integers(-spread, spread, (64, width))
        full = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        code, error = vector_codes.nearest(x, book)
        assert (code == full.argmin(axis=1)).all() and (error == full.min(axis=1)).all()
