import math
import random

from pyspark.sql import functions as F

from factorlake.llm import topk


def brute(rows, k):
    good = [(i, v, [math.floor(64 * x) for x in e]) for i, (v, e) in enumerate(rows) if v is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, e in good:
        if v % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(e, f)), w) for j, w, f in good if j != i)[:k]
            out += [(v, r + 1, w, -x) for r, (x, w) in enumerate(s)]
    return sorted(out)


def rows():
    rnd = random.Random(4)
    out = [(k, [rnd.choice([-1.0, 1.0]) * rnd.random() for _ in range(10)]) for k in range(300)]
    out += [(400 + k, [0.5] * 10) for k in range(80)]
    out += [(20, out[20][1]), (1000, None), (1020, []), (1040, [1.0, None]), (1060, [float("nan")] * 10), (1080, [float("inf")] * 10), (1100, [1.0, 2.0]), (1120, [0.0] * 10), (None, [1.0] * 10), (1140, [4e7] * 10)]
    return out


def run(spark, data, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "rid long, vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in topk.top_k(df.filter("vec_id % 20 = 0"), df, **kw).collect())


def test_against_brute_force(spark):
    data = rows()
    assert run(spark, data, block=64) == brute(data, 20)


def test_fewer_than_k_and_empty(spark):
    data = rows()[:7]
    assert run(spark, data) == brute(data, 20)
    assert run(spark, []) == []


def test_query_without_others(spark):
    assert run(spark, [(0, [1.0, 2.0])]) == []
