import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from factorlake.functions import numerics as N
from factorlake.functions import ranks


def test_buckets_equal_pandas(spark):
    rows = [(n, q, r) for n in (4, 7, 10, 13, 31) for q in (2, 3, 4, 5) if n >= q for r in range(1, n + 1)]
    df = spark.createDataFrame(rows, "n long, q int, r int").withColumn("b", N.quantile_bucket(F.col("r"), F.col("n"), F.col("q")))
    got = {(x.n, x.q, x.r): x.b for x in df.collect()}
    for n in (4, 7, 10, 13, 31):
        for q in (2, 3, 4, 5):
            if n >= q:
                want = pd.qcut(pd.Series(np.arange(1, n + 1)), q, labels=False)
                assert [got[n, q, r] for r in range(1, n + 1)] == want.tolist(), (n, q)


def test_division_and_text_never_raise(spark):
    df = spark.createDataFrame([("1", 0.0), ("x", 1.0), ("", 2.0), ("NaN", 1.0), ("inf", 1.0), (None, None)], "t string, d double")
    got = df.select(N.number("t").alias("n"), N.div(N.number("t"), "d").alias("q")).collect()
    assert [r.n for r in got] == [1.0, None, None, None, None, None]
    assert all(r.q is None for r in got)


def test_correlation_of_constants_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, float(k)) for k in range(5)] + [(2, float(k), 2.0 * k) for k in range(4)], "g int, x double, y double")
    got = {r.g: r.c for r in df.groupBy("g").agg(N.correlation("x", "y").alias("c")).collect()}
    assert got[1] is None and math.isclose(got[2], 1.0)


def test_average_rank(spark):
    df = spark.createDataFrame([(1, v) for v in (3.0, 1.0, 3.0, 2.0)], "g int, v double")
    assert sorted(r.a for r in df.select(N.average_rank("v", "g").alias("a")).collect()) == [1.0, 2.0, 3.5, 3.5]


def test_ranks_by_ranges_equal_pandas(spark):
    rng = np.random.default_rng(5)
    # One value holds a third of the rows, one key most of them.
    x = np.where(rng.random(3000) < 0.33, 0.5, rng.integers(-40, 40, 3000) / 7.0)
    k = np.where(rng.random(3000) < 0.9, "hot", "cold")
    table = pd.DataFrame({"k": k, "x": x, "i": np.arange(3000)})
    rows = spark.createDataFrame(table)
    got = ranks.average_ranks(rows, ("k",), r="x").toPandas().sort_values("i")
    assert (got["r"].to_numpy() == table.groupby("k")["x"].rank(method="average").to_numpy()).all()
    got = ranks.places(rows, ("k",), ("x", "i")).toPandas().sort_values("i")
    assert (got["before"].to_numpy() + 1 == table.groupby("k")["x"].rank(method="first").to_numpy()).all()
    assert ranks.average_ranks(rows.limit(0), ("k",), r="x").count() == 0
