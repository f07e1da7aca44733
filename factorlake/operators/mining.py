"""Forest miner: a random forest of the operator factors predicts forward returns out of sample."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.functions import workdir
from factorlake.functions.numerics import rank_correlation
from factorlake.functions.ranks import doubled_ranks, places
from factorlake.operators import factors


def forest(market: DataFrame, windows: list[int], horizon: int, trees: int = 80, depth: int = 5, leaf: int = 8, seed: int = 7, purge: int = 0, top: int = 10) -> tuple[DataFrame, list[dict]]:
    """(panel with ml_rf_prediction_h{h}, candidates): predictions stand in the test part only, the last 30 % of times.

    `purge` leaves that many times out of the training part's end, whose labels
    reach into the test part. Too few times or rows give keys alone and no
    candidate.
    """
    name, target = f"ml_rf_prediction_h{horizon}", f"fwd_return_{horizon}"
    names = factors.names(windows)
    wide = factors.panel(market, windows, (horizon,))
    # Written once, before the filter (which would repeat every factor's expression): the counts, the fit and the predictions all read it.
    rows = workdir.written(wide.select("timestamp", "symbol", *names, target)).dropna(subset=[*names, target])
    keys = market.select("timestamp", "symbol")
    times = places(rows.select("timestamp").distinct().withColumn("k", F.lit(1)), ("k",), ("timestamp",))
    n = times.count()
    if n < 5:
        return keys, []
    cut = min(max(int(n * 0.7), 1), n - 1)
    edge = {r["before"]: r["timestamp"] for r in times.filter(F.col("before").isin(cut, max(cut - purge, 0))).collect()}
    learns = F.col("timestamp") < F.lit(edge[max(cut - purge, 0)]).cast("timestamp_ntz")
    tested = F.col("timestamp") >= F.lit(edge[cut]).cast("timestamp_ntz")
    sizes = rows.agg(F.count_if(learns).alias("train"), F.count_if(tested).alias("test")).first()
    if sizes["train"] < 50 or sizes["test"] < 20:
        return keys, []
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    train, test = data.filter(learns), data.filter(tested)
    model = RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol=name, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="all", seed=seed).fit(train)
    predicted = model.transform(test).select("timestamp", "symbol", name, target)
    ranked = doubled_ranks(predicted.select(F.lit(1).alias("k"), name, target), ("k",), a=name, b=target)
    score = ranked.groupBy("k").agg(rank_correlation("a", "b").alias("s")).first()
    weights = sorted(zip(names, model.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))[:top]
    candidate = {"name": name, "source": "random_forest", "description": "out-of-sample forest prediction", "score": score["s"] if score else None, "importances": [{"name": a, "importance": b} for a, b in weights]}
    return keys.join(predicted.select("timestamp", "symbol", name), ["timestamp", "symbol"], "left"), [candidate]
