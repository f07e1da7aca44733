"""The forest miner: where it learns, where it predicts, and its score."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from factorlake.operators import factors, mining
from factorlake.schemas import MARKET

T0 = datetime(2022, 1, 1)


def market(spark, symbols: int, bars: int):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(symbols):
        c = 100.0 * np.exp(np.cumsum(rng.normal(0, 0.03, bars)))
        rows += [(T0 + timedelta(days=i), f"S{k}", x, x * 1.02, x * 0.97, x, 100.0 + i * (k + 1) % 17, "crypto", "1d") for i, x in enumerate(c.tolist())]
    return spark.createDataFrame(rows, MARKET)


@pytest.mark.parametrize("purge", [0, 4])
def test_learns_before_it_predicts(spark, purge):
    m = market(spark, 3, 80)
    predicted, (found,) = mining.forest(m, [3, 5], 2, trees=5, purge=purge, top=4)
    got = predicted.toPandas()
    name = "ml_rf_prediction_h2"
    assert len(got) == 240 and found["name"] == name
    names = factors.names([3, 5])
    panel = factors.panel(m, [3, 5], (2,)).toPandas().dropna(subset=[*names, "fwd_return_2"])
    times = sorted(panel["timestamp"].unique())
    cut = int(len(times) * 0.7)
    both = got.merge(panel[["timestamp", "symbol", "fwd_return_2"]], how="left")
    # Predictions stand at the test part's complete rows and nowhere else.
    tested = both["fwd_return_2"].notna() & (both["timestamp"] >= times[cut])
    assert (both[name].notna() == tested).all()
    p = both[tested]
    assert found["score"] == pytest.approx(p[name].astype(float).rank().corr(p["fwd_return_2"].rank()), abs=1e-12)
    weights = [x["importance"] for x in found["importances"]]
    assert len(weights) == 4 and weights == sorted(weights, reverse=True)


def test_labels_of_the_purge_are_not_learnt(spark):
    """A later part of the training times may hold anything once it is purged."""
    m = market(spark, 3, 80)
    names = factors.names([3])
    panel = factors.panel(m, [3], (1,)).toPandas().dropna(subset=[*names, "fwd_return_1"])
    times = sorted(panel["timestamp"].unique())
    cut = int(len(times) * 0.7)
    assert times[cut] - times[cut - 1] == pd.Timedelta(days=1)
    plain, _ = mining.forest(m, [3], 1, trees=3)
    purged, _ = mining.forest(m, [3], 1, trees=3, purge=10)
    a, b = (x.toPandas().sort_values(["timestamp", "symbol"])["ml_rf_prediction_h1"].reset_index(drop=True) for x in (plain, purged))
    assert (a.notna() == b.notna()).all() and not np.allclose(a.dropna(), b.dropna())


def test_too_little_gives_keys_alone(spark):
    for bars in (4, 20):
        out, found = mining.forest(market(spark, 2, bars), [3], 1)
        assert out.columns == ["timestamp", "symbol"] and out.count() == 2 * bars and found == []
    out, found = mining.forest(market(spark, 1, 5).limit(0), [3], 1)
    assert out.count() == 0 and found == []
