from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlake.functions import ranges
from factorlake.functions.recurrences import Smoothing, smooth
from factorlake.operators import backtest, evaluation, factors, quality, technicals
from factorlake.schemas import MARKET

T0 = datetime(2022, 1, 1)


@pytest.fixture
def many_ranges(spark):
    """Ranges that no coalescing joins again, so that one key lies in several."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_as_of_over_several_ranges_of_one_symbol(spark, many_ranges):
    r = np.random.default_rng(1)
    left = pd.DataFrame({"timestamp": [T0 + timedelta(hours=int(h)) for h in np.sort(r.integers(0, 2000, 900))], "symbol": r.choice(["A", "B"], 900, p=[0.95, 0.05])})
    right = pd.DataFrame({"timestamp": [T0 + timedelta(hours=int(h)) for h in np.sort(r.integers(500, 1500, 30))], "symbol": r.choice(["A", "B"], 30), "rate": r.normal(size=30).round(3), "seq": range(30)})
    right.loc[[4, 17], "rate"] = np.nan
    both = spark.createDataFrame(left), spark.createDataFrame(right).withColumn("rate", F.when(~F.isnan("rate"), F.col("rate")))
    to = [d.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")) for d in both]
    got = backtest.as_of(*to, "rate", order="seq").toPandas().sort_values(["symbol", "timestamp"])
    want = pd.merge_asof(left, right.dropna(), on="timestamp", by="symbol").sort_values(["symbol", "timestamp"])
    np.testing.assert_array_equal(got["rate"].to_numpy(float), want["rate"].to_numpy(float))
    assert ranges.dealt(to[0].filter("symbol = 'A'"), ("symbol",), ("timestamp",)).select(ranges.RANGE).distinct().count() > 2


def test_ties_go_by_the_order_column(spark):
    left = spark.createDataFrame([(T0, "A"), (T0, None)], "timestamp timestamp_ntz, symbol string")
    right = spark.createDataFrame([(T0, "A", 5.0, 1), (T0, "A", 2.0, 2), (T0, None, 9.0, 3)], "timestamp timestamp_ntz, symbol string, rate double, seq int")
    of = lambda **k: {x.symbol: x.rate for x in backtest.as_of(left, right, "rate", **k).collect()}
    assert of(order="seq") == {"A": 2.0, None: None} and of() == {"A": 5.0, None: None}
    spreads = right.withColumnRenamed("rate", "spread_bps")
    assert backtest.latest_spreads(spreads, "seq").first().spread_bps == 2.0


@pytest.mark.parametrize("wild", [False, True])
def test_curve_over_several_ranges_of_one_factor(spark, many_ranges, wild):
    r = np.random.default_rng(3)
    net = np.append(-0.5, r.normal(0.001, 2.0 if wild else 0.03, 799))  # returns under -1 turn the curve's sign
    df = spark.createDataFrame([("f", T0 + timedelta(days=k), float(x)) for k, x in enumerate(net)] + [("g", T0, 0.5)], "factor string, timestamp timestamp_ntz, net_return double")
    got = backtest.curve(df, ("factor",)).filter("factor = 'f'").toPandas().sort_values("timestamp")
    c = np.cumprod(1 + net)
    np.testing.assert_allclose(got["equity_curve"].to_numpy(float), c, rtol=1e-9)
    np.testing.assert_allclose(got["drawdown"].to_numpy(float), c / np.maximum.accumulate(c) - 1, rtol=1e-7, atol=1e-9)


def test_a_product_beyond_range_is_no_number(spark):
    df = spark.createDataFrame([(T0 + timedelta(days=k), 1e200) for k in range(3)], "timestamp timestamp_ntz, net_return double")
    assert [r.equity_curve is None for r in backtest.curve(df).orderBy("timestamp").collect()] == [False, True, True]


@pytest.mark.parametrize("steps", [[10] * 31 + [-10] * 33, [-11] * 27 + [0] * 13 + [11] * 40 + [-1] * 80, [-10] * 33 + [10] * 31], ids=["above", "above in one range alone", "to nothing"])
def test_a_curve_that_left_a_doubles_range_in_several_ranges(spark, many_ranges, steps):
    net = 10.0 ** np.array(steps) - 1
    df = spark.createDataFrame([(T0 + timedelta(days=k), float(x)) for k, x in enumerate(net)], "timestamp timestamp_ntz, net_return double")
    got = backtest.curve(df).toPandas().sort_values("timestamp")
    with np.errstate(all="ignore"):
        c = np.cumprod(1 + net)
        c[~np.isfinite(c)] = np.nan
        peak = np.fmax.accumulate(c)
        drawdown = np.where(peak == 0, np.nan, c / peak - 1)
    np.testing.assert_allclose(got["equity_curve"].to_numpy(float), c, rtol=1e-9, atol=1e-307)
    np.testing.assert_allclose(got["drawdown"].to_numpy(float), drawdown, rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("partitions", ["4", "8", "200"])
def test_mirrored_factors_tie_and_go_by_name(spark, partitions):
    rows = [(T0 + timedelta(days=i), s, c, c, c, c, 100.0, "crypto", "1d") for k, s in enumerate("ABC") for i, c in enumerate((100 * np.exp(np.cumsum(np.random.default_rng(k).normal(0, 0.03, 90)))).tolist())]
    panel = factors.panel(spark.createDataFrame(rows, MARKET), [3, 5], (1,))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        e = {r.factor: r for r in evaluation.evaluate(panel, ["reversal_5", "mom_5", "mom_3", "reversal_3"], (1,)).collect()}
        for n in (3, 5):
            assert e[f"mom_{n}"].score == e[f"reversal_{n}"].score and e[f"mom_{n}"].pooled_spearman == -e[f"reversal_{n}"].pooled_spearman
        assert list(e) == sorted(e, key=lambda f: (-e[f].score, f))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def plain(g: pd.DataFrame) -> pd.DataFrame:
    """The smoothed indicators of one symbol by pandas."""
    h, low, c = g["high"], g["low"], g["close"]
    ewm = lambda x, alpha, least: x.ewm(alpha=alpha, adjust=False, min_periods=least, ignore_na=True).mean()
    d = c.diff()
    tr = pd.concat([h - low, (h - c.shift()).abs(), (low - c.shift()).abs()], axis=1).max(axis=1)
    atr = ewm(tr, 1 / 14, 14)
    up, down = h.diff(), -low.diff()
    plus, minus = (100 * ewm(x, 1 / 14, 14) / atr for x in (up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)))
    macd = ewm(c, 2 / 13, 12) - ewm(c, 2 / 27, 26)
    signal = ewm(macd, 0.2, 9)
    rsi = 100 - 100 / (1 + ewm(d.clip(lower=0), 1 / 14, 14) / ewm(-d.clip(upper=0), 1 / 14, 14))
    dx = 100 * (plus - minus).abs() / (plus + minus)
    return pd.DataFrame({"ema_20": ewm(c, 2 / 21, 10), "ema_200": ewm(c, 2 / 201, 100), "rsi_14": rsi, "macd": macd, "macd_signal": signal, "macd_hist": macd - signal, "atr_14": atr, "plus_di_14": plus, "minus_di_14": minus, "adx_14": ewm(dx, 1 / 14, 14)})


def test_smoothers_of_symbols_over_several_ranges_equal_pandas(spark, many_ranges):
    r = np.random.default_rng(9)
    frames = []
    for s, n in (("LONG", 900), ("MID", 150), ("ONE", 1), ("SHORT", 12), ("Z", 200)):
        c = 100 * np.exp(np.cumsum(r.normal(0, 0.03, n)))
        f = pd.DataFrame({"timestamp": [T0 + timedelta(hours=k) for k in range(n)], "symbol": s, "open": c, "high": c * (1 + r.uniform(0, 0.03, n)), "low": c * (1 - r.uniform(0, 0.03, n)), "close": c, "volume": 1.0})
        f.loc[r.random(n) < 0.05, "close"] = np.nan  # gaps, also at the ends of ranges
        frames.append(f)
    bars = spark.createDataFrame(pd.concat(frames)).withColumns({"timestamp": F.col("timestamp").cast("timestamp_ntz"), "close": F.when(~F.isnan("close"), F.col("close"))})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = ("ema_20", "ema_200", "rsi_14", "macd", "macd_signal", "macd_hist", "atr_14", "plus_di_14", "minus_di_14", "adx_14")
    try:
        for size in ("64", before):  # many blocks in a range, and one
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = technicals.panel(bars, wanted).toPandas().sort_values(["symbol", "timestamp"])
            for f in frames:
                mine, want = got[got["symbol"] == f["symbol"].iloc[0]], plain(f)
                for k in wanted:
                    np.testing.assert_allclose(mine[k].to_numpy(float), want[k].replace([np.inf, -np.inf], np.nan).to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=f"{k} {f['symbol'].iloc[0]}")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_scan_equals_steps():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 333):
        x = np.where(r.random(n) < 0.2, np.nan, r.normal(size=n))
        starts = r.random(n) < 0.1
        for first, state in ((True, (0, np.nan)), (False, (0, np.nan)), (False, (3, 0.7))):
            starts[0] = first
            how = Smoothing(0.3, 2)
            got, count, y = smooth(x, starts, how, *state)
            c, v, want = *state, []
            for k in range(n):
                if starts[k]:
                    c, v = 0, np.nan
                if x[k] == x[k]:
                    c, v = c + 1, x[k] if c == 0 else 0.3 * x[k] + 0.7 * v
                want.append(v if c >= 2 else np.nan)
            np.testing.assert_allclose(got, want, rtol=1e-12)
            assert count == c and (c == 0 or abs(y - v) < 1e-12)


def test_medians_and_steps_over_several_ranges(spark, many_ranges):
    r = np.random.default_rng(4)
    times = {s: np.sort(r.choice(20_000, n, replace=False)) for s, n in (("A", 700), ("B", 2), ("C", 1), ("D", 31))}
    rows = [(T0 + timedelta(minutes=int(t)), s, None, None) for s, ts in times.items() for t in ts] + [(None, "A", None, None), (T0, None, None, None)]
    rows += rows[:50]  # repeated times are one
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, frequency string, asset_class string")
    steps = quality.steps(df)
    got = {x.symbol: x.median for x in quality.medians(steps, "symbol", "step").collect()}
    assert got == {s: float(np.median(np.diff(t) * 60)) for s, t in times.items() if len(t) > 1}
    assert steps.filter("step is null").count() == 4


def test_a_backtest_refuses_what_it_cannot_do(spark):
    panel = spark.createDataFrame([(T0, "A", 1.0, None)], "timestamp timestamp_ntz, symbol string, mom_5 double, fwd_return_1 double")
    with pytest.raises(ValueError, match="no column 'mom_9'"):
        backtest.one(panel, "mom_9", 1)
    with pytest.raises(ValueError, match="no row"):
        backtest.one(panel, "mom_5", 1)
    twice = spark.createDataFrame([(T0, "A", 1.0, 1, 0.1), (T0, "A", -1.0, 1, 0.1)], "timestamp timestamp_ntz, symbol string, value double, direction int, target double")
    with pytest.raises(Exception, match="more than once"):
        backtest.returns(twice, backtest.BacktestConfig())
