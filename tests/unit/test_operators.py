from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.operators import backtest, context, decisions, evaluation, factors, prepare, quality, signals, store, technicals, walkforward
from factorlake.plans import pipeline
from factorlake.schemas import MARKET, DataRequest, frequency
from factorlake.sources import payloads, providers
from factorlake.streaming import feeds, state

T0 = datetime(2022, 1, 1)


def market(spark, closes: dict[str, list[float]], kind="crypto"):
    rows = [(T0 + timedelta(days=i), s, c, c * 1.02, c * 0.97, c, 100.0 + i, kind, "1d") for s, cs in closes.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, MARKET)


def walk(n, seed, base=100.0):
    return (base * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.03, n)))).tolist()


def test_smoothers_equal_pandas(spark):
    m = market(spark, {"A": walk(260, 1), "B": walk(30, 2)})
    got = technicals.panel(m).toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)
    for s, g in got.groupby("symbol"):
        c = g["close"].reset_index(drop=True)
        for n in (20, 50, 200):
            np.testing.assert_allclose(g[f"ema_{n}"].to_numpy(float), c.ewm(span=n, adjust=False, min_periods=max(2, n // 2)).mean().to_numpy(), rtol=1e-12)
        d = c.diff()
        up, down = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        np.testing.assert_allclose(g["rsi_14"].to_numpy(float), (100 - 100 / (1 + up / down)).to_numpy(), rtol=1e-10)


def test_rising_and_flat_series(spark):
    m = market(spark, {"UP": [float(k) for k in range(1, 61)], "FLAT": [5.0] * 60})
    p = technicals.panel(m).toPandas()
    up = p[p.symbol == "UP"]
    assert up.rsi_14.isna().all() and up.mfi_14.isna().all() and set(up.supertrend_direction_10_3) == {0, 1}
    wide = factors.panel(m, [5], (1,))
    flat = wide.filter("symbol = 'FLAT'").toPandas()
    assert flat.ma_gap_5.dropna().abs().max() == 0 and (flat.volatility_5.dropna() == 0).all()
    assert evaluation.evaluate(wide, factors.names([5]), (1,), 20).count() > 0


def test_adjustments(spark):
    m = market(spark, {"ETH-USD": [10.0, 20.0, 30.0], "BTC-USD": [1.0, 1.0, 1.0]})
    rules = prepare.parse_adjustments([{"symbol": "ETH-USD", "field": "close", "operation": "multiply", "value": 1.1, "start": "2022-01-02", "end": "2022-01-02"}])
    got = {(r.symbol, r.timestamp.day): r for r in prepare.adjust(m, rules).collect()}
    assert got["ETH-USD", 2].close == pytest.approx(22.0) and got["ETH-USD", 2].high == pytest.approx(22.0) and got["ETH-USD", 1].close == 10.0
    assert prepare.adjust(m, []) is m
    for bad in ({"a": 1}, [{"symbol": "X", "field": "nope", "value": 1}], [{"symbol": "X", "field": "close", "operation": "add", "value": "x"}], [{"symbol": "X", "field": "close", "value": 1, "start": "2022-02-01", "end": "2022-01-01"}]):
        with pytest.raises(ValueError):
            prepare.parse_adjustments(bad)


def test_normalise_keeps_the_last_of_a_key(spark):
    rows = [("2022-01-01", "A", "1", "1", "1", "1", "1", 1), ("2022-01-01", "A", "2", "2", "2", "2", "2", 2), ("bad", "A", "1", "1", "1", "1", "1", 3), ("2022-01-02", "A", "x", "1", "1", "1", "1", 4)]
    df = spark.createDataFrame(rows, "timestamp string, symbol string, open string, high string, low string, close string, volume string, seq int")
    assert [(r.close, r.seq) for r in prepare.normalise(df, "seq").collect()] == [(2.0, 2)]
    with pytest.raises(ValueError):
        prepare.normalise(df.drop("volume"))


def test_quality_of_defective_bars(spark):
    rows = [(T0, "A", 10.0, 11.0, 9.0, 10.0, 5.0), (T0, "A", 10.0, 8.0, 12.0, 10.0, 0.0), (T0 + timedelta(days=3), "A", 10.0, 11.0, 9.0, 10.0, 5.0)]
    df = spark.createDataFrame([(*r, "crypto", "1d") for r in rows], MARKET)
    report = quality.symbols(df)
    r = report.first()
    assert (r.duplicate_timestamps, r.invalid_prices, r.zero_or_negative_volume, r.status) == (1, 1, 1, "FAIL") and r.estimated_missing_bars >= 1
    assert {i.issue for i in quality.issues(report).collect()} >= {"duplicate_timestamps", "invalid_prices"}
    assert quality.summary(report).first().worst_symbol == "A"


def test_weights_sum_to_one_a_side(spark):
    rows = [(T0 + timedelta(days=t), f"S{k}", float((k * 7 + t) % 5), 1, 0.01 * k) for t in range(4) for k in range(6)] + [(T0 + timedelta(days=9), "S0", 1.0, 1, 0.1)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, value double, direction int, target double")
    w = backtest.weights(df, backtest.BacktestConfig(quantile=0.34)).toPandas()
    for _, g in w.groupby("timestamp"):
        assert g.weight[g.weight > 0].sum() == pytest.approx(1.0)
        assert g.weight[g.weight < 0].sum() == pytest.approx(0.0 if len(g) == 1 else -1.0)
    moved = backtest.turnover(backtest.weights(df, backtest.BacktestConfig())).toPandas()
    assert moved[moved.timestamp == T0 + timedelta(days=9)].turnover.sum() > 1  # exits trade too


def test_as_of_is_backward_and_inclusive(spark):
    left = spark.createDataFrame([(T0, "A", 1.0), (T0 + timedelta(days=1), "A", 1.0), (T0, "B", 1.0)], "timestamp timestamp_ntz, symbol string, weight double")
    right = spark.createDataFrame([(T0, "A", 0.5), (T0 + timedelta(days=1, microseconds=1), "A", 0.9), (T0 + timedelta(hours=3), "A", None)], "timestamp timestamp_ntz, symbol string, rate double")
    got = {(r.symbol, r.timestamp.day): r.rate for r in backtest.as_of(left, right, "rate").collect()}
    assert got == {("A", 1): 0.5, ("A", 2): 0.5, ("B", 1): None}


def test_metrics_of_a_first_bar_loss(spark):
    rows = [(T0, -0.5, 0.5), (T0 + timedelta(days=1), 0.1, 0.55)]
    df = spark.createDataFrame([(*r, 0.0, 0.0, 0.0) for r in rows], "timestamp timestamp_ntz, net_return double, equity_curve double, turnover double, execution_cost double, funding_cost double")
    m = backtest.metrics(df, backtest.BacktestConfig()).first()
    assert m.max_drawdown == 0.0 and m.total_return == pytest.approx(-0.45) and m.periods == 2


def plain_folds(n, splits, fraction, embargo, least):
    """(last training index, first and last test index) of each fold, from the definition."""
    train = max(least, int(n * fraction))
    if n - train - embargo < least:
        train = max(least, n - least - embargo)
    test = max(least, (n - train - embargo) // splits)
    cut = [(train + k * test - 1, train + k * test + embargo, min(train + (k + 1) * test + embargo, n) - 1) for k in range(splits)]
    return [(e, s, t) for e, s, t in cut if t - s + 1 >= least]


def test_folds_by_definition(spark):
    for n, splits, fraction, embargo, least in ((60, 3, 0.5, 1, 10), (60, 1, 0.85, 5, 20), (25, 3, 0.55, 1, 10), (19, 2, 0.5, 0, 10), (101, 4, 0.1, 3, 2)):
        times = [T0 + timedelta(days=k) for k in range(n)]
        m = spark.createDataFrame([(t,) for t in times], "timestamp timestamp_ntz")
        got = walkforward.folds(m, walkforward.WalkForwardConfig(True, splits, fraction, embargo, 5, least)).orderBy("fold").collect()
        want = plain_folds(n, splits, max(fraction, 0.2), embargo, least)
        assert [(r.fold, r.train_start, r.train_end, r.test_start, r.test_end) for r in got] == [(k + 1, times[0], times[e], times[s], times[t]) for k, (e, s, t) in enumerate(want)]


def test_walk_forward_rows_and_errors(spark):
    m = market(spark, {s: walk(160, k) for k, s in enumerate("ABCD")})
    panel, names = factors.panel(m, [3, 5]), factors.names([3, 5])
    wf = walkforward.WalkForwardConfig(enabled=True, embargo=2)
    out = walkforward.validate(m, panel, names, wf, backtest.BacktestConfig()).collect()
    assert len(out) == 3 and all(r.test_start > r.train_end and r.error is None for r in out)
    spreads = spark.createDataFrame([(s, 50.0) for s in "ABCD"], "symbol string, spread_bps double")
    costly = walkforward.validate(m, panel, names, wf, backtest.BacktestConfig(spread_multiplier=1.0), spreads).collect()
    assert all(a.test_total_return > b.test_total_return for a, b in zip(sorted(out), sorted(costly)))
    assert walkforward.validate(m, panel, names, walkforward.WalkForwardConfig(), backtest.BacktestConfig()).count() == 0
    few = m.filter(F.col("timestamp") < T0 + timedelta(days=15))
    (row,) = walkforward.validate(few, factors.panel(few, [3, 5]), names, wf, backtest.BacktestConfig()).collect()
    assert row.fold is None and "too few" in row.error


def test_tiny_factor_values_keep_their_order(spark):
    m = market(spark, {s: walk(120, k) for k, s in enumerate("ABCDE")}).withColumn("volume", F.lit(1e9))
    panel = factors.panel(m, [5], (1,))
    assert panel.agg(F.max("amihud_5")).first()[0] < 1e-9
    row = evaluation.evaluate(panel, ["amihud_5"], (1,)).first()
    scaled = evaluation.evaluate(panel.withColumn("amihud_5", F.col("amihud_5") * 2.0**40), ["amihud_5"], (1,)).first()
    assert row.pooled_spearman == scaled.pooled_spearman and row.score == scaled.score and row.quantile_spread == pytest.approx(scaled.quantile_spread, rel=1e-9)


def test_selecting_from_nothing_fails(spark):
    empty = spark.createDataFrame([], "factor string, horizon int, score double")
    with pytest.raises(Exception, match="no factor was evaluated"):
        evaluation.select_top(empty, 1).collect()


def test_latest_spread_and_ties(spark):
    rows = [("A", T0, 9.0), ("A", T0 + timedelta(days=1), 2.0), ("A", T0 + timedelta(days=2), None), ("B", T0, 1.0), ("B", T0, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, spread_bps double")
    assert {r.symbol: r.spread_bps for r in backtest.latest_spreads(df).collect()} == {"A": 2.0, "B": 3.0}
    left = spark.createDataFrame([(T0, "B", "f"), (T0, "B", "g")], "timestamp timestamp_ntz, symbol string, factor string")
    assert [r.spread_bps for r in backtest.as_of(left, df, "spread_bps", ("factor",)).collect()] == [3.0, 3.0]


def test_signals_of_a_monotone_factor(spark):
    rows = [(T0 + timedelta(days=k), s, float(k if s == "ETH" else -k)) for k in range(30) for s in ("ETH", "BTC")]
    wide = spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, mom_5 double")
    bt = spark.createDataFrame([("mom_5", 1, 2.4, 1.0, 0.1, -0.1, 0.6, 1, None)], "factor string, direction int, sharpe double, score double, total_return double, max_drawdown double, win_rate double, horizon int, error string")
    got = {r.symbol: r for r in signals.radar(wide, ["mom_5"], bt).collect()}
    assert got["ETH"].signal == "BULLISH" and got["ETH"].percentile > 0.95 and got["BTC"].signal == "BEARISH"
    assert all(r.signal_score <= r.confidence for r in got.values())


def test_context_values(spark):
    f = '{"code":"0","data":[{"instId":"X","fundingRate":"0.00025","ts":"1640995200000"}]}'
    o = '{"code":"0","data":[{"instId":"X","oi":"1","oiUsd":"2000000000","ts":"1640995300000"}]}'
    one = lambda p: spark.createDataFrame([("ETH", "X", p)], "symbol string, inst_id string, payload string")
    r = context.derivatives_snapshot(one(f), one(o)).first()
    assert r.annualized_funding_rate == pytest.approx(0.27375) and r.crowding == "LONG_CROWDED" and "2.00B" in r.interpretation
    b = '{"code":"0","data":[{"ts":"1","bids":[["99","2"],["98","1"]],"asks":[["101","1"],["102","1"]]}]}'
    t = '{"code":"0","data":[{"px":"100","sz":"1","side":"buy","ts":"2"},{"px":"99","sz":"1","side":"sell","ts":"1"}]}'
    m = context.microstructure(one(b), one(t)).first()
    assert m.spread_bps == pytest.approx(200.0) and (m.buy_trade_count, m.sell_trade_count) == (1, 1) and m.microstructure_label == "WIDE_SPREAD"
    with pytest.raises(Exception, match="exchange error 51001"):
        context.derivatives_snapshot(one('{"code":"51001","msg":"no","data":[]}'), one(o)).collect()
    c = '{"code":"0","data":[["1640995200000","1","2","0.5","1.5","9","0","0","1"],["1641081600000","1","2","0.5","1.5","9","0","0","0"],["1"]]}'
    assert payloads.candles(one(c), "crypto", "1d").count() == 1


def test_cards(spark):
    m = market(spark, {"ETH": [float(k) for k in range(100, 110)]})
    sig = spark.createDataFrame([("ETH", "mom_5", "BULLISH", "bullish", 0.8, 0.7, "x")], "symbol string, factor string, signal string, signal_label string, confidence double, signal_score double, interpretation string")
    d = spark.createDataFrame([(T0, "ETH", 0.3, 1e9, "LONG_CROWDED", "long crowded", "hot")], pipeline.EMPTY["derivatives"])
    h = spark.createDataFrame([(T0, "ETH", 0.11, 100.0, 1.1), (T0 + timedelta(days=1), "ETH", 0.22, 125.0, 1.2)], pipeline.EMPTY["history"])
    e = {k: spark.createDataFrame([], pipeline.EMPTY[k]) for k in ("micro", "onchain")}
    r = decisions.cards(m, sig, d, h, e["micro"], e["onchain"], "PASS").first()
    assert r.stance == "WATCH_LONG" and r.funding_change == pytest.approx(0.11) and r.oi_change == pytest.approx(0.25) and r.confidence == pytest.approx(0.68)


def test_messages_are_routed(spark):
    text = ["pong", "{x", '{"event":"error"}', '{"event":"subscribe","arg":{"channel":"trades"}}', '{"arg":{"channel":"trades","instId":"A"},"data":[{"px":"1","sz":"2","side":"buy","tradeId":"1","ts":"1"}]}', '{"arg":{"channel":"what"},"data":[]}']
    got = [r.kind for r in feeds.route(spark.createDataFrame([(t,) for t in text], "value string")).collect()]
    assert got == ["pong", "invalid", "error", "event", "trade", "other"]
    assert len(feeds.subscriptions(["BTC-USD", "ETH-USD", "BTC-USD", "SOL"], liquidations=False)) == 6
    assert feeds.swap_id("BTC-USD") == "BTC-USDT-SWAP" and feeds.spot_id("eth/usdt") == "ETH-USDT"


def test_providers(spark, tmp_path):
    (tmp_path / "aapl.csv").write_text("timestamp,open,high,low,close,volume\n2022-01-03,1,2,0.5,1.5,10\n2022-02-01,1,2,0.5,1.5,10\n")
    req = DataRequest.of({"universe": ["AAPL"], "start": "2022-01-01", "end": "2022-02-01", "frequency": "daily"})
    rows = providers.build({"provider": "csv", "path": str(tmp_path)}).load(spark, req).collect()
    assert [(r.symbol, r.close, r.frequency) for r in rows] == [("AAPL", 1.5, "1d")]
    a, b = (providers.build({"provider": "synthetic", "seed": 1}).load(spark, req) for _ in range(2))
    assert a.count() == 252 and a.exceptAll(b).count() == 0
    pages = {None: '{"code":"0","data":[["1641340800000","1","2","0.5","1.5","9","0","0","1"]]}', "1641340800000": '{"code":"0","data":[["1641254400000","1","2","0.5","1.5","9","0","0","1"]]}', "1641254400000": '{"code":"0","data":[]}'}
    got = providers.build({"provider": "okx", "fetch": lambda inst, bar, after: pages[after]}).load(spark, req)
    assert got.count() == 2
    rows = providers.build({"provider": "ccxt", "fetch": lambda s, a, b, f: [(1641340800000, 1, 2, 0.5, 1.5, 9), ("2022-01-06", 1, 2, 0.5, None, 9)]}).load(spark, req)
    assert [(r.timestamp, r.close) for r in rows.collect()] == [(datetime(2022, 1, 5), 1.5)]
    for bad in (lambda: providers.build({"provider": "zzz"}), lambda: frequency("2d"), lambda: DataRequest.of({"universe": [], "start": "2022-01-01", "end": "2022-02-01"})):
        with pytest.raises(ValueError):
            bad()


def test_stores(spark, tmp_path):
    log = store.RunLog(spark, str(tmp_path / "runs"))
    for run, state in (("a", "queued"), ("b", "queued"), ("a", "running"), ("a", "failed")):
        log.mark(run, state, "no" if state == "failed" else None)
    assert {(r.run_id, r.status, r.error) for r in log.latest().collect()} == {("a", "failed", "no"), ("b", "queued", None)}
    with pytest.raises(ValueError):
        log.mark("a", "lost")
    m = market(spark, {"A": [1.0, 2.0], "B": [3.0]})
    one, two = (store.content_hash(x).first() for x in (m, m.orderBy(F.rand()).select(*reversed(m.columns))))
    assert one == two and one.rows == 3 and len(one.content_hash) == 64
    assert store.content_hash(m.limit(2)).first().content_hash != one.content_hash
    rows = store.manifest(m, "r1", "market", "csv", "x").unionByName(store.manifest(m, "r2", "market", "csv", "x"))
    assert store.snapshots(rows).count() == 2 and store.snapshots(rows, "r1").first().symbols == "A,B"
    assert store.config_hash({"a": 1, "b": 2}) == store.config_hash({"b": 2, "a": 1})


def test_last_n_equals_the_batch_twin(spark, tmp_path):
    rows = spark.createDataFrame([(f"I{k % 3}", k, f"t{k}") for k in range(60)], "inst_id string, seq long, item string")
    rows.repartition(4).write.parquet(str(tmp_path / "t"))
    one_file_a_batch = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    got = feeds.run(state.last_n(one_file_a_batch, 5), "update", key="inst_id")
    want = feeds.last_n_batch(rows, 5)
    assert sorted(map(str, got.select("inst_id", "items").collect())) == sorted(map(str, want.collect()))


def test_the_whole_run(spark, tmp_path):
    config = {
        "data": {"provider": "synthetic", "universe": [{"symbol": "BTC-USD", "asset_class": "crypto"}, {"symbol": "ETH-USD", "asset_class": "crypto"}, "AAPL", "MSFT"], "start": "2022-01-01", "end": "2022-06-01", "frequency": "1d", "seed": 5},
        "factors": {"windows": [3, 5], "horizons": [1], "min_observations": 20}, "backtest": {"horizon": 1, "transaction_cost_bps": 5}, "walk_forward": {"enabled": True, "splits": 2, "embargo": 1}, "ml": {"enabled": True, "n_estimators": 4},
    }
    done = pipeline.Runner(spark, config).run(str(tmp_path / "run"))
    assert done["quality"][0]["status"] == "PASS" and done["source"][0]["status"] == "SIMULATED" and len(done["config_hash"]) == 64
    for name, path in done["artifacts"].items():
        n = spark.read.parquet(path).count()
        assert n > 0 or name in ("data_quality_issues", "derivatives_snapshot", "derivatives_history", "microstructure_snapshot", "onchain_metrics"), name
    site = pipeline.export_site(spark, str(tmp_path / "run"), str(tmp_path / "site"), 20)
    assert spark.read.json(site["market"]).groupBy("symbol").count().agg(F.max("count")).first()[0] == 20
    with pytest.raises(ValueError):
        pipeline.Runner(spark, {"data": {}}).run(str(tmp_path / "x"))
    stop = pipeline.RunContext(is_canceled=lambda: True)
    with pytest.raises(pipeline.Canceled):
        pipeline.Runner(spark, config, stop).frames()
