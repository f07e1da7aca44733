import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from factorlake.operators import backtest, cockpit, store
from factorlake.plans import configs, pipeline, site
from factorlake.schemas import CODES, FREQUENCIES, DataRequest, code
from factorlake.sources import providers

GOOD = {
    "data": {"provider": "synthetic", "universe": [{"symbol": "BTC-USD", "asset_class": "crypto"}, "AAPL", "MSFT"], "start": "2022-01-01", "end": "2022-06-01", "frequency": "1d", "seed": 5},
    "factors": {"windows": [3, 5], "horizons": [1], "min_observations": 20}, "backtest": {"horizon": 1, "transaction_cost_bps": 5},
}


def changed(section, **values):
    return GOOD | {section: GOOD.get(section, {}) | values}


def without(section, key):
    return GOOD | {section: {k: v for k, v in GOOD[section].items() if k != key}}


BAD = {
    "no object": [], "no data": {k: v for k, v in GOOD.items() if k != "data"}, "factors a list": GOOD | {"factors": [1]}, "no start": without("data", "start"), "no universe": changed("data", universe=[]),
    "end first": changed("data", end="2021-01-01"), "no time": changed("data", start="soon"), "frequency": changed("data", frequency="2d"), "asset class": changed("data", universe=[{"symbol": "A", "asset_class": "bond"}]),
    "twice": changed("data", universe=["A", "A"]), "empty symbol": changed("data", universe=[" "]), "provider": changed("data", provider="zzz"), "rules": GOOD | {"adjustments": {"symbol": "A"}},
    "rule field": changed("data", adjustments=[{"symbol": "A", "field": "price", "value": 1}]), "windows": changed("factors", windows=[]), "window of one": changed("factors", windows=[1]), "half a window": changed("factors", windows=[2.5]),
    "horizon zero": changed("factors", horizons=[0]), "observations": changed("factors", min_observations=0), "mode": changed("backtest", mode="short"), "horizon": changed("backtest", horizon=0),
    "other horizon": changed("backtest", horizon=5), "direction": changed("backtest", direction=0), "quantile": changed("backtest", quantile="wide"), "costs": changed("backtest", slippage_bps=float("nan")), "null cost": changed("backtest", slippage_bps=None),
    "walk forward": changed("walk_forward", n_folds=3), "ml": GOOD | {"ml": True},
}


@pytest.mark.parametrize("what", BAD)
def test_what_is_refused(what):
    with pytest.raises(ValueError):
        configs.validate(BAD[what])


def test_saved_whole_or_not_at_all(tmp_path):
    path = tmp_path / "a" / "config.json"
    configs.save(path, GOOD)
    with pytest.raises(ValueError):
        configs.save(path, BAD["mode"])
    assert configs.load(path) == GOOD and [p.name for p in path.parent.iterdir()] == ["config.json"]
    path.write_text(json.dumps(BAD["mode"]))
    with pytest.raises(ValueError):
        configs.load(path)


def test_folders_stay_within(tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "out").symlink_to(tmp_path)
    root = tmp_path / "root"
    assert configs.confined(root, "runs/1") == root / "runs" / "1" and configs.confined(root, root) == root
    for path in ("../x", "/etc", "out/x", str(tmp_path)):
        with pytest.raises(ValueError):
            configs.confined(root, path)
    assert site.allowed_target(root, "site", root / "runs") == root / "site"
    for path in (".", "runs/1", ".git", "tests"):
        with pytest.raises(ValueError):
            site.allowed_target(root, path, root / "runs" / "1")


def test_presets():
    for name, p in configs.PRESETS.items():
        c = configs.preset(name, date(2024, 3, 1))
        assert c["data"]["end"] == "2024-03-02" and c["backtest"]["horizon"] == p["horizon"] and c["ml"]["enabled"] == (name == "deep")
    assert configs.preset("smoke", date(2024, 3, 1))["data"]["start"] == "2024-02-20"
    with pytest.raises(ValueError):
        configs.preset("none", date(2024, 3, 1))


def test_bar_codes():
    assert all(set(c) == set(FREQUENCIES) for c in CODES.values())
    assert (code("daily", "okx"), code("1h", "okx"), code("5min", "pandas"), code("1m", "ccxt")) == ("1Dutc", "1H", "5min", "1m")
    with pytest.raises(ValueError):
        code("1d", "none")


def test_downloads_and_pages(spark):
    request = DataRequest.of({"universe": ["A", {"symbol": "B", "asset_class": "crypto"}, "C"], "start": "2022-01-01", "end": "2022-01-04", "frequency": "1h"})
    bar = {"Open": 1, "High": 2.0, "Low": 0.5, "Close": 1.5, "Volume": 10}

    def download(symbol, start, end, interval):
        assert (start, end, interval) == ("2022-01-01", "2022-01-04", "1h")
        return {"A": [{"Datetime": datetime(2022, 1, 1, 5), "Date": "x"} | bar, {"Datetime": datetime(2022, 1, 1, 6)} | bar | {"Close": float("nan")}], "B": [{"Date": "2022-01-02"} | bar], "C": []}[symbol]

    got = providers.build({"provider": "yfinance", "download": download}).load(spark, request)
    assert sorted((r.symbol, r.timestamp, r.close, r.asset_class, r.frequency) for r in got.collect()) == [("A", datetime(2022, 1, 1, 5), 1.5, "equity", "1h"), ("B", datetime(2022, 1, 2), 1.5, "crypto", "1h")]
    with pytest.raises(RuntimeError):
        providers.build({"provider": "yfinance", "download": lambda *a: []}).load(spark, request)

    def page(symbol, timeframe, since):
        assert (timeframe, since) == ("1h", 1640995200000)
        return [(since + k * 86_400_000, 1, 2, 0.5, 1.5, 10) for k in range(5)] if symbol == "A" else []

    got = providers.build({"provider": "ccxt", "ohlcv": page}).load(spark, request)
    assert [r.timestamp.day for r in got.orderBy("timestamp").collect()] == [1, 2, 3]


def test_config_of_a_backtest(spark):
    c = backtest.BacktestConfig.of({"horizon": "2", "spread_cost_multiplier": 0.5, "funding_cost_multiplier": 2, "top_n": None, "direction": -1, "name": "x"})
    assert (c.horizon, c.spread_multiplier, c.funding_multiplier, c.top_n, c.direction) == (2, 0.5, 2.0, None, -1)
    w = spark.createDataFrame([(datetime(2022, 1, 2), "A", 1.0)], "timestamp timestamp_ntz, symbol string, weight double")
    rates = spark.createDataFrame([(datetime(2022, 1, 1), "A", "0.5")], "timestamp timestamp_ntz, symbol string, paid string")
    for column, want in (("paid", 0.5), ("other", 0.0)):
        config = backtest.BacktestConfig(funding_enabled=True, annualization=1, funding_rate_column=column)
        assert backtest.funding_costs(w, rates, config).first().funding_cost == want


def test_texts_do_not_tell_the_root(spark):
    rows = spark.createDataFrame([("/home/a.b/x/1", float("nan"), None), ("/home/a.b", 1.0, "see /home/a.b"), ("/home/a.bc", float("inf"), '"/home/a.b/q')], "p string, v double, t string")
    got = [json.loads(r.value) for r in site.as_json(rows, "/home/a.b").collect()]
    assert got == [{"p": "./x/1", "v": None, "t": None}, {"p": ".", "v": 1.0, "t": "see /home/a.b"}, {"p": "/home/a.bc", "v": None, "t": '"/home/a.b/q'}]
    assert json.loads(site.scrubbed(json.dumps({"a": ["/home/a.b/x", "/home/aXb/x"]}), "/home/a.b")) == {"a": ["./x", "/home/aXb/x"]}


def test_rows_of_a_table_in_csv_are_in_order(spark, tmp_path):
    folds = spark.createDataFrame([(k, 0.5 * k) for k in (10, 2, 9)], "fold int, test_sharpe double")
    store.write_artifacts({"walk_forward": folds}, str(tmp_path), csv=True)
    back = site.read(spark, str(tmp_path), "walk_forward", csv=True)
    assert [r["fold"] for r in site.records(back, "walk_forward", 2)] == [2, 9] and [r["fold"] for r in site.records(back, "walk_forward", -2)] == [9, 10]
    assert site.records(back, "walk_forward", None)[0] == {"fold": 2, "test_sharpe": 1.0}


def test_a_whole_export(spark, tmp_path, csv=False):
    run, target = str(tmp_path / "out" / "1"), str(tmp_path / "site")
    runner = pipeline.Runner(spark, GOOD)
    done = runner.run(run, csv)
    assert done["symbols"] == ["AAPL", "BTC-USD", "MSFT"] and done["rows"] == 3 * 151 and len(done["technical_indicators"]) == 120 and not runner._kept
    assert done["factor_count"] == done["candidate_count"] and done["onchain_health"] == {"warnings": [], "rows": 0}
    seen = site.snapshot(spark, run, str(tmp_path))
    assert seen["folder"] == "./out/1" and len(seen["tables"]["market_data"]) == 50 and set(seen["equity_curve"][0]) == {"timestamp", "equity_curve", "net_return"}
    assert seen["tables"]["market_data"][-1]["timestamp"] == max(r["timestamp"] for r in seen["tables"]["market_data"])
    out = pipeline.export_site(spark, run, target, 1, str(tmp_path), GOOD)
    assert set(done["artifacts"]) < set(out)
    for name in done["artifacts"]:
        lines = spark.read.text(out[name]).collect()
        assert len(lines) == site.read(spark, run, name, csv).count() and all(str(tmp_path) not in r.value and isinstance(json.loads(r.value), dict) for r in lines), name
    shown = spark.read.json(out["market"])
    assert shown.groupBy("symbol").count().agg(F.max("count")).first()[0] == 20 and "rsi_14" in shown.columns
    for name in ("summary", "config", "health", "realtime", "runs", "manifest"):
        text = spark.read.option("wholetext", True).text(out[name]).first().value
        assert str(tmp_path) not in text and "NaN" not in text and json.loads(text) is not None


def test_cockpit_without_anything_but_bars(spark):
    m = spark.createDataFrame([(datetime(2022, 1, k), s, float(k)) for s, n in (("A", 3), ("B", 2)) for k in range(1, n + 1)], "timestamp timestamp_ntz, symbol string, close double")
    empty = lambda columns: spark.createDataFrame([], columns)
    out = cockpit.view(
        m, empty("symbol string, stance string, confidence double, primary_factor string, risk_note string"), empty("symbol string, signal string, signal_score double, confidence double, factor string, theme string"),
        empty("symbol string, technical_bias string, confidence double, trend_state string"), empty("symbol string, timestamp timestamp_ntz, microstructure_label string, spread_bps double"),
        empty("symbol string, timestamp timestamp_ntz, annualized_funding_rate double, crowding string, crowding_label string"), empty("symbol string, timestamp timestamp_ntz, onchain_label string"), empty("test_sharpe double"),
    )
    got = {r.symbol: r for r in out.collect()}
    assert got["A"].last_change == 0.5 and got["B"].last_change is None
    assert all((r.bias, r.confidence, r.regime, r.conflicts, r.folds) == ("NEUTRAL", None, "waiting", "chain=missing", 0) for r in got.values())
