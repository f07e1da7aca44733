import time
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException

from factorlake.operators import backtest, store, technicals
from factorlake.plans import pipeline
from factorlake.schemas import MARKET, DataRequest
from factorlake.sources import onchain, providers
from factorlake.streaming import feeds
from factorlake.streaming.live import LiveFeed

T0 = datetime(2022, 1, 1)


def request(*symbols):
    return DataRequest.of({"universe": list(symbols), "start": "2022-01-01", "end": "2022-02-01", "frequency": "1d"})


def test_a_metric_that_fails_is_a_warning(spark):
    def fetch(asset, metric, start, end):
        if (asset, metric) == ("eth", "TxCnt"):
            raise OSError("no reply")
        return f"{asset} {metric} {start[:10]}"

    replies = onchain.Metrics(fetch).load(spark, request("btc/usd", "ETH-USD", "AAPL"))
    got = {(r.symbol.upper(), r.metric): (r.payload, r.warning) for r in replies.collect()}
    assert got["BTC/USD", "AdrActCnt"] == ("btc AdrActCnt 2022-01-01", None)
    assert got["ETH-USD", "AdrActCnt"] == ("eth AdrActCnt 2022-01-01", None) and got["ETH-USD", "TxCnt"] == (None, "TxCnt: no reply")
    assert got["AAPL", "TxCnt"] == (None, "no on-chain metrics of this asset") and len(got) == 6
    assert onchain.warnings(replies).count() == 3


def test_feeds_are_gated_by_config_and_provider():
    all_feeds = dict.fromkeys(pipeline.EMPTY, "frame")
    of = lambda **c: (lambda kept, warned: (sorted(kept), warned))(*pipeline.allowed_feeds(c, all_feeds))
    assert of(data={"provider": "synthetic"}) == ([], [])
    assert of(data={"provider": "OKX"}) == (["derivatives", "history", "micro"], [])
    assert of(data={"provider": "okx"}, derivatives={"history_enabled": False}, microstructure={"enabled": False}) == (["derivatives"], [])
    assert of(data={"provider": "okx"}, derivatives={"enabled": False}) == (["micro"], [])
    assert of(data={"provider": "csv"}, onchain={"metrics": ["TxCnt"]}) == (["onchain"], [])
    assert of(data={"provider": "csv"}, onchain={"enabled": False, "provider": "x"}) == ([], [])
    assert of(data={"provider": "csv"}, onchain={"provider": "other"}) == ([], ["unknown on-chain provider other"])


def test_live_series_and_last_rows(spark):
    rows = [(T0 + timedelta(hours=i), s, 1.0 + i % 7, 8.5, 0.5, 1.0 + (i * 5) % 7, 10.0, "crypto", "1h") for s in "AB" for i in range(80)]
    m = spark.createDataFrame(rows, MARKET)
    live = providers.live_series(m, "A", 25).collect()
    warm = technicals.panel(m.filter("symbol = 'A'").orderBy("timestamp", ascending=False).limit(55)).orderBy("timestamp").collect()
    assert live == warm[-25:] and live[-1].timestamp == T0 + timedelta(hours=79)
    assert len(providers.live_series(m, "A", 5000).collect()) == 80 and providers.live_series(m, "none").count() == 0
    last = store.last_rows(m, ["timestamp", "symbol"], 1).collect()
    assert len(last) == 25 and (last[-1].timestamp, last[-1].symbol, last[0].symbol) == (T0 + timedelta(hours=79), "B", "B")


def test_sides_are_apart(spark):
    schema = "timestamp timestamp_ntz, symbol string, weight double"
    w = spark.createDataFrame([(T0, "A", 0.5), (T0, "B", 0.5), (T0, "C", -1.0)], schema)
    assert [tuple(r)[1:] for r in backtest.sides(w).collect()] == [(2, 1, 2.0, 0.0)]
    assert backtest.sides(w.limit(0)).count() == 0
    both = w.unionByName(spark.createDataFrame([(T0, "A", -1.0)], schema))
    with pytest.raises(PySparkException, match="both sides"):
        backtest.sides(both).collect()


def test_a_live_feed_counts_and_stops(spark, tmp_path):
    spark.range(7).write.parquet(f"{tmp_path}/in")
    seen = []
    feed = LiveFeed(feeds.read(spark, f"{tmp_path}/in"), lambda batch, k: seen.append(batch.count()), f"file://{tmp_path}/state", 100)
    assert feed.status() == {"state": "idle", "messages": 0, "error": None}
    feed.start()
    until = time.time() + 60
    while feed.messages() < 7 and time.time() < until:
        time.sleep(0.2)
    assert feed.state() == "running" and feed.messages() == 7 and sum(seen) == 7
    feed.stop()
    assert feed.status() == {"state": "stopped", "messages": 7, "error": None}

    def broken(batch, k):
        raise ValueError("no room")

    bad = LiveFeed(feeds.read(spark, f"{tmp_path}/in"), broken, f"file://{tmp_path}/state-2", 100).start()
    while bad.state() in ("starting", "running") and time.time() < until:
        time.sleep(0.2)
    assert bad.state() == "error" and "no room" in bad.status()["error"]
