import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from factorlake.schemas import DataRequest
from factorlake.sources import exchange, providers

T0 = datetime(2022, 1, 1)
REQUEST = {"universe": [{"symbol": "BTC-USD", "asset_class": "crypto"}, {"symbol": "AAPL", "asset_class": "equity"}], "start": "2022-01-01", "end": "2022-01-11", "frequency": "1h"}


class Exchange:
    """Hourly candles of ten days, newest first, `size` a reply; the calls named fail once."""

    def __init__(self, size=50, fails=()):
        self.size, self.fails, self.calls = size, set(fails), []

    def __call__(self, inst_id, bar, after):
        self.calls.append((inst_id, int(after)))
        if len(self.calls) in self.fails:
            raise OSError("too many requests")
        hours = [h for h in range(240) if exchange.millis_of(T0) + 3_600_000 * h < int(after)][-self.size :]
        return json.dumps({"code": "0", "data": [[str(exchange.millis_of(T0) + 3_600_000 * h), str(h), "2", "x", "NaN", "5", "0", "0", "0" if h == 239 else "1"] for h in reversed(hours)]})


def reader(kind=exchange.CandleReader, fetch=None, attempts=3):
    r = DataRequest.of(REQUEST)
    return kind(fetch or Exchange(), [("BTC-USD", "BTC-USDT", "crypto"), ("AAPL", "AAPL-USDT", "equity")], "1h", exchange.millis_of(r.start), exchange.millis_of(r.end), 100, attempts, 0.0)


def test_pages_cover_each_candle_once():
    r = reader()
    pages = r.partitions()
    assert len(pages) == 6
    rows = [row for p in pages for row in r.read(p)]
    assert len(rows) == len({row[:2] for row in rows}) == 480 and {row[7] for row in rows if row[1] == "AAPL"} == {"equity"}
    assert rows[0][4] is None  # what is no number


def test_a_request_that_fails_is_made_again_alone():
    calm, shaky = Exchange(), Exchange(fails=(2,))
    a, b = reader(fetch=calm), reader(fetch=shaky)
    page = a.partitions()[0]
    assert list(a.read(page)) == list(b.read(page))
    assert len(shaky.calls) == len(calm.calls) + 1 and shaky.calls[1] == shaky.calls[2]
    with pytest.raises(OSError):
        list(reader(fetch=Exchange(fails=range(1, 9))).read(page))


def test_filters_rule_out_instruments_and_pages():
    r = reader(exchange.PushedCandleReader)
    given = [EqualTo(("symbol",), "AAPL"), GreaterThanOrEqual(("timestamp",), T0 + timedelta(hours=150)), LessThan(("timestamp",), T0 + timedelta(hours=170)), IsNotNull(("symbol",))]
    assert list(r.pushFilters(given)) == given[1:]
    assert [(p.symbol, p.end - p.start) for p in r.partitions()] == [("AAPL", 20 * 3_600_000 + 1)]
    none = reader(exchange.PushedCandleReader)
    list(none.pushFilters([In(("symbol",), ("X",))]))
    assert [list(none.read(p)) for p in none.partitions()] == [[]]


def test_the_source_in_a_session(spark):
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    try:
        for on in ("true", "false"):
            spark.conf.set(key, on)
            bars = exchange.load(spark, Exchange(), DataRequest.of(REQUEST), per_page=100)
            some = bars.filter((F.col("symbol") == "BTC-USD") & (F.col("timestamp") >= F.lit(T0 + timedelta(hours=200)).cast("timestamp_ntz")))
            assert some.count() == 39 and bars.count() == 478  # the open candle is left out
            if on == "true":
                assert some.rdd.getNumPartitions() == 1 and bars.rdd.getNumPartitions() == 6
    finally:
        spark.conf.set(key, before)


def test_candles_of_a_provider_keep_each_asset_class(spark):
    reply = json.dumps({"code": "0", "data": [[str(exchange.millis_of(T0)), "1", "2", "1", "2", "5", "0", "0", "1"]]})
    got = providers.Candles(lambda inst, bar, after: reply).load(spark, DataRequest.of(REQUEST))
    assert {r.symbol: r.asset_class for r in got.collect()} == {"BTC-USD": "crypto", "AAPL": "equity"}
