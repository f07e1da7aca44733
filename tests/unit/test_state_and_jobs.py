import json
import time
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factorlake.operators.store import RunLog
from factorlake.plans import jobs
from factorlake.schemas import DataRequest
from factorlake.sources import onchain, polled
from factorlake.streaming import feeds, live, state

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def wait_for(test, seconds=90):
    end = time.time() + seconds
    while not test():
        assert time.time() < end, "it took too long"
        time.sleep(0.1)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    yield
    spark.conf.set(ROCKS[0], before)


def test_the_newest_over_batches_and_a_restart(spark, rocks, tmp_path):
    fields = "inst_id string, seq long, item string"
    rows = [("A" if k % 3 else "B", (k * 37) % 100, f"i{k % 11}") for k in range(120)] + [("A", 99, "tie"), ("A", 99, "tie"), ("C", 1, "only")]
    last = defaultdict(list)

    def run(part):
        spark.createDataFrame(part, fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        note = lambda batch, _: last.update({r["inst_id"]: r["items"] for r in batch.collect()})
        q = state.last_n(stream, 7).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(note).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None

    run(rows[:50])
    run(rows[50:])  # started again over the same state
    want = {r["inst_id"]: r["items"] for r in feeds.last_n_batch(spark.createDataFrame(rows, fields), 7).collect()}
    assert dict(last) == want


class Counter:
    """A fetch that fails at its second call."""

    def __init__(self):
        self.calls = 0

    def __call__(self, poll):
        self.calls += 1
        if self.calls == 2:
            raise OSError("no route")
        return [("X", "trades", json.dumps({"code": "0", "data": [{"px": str(poll), "sz": "1", "side": "BUY", "ts": str(1000 * k)} for k in range(60)]})), ("Y", "book", "{}")]


def test_a_poll_is_kept_until_it_is_committed(tmp_path):
    fetch = Counter()
    p = polled.Poller(fetch, str(tmp_path / "polls"), 1)
    rows, one = p.read(p.initialOffset())
    rows = list(rows)
    assert [r[:3] for r in rows] == [(0, "X", "trades"), (0, "Y", "book")] and one["poll"] == 1
    again = polled.Poller(fetch, str(tmp_path / "polls"), 1)  # a restart reads the same, without a fetch
    assert list(again.readBetweenOffsets(p.initialOffset(), one)) == rows and fetch.calls == 1
    time.sleep(0.01)
    failed, two = again.read(one)
    assert [(r[0], r[2], "no route" in r[3]) for r in failed] == [(1, "error", True)]
    again.commit(two)
    assert not list((tmp_path / "polls").glob("*.json"))
    assert polled.Poller(fetch, str(tmp_path / "polls"), 60_000).read(two)[1] == two  # not before the interval is over
    assert fetch.calls == 2


def test_polls_stream_on_after_a_restart(spark, tmp_path):
    seen = []
    fetch = lambda poll: [("X", "trades", json.dumps({"code": "0", "data": [{"px": "1", "sz": "1", "side": "buy", "ts": "5"}]}))]

    def run(until):
        s = polled.stream(spark, fetch, str(tmp_path / "polls"), every_ms=200, name="polled_test")
        q = s.writeStream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda b, _: seen.extend(r["poll"] for r in b.collect())).trigger(processingTime="100 milliseconds").start()
        wait_for(lambda: len(seen) >= until or q.exception())
        q.stop()

    run(2)
    run(5)
    assert seen == list(range(len(seen)))


def test_newest_trades_of_a_poll(spark):
    reply = lambda inst, k: (0, inst, "trades", json.dumps({"code": "0", "data": [{"px": "1", "sz": "1", "side": "BUY", "ts": str(1000 * i)} for i in range(k)]}))
    df = spark.createDataFrame([reply("A", 60), reply("B", 60), (0, "A", "book", "{}"), (0, None, "error", "x")], polled.SCHEMA)
    got = polled.newest_trades(df)
    assert got.count() == 80 and got.agg(F.min("timestamp")).first()[0] == datetime(1970, 1, 1, 0, 0, 20)


def test_jobs_end_by_a_cancel(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    j = jobs.Jobs(spark, log, at_once=2)

    def slow(context):
        def wait(frames):
            for f in frames:
                time.sleep(25)
                yield f

        spark.range(0, 2, 1, 2).mapInPandas(wait, "id long").count()

    j.submit("slow", slow)
    j.submit("quick", lambda c: spark.range(10).count())
    j.submit("bad", lambda c: 1 / 0)
    assert j.wait("quick", 60)
    wait_for(lambda: any(i for i in spark.sparkContext.statusTracker().getActiveJobsIds()))
    began = time.time()
    assert j.cancel("slow") and j.wait("slow", 20) and time.time() - began < 20
    assert j.wait("bad", 60) and not j.cancel("bad") and not j.cancel("unknown")
    got = {r.run_id: (r.status, r.error) for r in log.latest().collect()}
    assert got["slow"] == ("canceled", None) and got["quick"] == ("succeeded", None) and got["bad"][0] == "failed" and "ZeroDivisionError" in got["bad"][1]
    with pytest.raises(ValueError):
        j.submit("bad", slow)


def test_a_supervised_query_comes_back_from_its_checkpoint(spark, tmp_path):
    seen, tries = [], []
    spark.range(5).write.parquet(str(tmp_path / "in"))

    def write(batch, epoch):
        tries.append(epoch)
        if len(tries) <= 2:
            raise RuntimeError("the sink is away")
        seen.extend(r["id"] for r in batch.collect())

    def start():
        s = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        return s.writeStream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(write).trigger(processingTime="200 milliseconds").start()

    s = live.Supervisor(spark, start, first=0.2, longest=0.3)
    assert s.state() == "idle"
    s.start()
    try:
        wait_for(lambda: len(seen) == 5)
        assert sorted(seen) == list(range(5)) and len(s.failures) == 2 and s.waits == [0.2, 0.3] and s.state() == "running"
    finally:
        s.stop()
    assert s.state() == "stopped" and not s.query.isActive


def test_fetched_metrics_become_the_context(spark):
    def fetch(asset, metric, start, end):
        if (asset, metric) == ("eth", "TxCnt"):
            raise OSError("away")
        if asset == "eth":
            return '{"data":[]}'
        return json.dumps({"data": [{"asset": asset, "time": f"2022-01-{k:02d}T00:00:00.000000000Z", metric: str(100 + 10 * k)} for k in range(1, 10)]})

    request = DataRequest.of({"universe": [{"symbol": "BTC-USD", "asset_class": "crypto"}, {"symbol": "ETH-USD", "asset_class": "crypto"}, "AAPL"], "start": "2022-01-01", "end": "2022-02-01", "frequency": "1d"})
    replies = onchain.Metrics(fetch).load(spark, request)
    rows = onchain.context_of(replies).orderBy("timestamp").collect()
    assert len(rows) == 9 and {r.symbol for r in rows} == {"BTC-USD"} and rows[-1].onchain_label == "EXPANSION"
    assert rows[-1].active_addresses == 190.0 and rows[-1].active_address_change == pytest.approx(190 / 120 - 1) and rows[0].timestamp == datetime(2022, 1, 1)
    said = sorted((r.symbol, r.warning) for r in onchain.context_warnings(replies).collect())
    assert ("ETH-USD", "AdrActCnt came without rows") in said and ("ETH-USD", "TxCnt: away") in said and not any(s == "BTC-USD" for s, _ in said)
