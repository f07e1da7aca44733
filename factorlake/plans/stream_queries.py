"""Queries that run a stream to its present end; their SQL is over the finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.functions.numerics import rounded
from factorlake.functions import workdir
from factorlake.sources import bars, polled
from factorlake.streaming import feeds, state


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = feeds.read(spark, f"{d}/events.parquet")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq"), "user_id")


def _routed(spark: SparkSession, d: str) -> DataFrame:
    return feeds.route(feeds.as_messages(feeds.read(spark, f"{d}/events.parquet")))


def _latest(table: DataFrame) -> DataFrame:
    return table.select("inst_id", F.concat_ws(",", "items").alias("items"))


def _trades(spark: SparkSession, d: str) -> DataFrame:
    t = feeds.trades(_routed(spark, d)).select("inst_id", F.col("trade_id").cast("long").alias("seq"), F.col("trade_id").alias("item"))
    return feeds.run(state.last_n(t, 20), "update", _latest, "inst_id")


def _buffer(items) -> object:
    """The newest of a routed feed's items."""
    return lambda s, d: feeds.run(state.last_n(items(_routed(s, d)), 30), "update", _latest, "inst_id")


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """(inst_id, payload): the reply of an exchange's trade route for each type of event, its newest forty."""
    e = bars.read(spark, d, "events")
    w = Window.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").cast("string")
    x = F.struct("r", F.struct(F.round(F.col("value") + 1.0, 4).cast("string").alias("px"), (F.col("event_id") % 7 + 1).cast("string").alias("sz"), F.when(F.col("user_id") % 2 == 0, "BUY").otherwise("sell").alias("side"), ms.alias("ts")).alias("x"))
    newest = e.withColumn("r", F.row_number().over(w)).filter("r <= 40").groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["x"]).alias("data"))
    return newest.select(F.concat(F.upper("event_type"), F.lit("-USDT")).alias("inst_id"), F.to_json(F.struct(F.lit("0").alias("code"), "data")).alias("payload"))


def _polled(spark: SparkSession, d: str) -> DataFrame:
    """One poll of these replies, through the streaming source."""
    path = workdir.fresh(spark, "replies")
    _replies(spark, d).write.parquet(path)

    def fetch(poll: int) -> list[tuple[str, str, str]]:
        from pyarrow import dataset

        return [(r["inst_id"], "trades", r["payload"]) for r in dataset.dataset(path, format="parquet").to_table().to_pylist()]

    return rounded(feeds.run(polled.stream(spark, fetch, workdir.fresh(spark, "polls"), every_ms=1), finish=polled.newest_trades))


def queries() -> dict:
    return {
        "stream_route": lambda s, d: feeds.run(_routed(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "complete"),
        "stream_latest_book": lambda s, d: rounded(feeds.run(feeds.latest_books(feeds.books(_routed(s, d))), "complete")),
        "stream_last_n_trades": _trades,
        "stream_last_n_liquidations": _buffer(feeds.liquidation_items),
        "stream_last_n_events": _buffer(feeds.event_items),
        "stream_polled_snapshot": _polled,
        "stream_liq_explode": lambda s, d: rounded(feeds.run(feeds.liquidations(_routed(s, d)))),
        # Update mode lets the watermark end a window's state; each window's last row counts.
        "stream_tumbling_bars": lambda s, d: rounded(feeds.run(feeds.tumbling_bars(_events(s, d), "1 hour"), "update", key=("timestamp", "symbol"))),
        "stream_sliding": lambda s, d: rounded(feeds.run(feeds.sliding(_events(s, d), "2 hours", "1 hour"), "update", key=("start", "symbol"))),
        "stream_session": lambda s, d: rounded(feeds.run(feeds.sessions(_events(s, d), "30 minutes"), "complete")),
        "stream_dedup": lambda s, d: feeds.run(feeds.dedup(_events(s, d), "symbol", "user_id")),
    }


_PX = "round(value + 1.0::DOUBLE, 4)"
_MS = "date_trunc('millisecond', ts)::TIMESTAMP"
_INST = "upper(event_type) || '-USDT'"


def oracle_sql() -> dict[str, str]:
    kind = "CASE WHEN event_id % 10 = 0 THEN 'pong' WHEN event_id % 10 = 1 THEN 'invalid' WHEN event_id % 10 = 2 THEN 'error' WHEN event_id % 10 = 3 THEN 'liquidation' WHEN event_id % 10 < 7 THEN 'trade' ELSE 'book' END"
    return {
        "stream_route": f"SELECT {kind} AS kind, count(*)::BIGINT AS n FROM events GROUP BY ALL",
        "stream_latest_book": f"""WITH b AS (SELECT {_INST} AS inst_id, {_MS} AS timestamp, {_PX} AS best_bid, round(value + 1.0::DOUBLE + 0.5, 4) AS best_ask, round(value + 1.0::DOUBLE - 0.5, 4) AS second, event_id AS seq_id FROM events WHERE event_id % 10 >= 7
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1)
SELECT inst_id, timestamp, round(best_bid, 6) AS best_bid, round(best_ask, 6) AS best_ask, round((best_bid + best_ask) / 2, 6) AS mid_price, round(best_bid * 2 + second * 3, 6) AS bid_depth_usd, round(best_ask, 6) AS ask_depth_usd, seq_id,
  round((best_ask - best_bid) / nullif((best_bid + best_ask) / 2, 0) * 10000, 6) AS spread_bps FROM b""",
        "stream_last_n_trades": f"SELECT {_INST} AS inst_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id DESC) AS items FROM (SELECT * FROM events WHERE event_id % 10 BETWEEN 4 AND 6 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 20) GROUP BY event_type",
        "stream_last_n_liquidations": f"""SELECT inst_id, string_agg(item, ',' ORDER BY event_id DESC, item DESC) AS items FROM (
  SELECT {_INST} || '-SWAP' AS inst_id, event_id, s || ' 4 ' || {_PX}::VARCHAR AS item FROM events, (VALUES ('buy'), ('sell')) t(s) WHERE event_id % 10 = 3
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC, item DESC) <= 30) GROUP BY inst_id""",
        "stream_last_n_events": """SELECT inst_id, string_agg(item, ',' ORDER BY event_id DESC) AS items FROM (
  SELECT CASE event_id % 10 WHEN 0 THEN 'pong' WHEN 1 THEN 'invalid' ELSE 'error' END AS inst_id, event_id, CASE event_id % 10 WHEN 0 THEN 'pong' WHEN 1 THEN '{broken' ELSE '{"event":"error","code":"1","msg":"x"}' END AS item FROM events WHERE event_id % 10 < 3
  QUALIFY row_number() OVER (PARTITION BY event_id % 10 ORDER BY event_id DESC) <= 30) GROUP BY inst_id""",
        "stream_polled_snapshot": f"""WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 40)
SELECT 0::BIGINT AS poll, {_INST} AS inst_id, {_MS} AS timestamp, round({_PX}, 6) AS price, (event_id % 7 + 1)::DOUBLE AS size, CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM e
QUALIFY row_number() OVER (ORDER BY timestamp DESC, inst_id, price, size, side) <= 80""",
        "stream_liq_explode": f"SELECT {_MS} AS timestamp, {_INST} || '-SWAP' AS inst_id, 'SWAP' AS inst_type, s AS side, 4.0::DOUBLE AS size, round({_PX}, 6) AS bankruptcy_price FROM events, (VALUES ('buy'), ('sell')) t(s) WHERE event_id % 10 = 3",
        "stream_tumbling_bars": "SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp, event_type AS symbol, round(first(value ORDER BY ts, event_id), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(last(value ORDER BY ts, event_id), 6) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL",
        "stream_sliding": "SELECT s AS start, s + INTERVAL 2 HOUR AS \"end\", event_type AS symbol, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM (SELECT date_trunc('hour', ts)::TIMESTAMP - INTERVAL 1 HOUR * k AS s, * FROM events, range(2) t(k)) GROUP BY ALL",
        "stream_session": """SELECT min(ts)::TIMESTAMP AS start, max(ts)::TIMESTAMP + INTERVAL 30 MINUTE AS "end", event_type AS symbol, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM (
  SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events)) GROUP BY event_type, g""",
        "stream_dedup": "SELECT DISTINCT event_type AS symbol, user_id FROM events",
    }
