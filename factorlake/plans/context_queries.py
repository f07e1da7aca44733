"""Queries of context feeds, source health, signals, decision cards, set operations and stores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.functions import workdir
from factorlake.functions.numerics import rounded
from factorlake.operators import backtest, cockpit, context, decisions, evaluation, factors, mining, signals, store
from factorlake.plans import factor_queries as Q
from factorlake.plans import sqltext as S
from factorlake.plans import technical_queries as T
from factorlake.schemas import DataRequest
from factorlake.sources import bars, exchange, onchain, payloads

NOW = datetime(2024, 2, 1, 0, 0, 0)


def _ms(c):
    return F.unix_millis(F.col(c).cast("timestamp")).cast("string") if isinstance(c, str) else F.unix_millis(c.cast("timestamp")).cast("string")


def _text(c):
    return F.format_string("%.6f", c)


def _reply(*items):
    return F.to_json(F.struct(F.lit("0").alias("code"), F.lit("").alias("msg"), F.array(*items).alias("data")))


def _per_type(spark: SparkSession, d: str) -> DataFrame:
    e = bars.read(spark, d, "events")
    g = e.groupBy(F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("v"), F.max("ts").alias("t"))
    return g.withColumn("inst_id", F.concat(F.upper("symbol"), F.lit("-USDT-SWAP")))


def _funding(spark: SparkSession, d: str) -> DataFrame:
    p = _per_type(spark, d)
    item = F.struct("inst_id", F.lit("SWAP").alias("instType"), _text((F.col("v") - 49.8) / 1000.0).alias("fundingRate"), F.lit("0.0001").alias("premium"), F.lit("").alias("interestRate"), _ms("t").alias("ts"), _ms("t").alias("nextFundingTime"))
    return p.select("symbol", "inst_id", _reply(item).alias("payload"))


def _interest(spark: SparkSession, d: str) -> DataFrame:
    p = _per_type(spark, d).filter("symbol <> 'view'")
    item = F.struct("inst_id", F.lit("SWAP").alias("instType"), F.col("n").cast("string").alias("oi"), F.lit("bad").alias("oiCcy"), _text(F.col("n") * 1e6).alias("oiUsd"), _ms(F.col("t") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    return p.select("symbol", "inst_id", _reply(item).alias("payload"))


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    return context.derivatives_snapshot(_funding(spark, d), _interest(spark, d))


def _history_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = bars.events_hourly(spark, d).withColumn("inst_id", F.concat(F.upper("symbol"), F.lit("-USDT-SWAP")))
    h = F.hour("timestamp")
    listed = lambda x: F.to_json(F.struct(F.lit("0").alias("code"), F.lit("").alias("msg"), F.collect_list(x).alias("data"))).alias("payload")
    by = lambda keep, x: b.filter(keep).groupBy("symbol", "inst_id").agg(listed(x))
    f = by(h % 8 == 0, F.struct("inst_id", F.lit("SWAP").alias("instType"), _text(F.col("close") / 1e4).alias("fundingRate"), _text(F.col("open") / 1e4).alias("realizedRate"), _ms("timestamp").alias("fundingTime")))
    o = by(h % 6 == 0, F.array(_ms("timestamp"), _text(F.col("high")), F.lit("x"), _text(F.col("volume") * 1e6)))
    r = by(h % 4 == 0, F.array(_ms("timestamp"), _text(F.col("low") + 1.0)))
    return f, o, r


def history(spark: SparkSession, d: str) -> DataFrame:
    return context.derivatives_history(*_history_parts(spark, d), start=datetime(2024, 1, 2), end=datetime(2024, 1, 29))


def micro(spark: SparkSession, d: str) -> DataFrame:
    p = _per_type(spark, d)
    s = lambda x: F.format_string("%.4f", x)
    lv = lambda price, size: F.array(s(price), size)
    mid = F.col("v") + 100.0
    wide = F.when(F.col("symbol") == "view", 1.0).otherwise(0.01)
    book = F.struct(_ms("t").alias("ts"), F.array(lv(mid - wide, F.lit("3")), lv(mid - 1.0, F.lit("4")), F.array(F.lit("1"))).alias("bids"), F.array(lv(mid + wide, F.lit("2")), lv(mid + 1.0, F.lit("oops"))).alias("asks"))
    trade = lambda side, k: F.struct(s(mid).alias("px"), F.lit("1.5").alias("sz"), F.lit(side).alias("side"), _ms(F.col("t") + F.expr(f"INTERVAL {k} SECOND")).alias("ts"))
    b = p.select("symbol", "inst_id", _reply(book).alias("payload"))
    t = p.select("inst_id", _reply(trade("BUY", 5), trade("sell", 4), trade("buy", 3)).alias("payload"))
    return context.microstructure(b, t)


def chain(spark: SparkSession, d: str) -> DataFrame:
    o = bars.read(spark, d, "orders")
    day = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    g = o.groupBy(day.alias("timestamp"), F.col("o_orderpriority").alias("symbol")).agg(F.count_distinct("o_custkey").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("c"))
    key = lambda x: ["timestamp", "symbol", F.lit("community").alias("provider"), F.lower("symbol").alias("asset"), x]
    a = g.filter(F.month("timestamp") != 3).select(*key(F.col("a").alias("active_addresses")))
    c = g.filter(F.month("timestamp") != 7).select(*key(F.col("c").alias("tx_count")))
    return context.onchain(a, c)


def fetched_chain(spark: SparkSession, d: str) -> DataFrame:
    """The same metrics out of replies as a metrics service gives them, one for each symbol and metric."""
    o = bars.read(spark, d, "orders")
    day = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    g = o.groupBy(day.alias("t"), F.col("o_orderpriority").alias("symbol")).agg(F.count_distinct("o_custkey").cast("string").alias("AdrActCnt"), F.count(F.lit(1)).cast("string").alias("TxCnt"))
    time = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'.000000000Z'").alias("time")
    reply = lambda metric, month: g.filter(F.month("t") != month).groupBy("symbol").agg(F.to_json(F.struct(F.collect_list(F.struct(time, metric)).alias("data"))).alias("payload")).withColumn("metric", F.lit(metric))
    replies = reply("AdrActCnt", 3).unionByName(reply("TxCnt", 7)).select("symbol", F.lower("symbol").alias("asset"), "metric", "payload", F.lit(None).cast("string").alias("warning"))
    return onchain.context_of(replies, "community")


def _exchange(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars by pages of an exchange's candle route; the replies come from the events' bars."""
    path = workdir.fresh(spark, "candles")
    b = bars.events_hourly(spark, d)
    b.select(F.concat(F.upper("symbol"), F.lit("-USDT")).alias("inst_id"), F.unix_millis(F.col("timestamp").cast("timestamp")).alias("ms"), "open", "high", "low", "close", "volume").write.parquet(path)
    span = b.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    names = sorted(r["symbol"] for r in b.select("symbol").distinct().collect())  # the types of events
    request = DataRequest.of({"universe": [{"symbol": n, "asset_class": "crypto", "exchange": f"{n.upper()}-USDT"} for n in names], "start": str(span["a"]), "end": str(span["b"]), "frequency": "1h"})

    def fetch(inst_id: str, bar: str, after: str) -> str:
        import json

        from pyarrow import compute, dataset

        of = dataset.dataset(path, format="parquet").to_table(filter=(compute.field("inst_id") == inst_id) & (compute.field("ms") < int(after)))
        rows = of.sort_by([("ms", "descending")]).slice(0, 100).to_pylist()
        return json.dumps({"code": "0", "data": [[str(r["ms"]), *(repr(r[c]) for c in ("open", "high", "low", "close", "volume")), "0", "0", "1"] for r in rows]})

    got = exchange.load(spark, fetch, request).filter(F.col("symbol").isin("click", "view", "purchase") & (F.col("timestamp") >= F.lit(datetime(2024, 1, 5)).cast("timestamp_ntz")))
    return rounded(got.drop("inst_id", "confirmed"))


def health(spark: SparkSession, d: str) -> DataFrame:
    m = bars.events_hourly(spark, d)
    return context.source_status("okx", "1h", m.filter("symbol <> 'click' or timestamp < '2024-01-20'"), {"derivatives_history": history(spark, d), "derivatives_snapshot": m.limit(0), "microstructure": m.filter("symbol = 'view'")}, datetime(2024, 1, 31, 1, 0, 0))


def _sweep(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = workdir.written(Q._line_panel(spark, d))
    return p, backtest.sweep(p, Q.NAMES, evaluation.evaluate(p, Q.NAMES, (1,)), Q.CONFIG)


def radar(spark: SparkSession, d: str) -> DataFrame:
    p, b = _sweep(spark, d)
    return signals.radar(p, Q.NAMES, b)


def _fixed_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of the events panel with given backtests, so that cards don't depend on a sweep."""
    p = Q._panel(spark, d)
    rows = [("mom_5", 1, 2.4, 3.0, 0.4, -0.1, 0.6, 1, None), ("reversal_5", 1, 1.4, 2.0, 0.2, -0.2, 0.55, 1, ""), ("volume_zscore_10", -1, 0.9, 1.0, 0.1, -0.3, None, 1, None), ("mom_5", 1, 0.4, 9.0, 0.4, -0.1, 0.6, 5, None), ("mom_3", 1, 9.0, 9.0, 0.4, -0.1, 0.6, 1, "failed")]
    b = spark.createDataFrame(rows, "factor string, direction int, sharpe double, score double, total_return double, max_drawdown double, win_rate double, horizon int, error string")
    return signals.radar(p, ["mom_3", "mom_5", "reversal_5", "volume_zscore_10"], b)


def _cards(spark: SparkSession, d: str) -> DataFrame:
    m = bars.events_hourly(spark, d)
    c = chain(spark, d).withColumn("symbol", F.when(F.col("symbol").startswith("1"), "click").when(F.col("symbol").startswith("2"), "view").otherwise(F.col("symbol")))
    return decisions.cards(m, _fixed_signals(spark, d), snapshot(spark, d), history(spark, d), micro(spark, d), c, "WARN")


def _cockpit(spark: SparkSession, d: str) -> DataFrame:
    """Cards of two types of events, technicals of two, and what can be inferred for the rest; weeks stand for folds."""
    m = bars.events_hourly(spark, d)
    states = T.queries()["indicator_states"](spark, d).filter("symbol in ('view', 'purchase')")
    folds = m.groupBy(F.date_trunc("week", "timestamp").alias("fold")).agg(F.avg(F.col("close") - F.col("open")).alias("test_sharpe"))
    of_chain = chain(spark, d).withColumn("symbol", F.when(F.col("symbol").startswith("1"), "click").when(F.col("symbol").startswith("2"), "view").otherwise(F.col("symbol")))
    out = cockpit.view(m, _cards(spark, d).filter("symbol in ('click', 'view')"), _fixed_signals(spark, d), states, micro(spark, d), snapshot(spark, d), of_chain, folds)
    return rounded(out, 5)


def _pivot(spark: SparkSession, d: str) -> DataFrame:
    w = backtest.weights(Q._one(spark, d), Q.CONFIG)
    symbols = ["AF", "AO", "NF", "NO", "RF", "RO"]
    return rounded(w.groupBy("timestamp").pivot("symbol", symbols).agg(F.sum("weight")).fillna(0.0))


def _semi(spark: SparkSession, d: str) -> DataFrame:
    p = Q._panel(spark, d).select("timestamp", "symbol", "mom_5")
    keys = bars.events_hourly(spark, d).filter("timestamp between '2024-01-10' and '2024-01-12'").select("timestamp", "symbol")
    return rounded(p.join(keys, ["timestamp", "symbol"], "left_semi"))


def _topk(spark: SparkSession, d: str) -> DataFrame:
    m = bars.events_hourly(spark, d)
    w = Window.partitionBy("symbol").orderBy(F.col("timestamp").desc())
    return m.withColumn("r", F.row_number().over(w)).filter("r <= 8").select("symbol", "timestamp", "close", "r")


def _union(spark: SparkSession, d: str) -> DataFrame:
    return bars.events_hourly(spark, d).unionByName(bars.lineitem_daily(spark, d)).groupBy("asset_class", "frequency", "symbol").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def _run_events(spark: SparkSession, d: str) -> DataFrame:
    e = bars.read(spark, d, "events")
    state = F.element_at(F.array(*(F.lit(x) for x in ("queued", "running", "succeeded", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), state.alias("status"), F.when(state == "failed", F.concat(F.lit("error "), "event_type")).alias("error"))


def _candles(spark: SparkSession, d: str) -> DataFrame:
    b = bars.events_hourly(spark, d)
    row = F.array(_ms("timestamp"), *(F.format_string("%.4f", F.col(c)) for c in ("open", "high", "low", "close", "volume")), F.lit("0"), F.lit("0"), F.when(F.hour("timestamp") == 23, "0").otherwise("1"))
    short = F.array(F.lit("1"), F.lit("2"))
    reply = b.groupBy("symbol").agg(F.to_json(F.struct(F.lit("0").alias("code"), F.lit("").alias("msg"), F.concat(F.collect_list(row), F.array(short)).alias("data"))).alias("payload"))
    return payloads.candles(reply.withColumn("inst_id", F.upper("symbol")), "crypto", "1h")


def queries() -> dict:
    return {
        "deriv_crowding": lambda s, d: rounded(snapshot(s, d)),
        "deriv_history_outer_merge": lambda s, d: rounded(history(s, d)),
        "micro_snapshot": lambda s, d: rounded(micro(s, d)),
        "onchain_context": lambda s, d: rounded(chain(s, d)),
        "onchain_fetched": lambda s, d: rounded(fetched_chain(s, d)),
        "source_health": lambda s, d: rounded(health(s, d)),
        "source_health_overall": lambda s, d: context.overall_status(health(s, d), "okx"),
        "signal_radar": lambda s, d: rounded(radar(s, d), 5, ("total_return", "max_drawdown")),
        "decision_cards": lambda s, d: rounded(_cards(s, d), 5),
        "cockpit": _cockpit,
        "candle_payloads": lambda s, d: rounded(_candles(s, d)),
        "exchange_candles": _exchange,
        "pivot_weights": _pivot,
        "semi_join_fold": _semi,
        "topk_per_symbol": _topk,
        "union_all": _union,
        "artifact_last_rows": lambda s, d: store.last_rows(bars.events_hourly(s, d), ["timestamp", "symbol"]),
        "run_latest_state": lambda s, d: store.latest_runs(_run_events(s, d)),
        "run_logs_after": lambda s, d: store.logs_after(_run_events(s, d).select(F.col("seq").alias("id"), "run_id", F.col("status").alias("level"), F.col("error").alias("message")), None, 500, 200),
        "raw_manifest": lambda s, d: store.manifest(bars.events_hourly(s, d), "run-1", "market", "synthetic", "market.parquet"),
        "csv_roundtrip": lambda s, d: store.csv_roundtrip(bars.lineitem_daily(s, d)),
        "synthetic_bars": lambda s, d: _synthetic(s),
        "ml_rf_prediction": lambda s, d: mining.forest(bars.lineitem_daily(s, d), Q.WINDOWS, 1)[0],
    }


def _synthetic(spark: SparkSession) -> DataFrame:
    from factorlake.sources import providers

    raw = {"universe": [{"symbol": "BTC-USD", "asset_class": "crypto"}, "AAPL"], "start": "2022-01-01", "end": "2022-06-01", "frequency": "1d"}
    return providers.build({"provider": "synthetic", "seed": 3}).load(spark, DataRequest.of(raw))


PT = "pt AS (SELECT event_type AS symbol, count(*)::BIGINT AS n, round(avg(value), 4) AS v, max(ts) AS t, upper(event_type) || '-USDT-SWAP' AS inst_id FROM events GROUP BY ALL)"
_MST = "date_trunc('millisecond', {})::TIMESTAMP"
CROWD = "CASE WHEN {0} IS NULL THEN 'UNKNOWN' WHEN {0} >= 0.25 THEN 'LONG_CROWDED' WHEN {0} >= 0.1 THEN 'LONG_WARM' WHEN {0} <= -0.25 THEN 'SHORT_CROWDED' WHEN {0} <= -0.1 THEN 'SHORT_WARM' ELSE 'NEUTRAL' END"
SNAP = f"""{PT},
sn AS (SELECT {_MST.format("CASE WHEN symbol = 'view' THEN t ELSE t + INTERVAL 1 HOUR END")} AS timestamp, symbol, 'okx' AS exchange, inst_id, 'SWAP' AS inst_type, round((v - 49.8::DOUBLE) / 1000.0::DOUBLE, 6) AS funding_rate,
  round((v - 49.8::DOUBLE) / 1000.0::DOUBLE, 6) * 3 * 365 AS annualized_funding_rate, 0.0001::DOUBLE AS premium, NULL::DOUBLE AS interest_rate, {_MST.format('t')} AS next_funding_time,
  CASE WHEN symbol <> 'view' THEN n::DOUBLE END AS oi_contracts, NULL::DOUBLE AS oi_ccy, CASE WHEN symbol <> 'view' THEN n * 1e6::DOUBLE END AS oi_usd FROM pt),
snap AS (SELECT *, {CROWD.format('annualized_funding_rate')} AS crowding, lower(replace({CROWD.format('annualized_funding_rate')}, '_', ' ')) AS crowding_label FROM sn)"""
HIST = f"""hb AS (SELECT *, upper(symbol) || '-USDT-SWAP' AS inst_id FROM bars WHERE timestamp >= TIMESTAMP '2024-01-02' AND timestamp < TIMESTAMP '2024-01-29'),
hist AS (SELECT timestamp, symbol, 'okx' AS exchange, inst_id, 'SWAP' AS inst_type, CASE WHEN hour(timestamp) % 8 = 0 THEN round(close / 1e4::DOUBLE, 6) END AS funding_rate, CASE WHEN hour(timestamp) % 8 = 0 THEN round(open / 1e4::DOUBLE, 6) END AS realized_rate,
  CASE WHEN hour(timestamp) % 8 = 0 THEN round(close / 1e4::DOUBLE, 6) * 3 * 365 END AS annualized_funding_rate, CASE WHEN hour(timestamp) % 6 = 0 THEN round(high, 6) END AS oi_contracts, NULL::DOUBLE AS oi_ccy,
  CASE WHEN hour(timestamp) % 6 = 0 THEN volume * 1e6::DOUBLE END AS oi_usd, CASE WHEN hour(timestamp) % 4 = 0 THEN round(low + 1.0::DOUBLE, 6) END AS long_short_ratio FROM hb WHERE hour(timestamp) % 8 = 0 OR hour(timestamp) % 6 = 0 OR hour(timestamp) % 4 = 0)"""
MICRO = f"""mp AS (SELECT *, v + 100.0::DOUBLE AS mid, CASE WHEN symbol = 'view' THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END AS wide FROM pt),
ml AS (SELECT *, round(mid - wide, 4) AS best_bid, round(mid + wide, 4) AS best_ask, round(mid - 1.0::DOUBLE, 4) AS second FROM mp),
mm AS (SELECT *, best_bid * 3 + second * 4 AS bid_depth_usd, best_ask * 2 AS ask_depth_usd, (best_bid + best_ask) / 2 AS mid_price FROM ml),
mo AS (SELECT *, (best_ask - best_bid) / nullif(mid_price, 0) * 10000 AS spread_bps, (bid_depth_usd - ask_depth_usd) / nullif(bid_depth_usd + ask_depth_usd, 0) AS depth_imbalance FROM mm),
micro AS (SELECT *, CASE WHEN spread_bps > 8 THEN 'WIDE_SPREAD' WHEN depth_imbalance > 0.2 THEN 'BID_DOMINANT' ELSE 'BALANCED' END AS microstructure_label FROM mo)"""
CHAIN = """og AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS timestamp, o_orderpriority AS symbol, count(DISTINCT o_custkey)::DOUBLE AS a, count(*)::DOUBLE AS c FROM orders GROUP BY ALL),
oj AS (SELECT timestamp, symbol, 'community' AS provider, lower(symbol) AS asset, CASE WHEN month(timestamp) <> 3 THEN a END AS active_addresses, CASE WHEN month(timestamp) <> 7 THEN c END AS tx_count FROM og),
ol AS (SELECT *, last_value(active_addresses IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS fa, last_value(tx_count IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS ft FROM oj),
oc AS (SELECT *, fa / nullif(lag(fa, 7) OVER (PARTITION BY symbol ORDER BY timestamp), 0) - 1 AS active_address_change, ft / nullif(lag(ft, 7) OVER (PARTITION BY symbol ORDER BY timestamp), 0) - 1 AS tx_count_change FROM ol),
ou AS (SELECT *, (coalesce(active_address_change, 0) > 0.05)::INT + (coalesce(tx_count_change, 0) > 0.05)::INT AS u, (coalesce(active_address_change, 0) < -0.05)::INT + (coalesce(tx_count_change, 0) < -0.05)::INT AS w FROM oc),
chain AS (SELECT *, CASE WHEN u >= 2 THEN 'EXPANSION' WHEN w >= 2 THEN 'CONTRACTION' WHEN u > w THEN 'STRONG' WHEN w > u THEN 'WEAK' ELSE 'NEUTRAL' END AS onchain_label FROM ou)"""


def _radar_sql(backtests: str, factors_: list[str], long: str) -> str:
    """CTEs up to rad over `long` (timestamp, symbol, factor, value) and `backtests`."""
    theme = " ".join(f"WHEN starts_with(factor, '{k}') THEN '{v}'" for k, v in signals.THEMES.items())
    return f"""rk AS (SELECT timestamp, symbol, factor, value, {S.avg_rank('value', 'symbol, factor')} AS r, count(*) OVER (PARTITION BY symbol, factor) AS n FROM {long}),
lt AS (SELECT * FROM rk WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY symbol, factor ORDER BY timestamp DESC) = 1),
bb_ AS (SELECT * FROM {backtests} WHERE error IS NULL OR error = '' QUALIFY row_number() OVER (PARTITION BY factor ORDER BY sharpe DESC NULLS LAST, score DESC NULLS LAST, horizon) = 1),
rj AS (SELECT lt.*, r / n AS p, direction, sharpe, score, win_rate, total_return, max_drawdown, horizon FROM lt JOIN bb_ USING (factor)),
rc AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.45::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(sharpe, 0) / 3.0::DOUBLE)) + 0.25::DOUBLE * least(1.0::DOUBLE, abs(coalesce(score, 0)) / 5.0::DOUBLE)
   + 0.2::DOUBLE * coalesce(CASE WHEN win_rate IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (win_rate - 0.45::DOUBLE) / 0.25::DOUBLE)) END, 0.5::DOUBLE) + 0.1::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - least(abs(coalesce(max_drawdown, 0)) / 0.35::DOUBLE, 1.0::DOUBLE)))) AS confidence,
   CASE WHEN (direction >= 0 AND p >= 0.8) OR (direction < 0 AND p <= 0.2) THEN 'BULLISH' WHEN (direction >= 0 AND p <= 0.2) OR (direction < 0 AND p >= 0.8) THEN 'BEARISH' ELSE 'NEUTRAL' END AS signal FROM rj),
rad AS (SELECT *, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts_text, CASE {theme} ELSE 'other' END AS theme, p AS percentile, lower(signal) AS signal_label, CASE WHEN p >= 0.8 THEN 'high in its history' WHEN p <= 0.2 THEN 'low in its history' ELSE 'mid-range' END AS setup,
   CASE WHEN direction >= 0 THEN 'high_value_bullish' ELSE 'low_value_bullish' END AS direction_label, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS confidence_label,
   abs(p - 0.5::DOUBLE) * 2.0::DOUBLE * confidence * CASE WHEN signal = 'NEUTRAL' THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END AS signal_score FROM rc
   QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY abs(p - 0.5::DOUBLE) * 2.0::DOUBLE * confidence * CASE WHEN signal = 'NEUTRAL' THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END DESC NULLS LAST, confidence DESC NULLS LAST, sharpe DESC NULLS LAST, factor) <= 8)"""


FIXED = "fx AS (SELECT * FROM (VALUES ('mom_5', 1, 2.4::DOUBLE, 3.0::DOUBLE, 0.4::DOUBLE, -0.1::DOUBLE, 0.6::DOUBLE, 1, NULL), ('reversal_5', 1, 1.4, 2.0, 0.2, -0.2, 0.55, 1, ''), ('volume_zscore_10', -1, 0.9, 1.0, 0.1, -0.3, NULL, 1, NULL), ('mom_5', 1, 0.4, 9.0, 0.4, -0.1, 0.6, 5, NULL), ('mom_3', 1, 9.0, 9.0, 0.4, -0.1, 0.6, 1, 'failed')) t(factor, direction, sharpe, score, total_return, max_drawdown, win_rate, horizon, error))"
FEW_FACTORS = "mom_3, mom_5, reversal_5, volume_zscore_10"


def _cockpit_sql() -> str:
    case = lambda c, texts: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items()) + " END"
    family = lambda c: f"CASE WHEN contains({c}, 'LONG') THEN 'LONG' WHEN contains({c}, 'SHORT') THEN 'SHORT' ELSE {c} END"
    return f"""WITH {S.EVENT_BARS}, {S.panel()}, {FIXED},
lg AS (UNPIVOT (SELECT timestamp, symbol, {FEW_FACTORS} FROM panel) ON {FEW_FACTORS} INTO NAME factor VALUE value),
{_radar_sql('fx', [], 'lg')},
{SNAP}, {MICRO}, {CHAIN},
ca AS (SELECT symbol, stance, confidence, primary_factor, risk_note FROM ({_cards_sql()}) WHERE symbol IN ('click', 'view')),
st AS (SELECT symbol, technical_bias, confidence, trend_state FROM ({T.oracle_sql()['indicator_states']}) WHERE symbol IN ('view', 'purchase')),
lb AS (SELECT symbol, timestamp, close, lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS b, lag(close, 2) OVER (PARTITION BY symbol ORDER BY timestamp) AS c FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1),
ct AS (SELECT symbol, count_if(signal = 'BULLISH') AS bulls, count_if(signal = 'BEARISH') AS bears, max(confidence) AS sure FROM rad GROUP BY symbol),
tp AS (SELECT symbol, theme, factor FROM rad QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY signal_score DESC NULLS LAST, confidence DESC NULLS LAST, factor DESC) = 1),
ol_ AS (SELECT CASE WHEN symbol LIKE '1%' THEN 'click' WHEN symbol LIKE '2%' THEN 'view' ELSE symbol END AS symbol, onchain_label FROM chain QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1),
fo AS (SELECT count_if(s > 0)::BIGINT AS folds_positive, count(*)::BIGINT AS folds FROM (SELECT avg(close - open) AS s FROM bars GROUP BY date_trunc('week', timestamp)))
SELECT lb.symbol, lb.timestamp, round(lb.close, 5) + 0.0::DOUBLE AS last_close, round(CASE WHEN c IS NOT NULL THEN lb.close / nullif(b, 0) - 1 END, 5) + 0.0::DOUBLE AS last_change,
  coalesce(stance, technical_bias, CASE WHEN coalesce(bulls, 0) > coalesce(bears, 0) AND crowding IN ('LONG_CROWDED', 'LONG_WARM') THEN 'WATCH_LONG' WHEN coalesce(bears, 0) > coalesce(bulls, 0) AND crowding IN ('SHORT_CROWDED', 'SHORT_WARM') THEN 'WATCH_SHORT'
    WHEN coalesce(bulls, 0) > coalesce(bears, 0) THEN 'LEAN_LONG' WHEN coalesce(bears, 0) > coalesce(bulls, 0) THEN 'LEAN_SHORT' WHEN microstructure_label = 'BID_DOMINANT' THEN 'WATCH_LONG' WHEN microstructure_label = 'ASK_DOMINANT' THEN 'WATCH_SHORT' ELSE 'NEUTRAL' END) AS bias,
  round(coalesce(ca.confidence, st.confidence, sure), 5) + 0.0::DOUBLE AS confidence,
  coalesce({case('stance', cockpit.STANCES)}, trend_state, {case('theme', cockpit.THEMES)}, microstructure_label, onchain_label, crowding_label, 'waiting') AS regime, coalesce(primary_factor, tp.factor) AS primary_factor,
  concat_ws(' ', CASE WHEN risk_note <> 'none' THEN risk_note END, CASE WHEN {family('stance')} <> {family('technical_bias')} THEN 'technicals=' || lower(technical_bias) END, CASE WHEN abs(annualized_funding_rate) > 0.1 THEN 'funding=extreme' END,
    CASE WHEN spread_bps > 8 THEN 'book=thin' END, CASE WHEN ol_.symbol IS NULL THEN 'chain=missing' END) AS conflicts, folds_positive, folds
FROM lb LEFT JOIN ct USING (symbol) LEFT JOIN tp USING (symbol) LEFT JOIN ca USING (symbol) LEFT JOIN st USING (symbol) LEFT JOIN micro USING (symbol) LEFT JOIN snap USING (symbol) LEFT JOIN ol_ USING (symbol), fo"""


def _cards_sql() -> str:
    fixed = FIXED
    fs = FEW_FACTORS
    two = lambda n, c: f"{n} AS (SELECT symbol, max(CASE WHEN k = 1 THEN {c} END) AS latest, max(CASE WHEN k = 2 THEN {c} END) AS previous FROM (SELECT symbol, {c}, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS k FROM hist WHERE {c} IS NOT NULL) GROUP BY symbol)"
    label = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in decisions.LABELS.items())
    hot, cold = "crowding IN ('LONG_CROWDED', 'LONG_WARM')", "crowding IN ('SHORT_CROWDED', 'SHORT_WARM')"
    longs, shorts = "stance IN ('WATCH_LONG', 'LEAN_LONG')", "stance IN ('WATCH_SHORT', 'LEAN_SHORT')"
    crowd = f"(({longs} AND {hot}) OR ({shorts} AND {cold}))"
    move = lambda tag, c: f"CASE WHEN {c} > 0 THEN '{tag}=up' WHEN {c} < 0 THEN '{tag}=down' END"
    cols = "symbol timestamp ~last_close ~return_1d ~return_5d stance stance_label ~confidence primary_factor primary_signal ~funding_annualized ~funding_change ~oi_usd ~oi_change ~long_short_ratio crowding crowding_label microstructure_label ~spread_bps ~depth_imbalance ~active_addresses ~active_address_change ~tx_count ~tx_count_change onchain_label data_quality_status evidence risk_note invalidation_note action_hint"
    return f"""WITH {S.EVENT_BARS}, {S.panel()}, {fixed},
lg AS (UNPIVOT (SELECT timestamp, symbol, {fs} FROM panel) ON {fs} INTO NAME factor VALUE value),
{_radar_sql('fx', [], 'lg')},
{SNAP}, {HIST}, {MICRO}, {CHAIN},
{two('tf', 'annualized_funding_rate')}, {two('to_', 'oi_usd')}, {two('tl', 'long_short_ratio')},
lc AS (SELECT symbol, timestamp, close AS last_close, close / nullif(lag(close, 1) OVER ({S.W}), 0) - 1 AS return_1d, close / nullif(lag(close, 5) OVER ({S.W}), 0) - 1 AS return_5d FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1),
ps AS (SELECT symbol, factor AS primary_factor, signal_label AS primary_signal, confidence AS base FROM rad QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY signal_score DESC NULLS LAST, confidence DESC NULLS LAST, factor) = 1),
ct AS (SELECT symbol, count_if(signal = 'BULLISH') AS bulls, count_if(signal = 'BEARISH') AS bears FROM rad GROUP BY symbol),
ch AS (SELECT CASE WHEN symbol LIKE '1%' THEN 'click' WHEN symbol LIKE '2%' THEN 'view' ELSE symbol END AS symbol, timestamp, active_addresses, active_address_change, tx_count, tx_count_change, onchain_label FROM chain),
cl AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1),
ca AS (SELECT lc.symbol, lc.timestamp::VARCHAR AS timestamp, last_close, return_1d, return_5d, primary_factor, primary_signal, snap.annualized_funding_rate AS funding_annualized, snap.oi_usd, crowding, crowding_label,
    tf.latest - tf.previous AS funding_change, to_.latest / nullif(to_.previous, 0) - 1 AS oi_change, tl.latest AS long_short_ratio, microstructure_label, spread_bps, depth_imbalance, active_addresses, active_address_change, tx_count, tx_count_change, onchain_label,
    'WARN' AS data_quality_status, coalesce(bulls, 0) AS bulls, coalesce(bears, 0) AS bears, coalesce(base, 0) * CASE WHEN crowding IN ('LONG_CROWDED', 'SHORT_CROWDED') THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN spread_bps > 8 THEN 0.85::DOUBLE ELSE 1 END AS c0
  FROM lc LEFT JOIN ps USING (symbol) LEFT JOIN ct USING (symbol) LEFT JOIN snap ON snap.symbol = lc.symbol LEFT JOIN tf ON tf.symbol = lc.symbol LEFT JOIN to_ ON to_.symbol = lc.symbol LEFT JOIN tl ON tl.symbol = lc.symbol LEFT JOIN micro ON micro.symbol = lc.symbol LEFT JOIN cl ON cl.symbol = lc.symbol),
cb AS (SELECT *, CASE WHEN microstructure_label IN ('BID_DOMINANT', 'ASK_DOMINANT') THEN least(c0 * 1.05::DOUBLE, 1) ELSE c0 END AS c1, CASE WHEN bulls > bears AND {hot} THEN 'WATCH_LONG' WHEN bears > bulls AND {cold} THEN 'WATCH_SHORT' WHEN bulls > bears THEN 'LEAN_LONG' WHEN bears > bulls THEN 'LEAN_SHORT' ELSE 'NEUTRAL' END AS stance FROM ca),
cc AS (SELECT *, greatest(0, least(1, CASE WHEN onchain_label IN ('EXPANSION', 'STRONG') THEN least(c1 * 1.05::DOUBLE, 1) WHEN onchain_label IN ('CONTRACTION', 'WEAK') THEN c1 * 0.92::DOUBLE ELSE c1 END)) AS confidence, CASE stance {label} END AS stance_label,
   concat_ws(' ', primary_factor || '=' || primary_signal, 'crowding=' || lower(crowding), {move('funding', 'funding_change')}, {move('interest', 'oi_change')}, 'book=' || lower(microstructure_label), 'chain=' || lower(onchain_label),
     {move('bar', 'return_1d')}, {move('five_bars', 'return_5d')}) AS evidence,
   concat_ws(' ', 'quality=warn', CASE WHEN {crowd} THEN 'crowding=' || lower(crowding) END, CASE WHEN spread_bps > 8 THEN 'spread=wide' END) AS risk_note,
   coalesce(primary_factor || ':' || CASE WHEN {longs} THEN 'percentile<0.5' WHEN {shorts} THEN 'percentile>0.5' ELSE 'percentile<=0.2|percentile>=0.8' END || CASE WHEN {crowd} THEN '|crowding!=' || lower(crowding) ELSE '' END, 'none') AS invalidation_note,
   lower(stance) || CASE WHEN ({longs} AND microstructure_label = 'BID_DOMINANT') OR ({shorts} AND microstructure_label = 'ASK_DOMINANT') THEN '+book' ELSE '' END AS action_hint FROM cb)
SELECT {S.rnd(cols, 5)} FROM cc"""


def oracle_sql() -> dict[str, str]:
    o = {}
    rate = "CASE WHEN annualized_funding_rate IS NULL THEN 'no funding rate' ELSE printf('annualised funding %.1f%%', annualized_funding_rate * 100) END"
    size = "CASE WHEN oi_usd IS NULL THEN 'no open interest' ELSE printf('open interest %.2fB USD', oi_usd / 1e9) END"
    snap_cols = "timestamp symbol exchange inst_id inst_type ~funding_rate ~annualized_funding_rate ~premium ~interest_rate next_funding_time ~oi_contracts ~oi_ccy ~oi_usd crowding crowding_label"
    o["deriv_crowding"] = f"WITH {SNAP} SELECT {S.rnd(snap_cols)}, crowding_label || '; ' || {rate} || '; ' || {size} AS interpretation FROM snap"
    o["deriv_history_outer_merge"] = f"WITH {S.EVENT_BARS}, {HIST} SELECT {S.rnd('timestamp symbol exchange inst_id inst_type ~funding_rate ~realized_rate ~annualized_funding_rate ~oi_contracts ~oi_ccy ~oi_usd ~long_short_ratio')} FROM hist"
    o["micro_snapshot"] = f"WITH {PT}, {MICRO} SELECT {_MST.format('t + INTERVAL 5 SECOND')} AS timestamp, 'okx' AS exchange, {S.rnd('symbol inst_id ~best_bid ~best_ask ~mid_price ~spread_bps ~bid_depth_usd ~ask_depth_usd ~depth_imbalance')}, round(mid, 4) AS last_trade_price, 1.5::DOUBLE AS last_trade_size, 'buy' AS last_trade_side, 3::BIGINT AS recent_trade_count, 2::BIGINT AS buy_trade_count, 1::BIGINT AS sell_trade_count, microstructure_label, lower(microstructure_label) || printf('; spread %.2f bps; depth %.1fM bid, %.1fM ask; 2 buys, 1 sells', spread_bps, bid_depth_usd / 1e6, ask_depth_usd / 1e6) AS interpretation FROM micro"
    cols = ["asset_class", "close", "frequency", "high", "low", "open", "symbol", "timestamp", "volume"]
    text = "concat_ws(chr(31), " + ", ".join(f"coalesce('v' || {c}::VARCHAR, 'n')" for c in cols) + ")"
    words = ", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT)::VARCHAR AS w{k}" for k in range(8))
    o["raw_manifest"] = f"""WITH {S.EVENT_BARS}, r AS (SELECT sha256({text}) AS h FROM bars), w AS (SELECT count(*)::BIGINT AS rows, {words} FROM r),
c AS (SELECT rows, sha256(concat_ws(',', '{"|".join(cols)}', rows::VARCHAR, {", ".join(f"w{k}" for k in range(8))})) AS content_hash FROM w),
a AS (SELECT string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols, min(timestamp) AS start, max(timestamp) AS "end" FROM bars)
SELECT sha256('run-1|market|synthetic|' || content_hash || '|market.parquet') AS snapshot_id, 'run-1' AS run_id, 'market' AS dataset, 'synthetic' AS provider, content_hash, rows, symbols, start, "end", 'market.parquet' AS artifact_path, '{",".join(cols)}' AS columns FROM c, a"""
    o["exchange_candles"] = f"WITH {S.EVENT_BARS} SELECT {S.rnd('timestamp symbol open high low close volume asset_class frequency')} FROM bars WHERE symbol IN ('click', 'view', 'purchase') AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp < (SELECT max(timestamp) FROM bars)"
    said = lambda c, name: f"CASE WHEN {c} IS NULL THEN '{name} over 7 rows unknown' ELSE printf('{name} over 7 rows %+.1f%%', round({c} * 100, 1)) END"
    o["onchain_fetched"] = o["onchain_context"] = f"WITH {CHAIN} SELECT {S.rnd('timestamp symbol provider asset ~active_addresses ~active_address_change ~tx_count ~tx_count_change onchain_label')}, lower(onchain_label) || '; ' || {said('active_address_change', 'addresses')} || '; ' || {said('tx_count_change', 'transactions')} AS interpretation FROM chain"
    fresh = "greatest(epoch(TIMESTAMP '2024-01-31 01:00:00' - latest_timestamp) / 60.0::DOUBLE, 0.0::DOUBLE)"
    rows = lambda scope, src, limit: f"SELECT '{scope}' AS scope, symbol, 'okx' AS provider, CASE WHEN {fresh} <= {limit} THEN 'OK' ELSE 'STALE' END AS status, rows, latest_timestamp, round({fresh}, 6) AS freshness_minutes FROM (SELECT symbol, count(*)::BIGINT AS rows, max(timestamp) AS latest_timestamp FROM {src} GROUP BY symbol)"
    single = lambda scope, status: f"SELECT '{scope}', 'ALL', 'okx', '{status}', 0::BIGINT, NULL::TIMESTAMP, NULL::DOUBLE"
    health_sql = f"""WITH {S.EVENT_BARS}, {HIST}, he AS ({rows('market', "(SELECT * FROM bars WHERE symbol <> 'click' OR timestamp < TIMESTAMP '2024-01-20')", 180)} UNION ALL {rows('derivatives_history', 'hist', 5760)} UNION ALL {rows('microstructure', "(SELECT * FROM bars WHERE symbol = 'view')", 30)} UNION ALL {single('derivatives_snapshot', 'MISSING')} UNION ALL {single('onchain', 'SKIPPED')})"""
    age = "CASE WHEN freshness_minutes < 90 THEN printf('%.0f minutes', freshness_minutes) WHEN freshness_minutes < 4320 THEN printf('%.1f hours', freshness_minutes / 60) ELSE printf('%.1f days', freshness_minutes / 1440) END"
    o["source_health"] = f"{health_sql} SELECT *, CASE WHEN freshness_minutes IS NULL THEN lower(status) || ' ' || scope ELSE 'last updated ' || {age} || ' ago' END AS message FROM he"
    o["source_health_overall"] = f"{health_sql} SELECT CASE WHEN count(*) = 0 THEN 'MISSING' WHEN count_if(status = 'MISSING') > 0 THEN 'WARN' WHEN count_if(status = 'STALE') > 0 THEN 'STALE' ELSE 'OK' END AS status FROM he"
    one = ",\n".join(("WITH " + S.line_bars(), S.panel(), S.long(horizons=(1,)), S.EVAL))
    rows_ = "rows_ AS (SELECT factor, timestamp, symbol, value, target, direction FROM obs JOIN (SELECT factor, direction FROM ev) USING (factor))"
    names = ", ".join(Q.NAMES)
    o["signal_radar"] = f"""{one}, {rows_}, {S.backtest('rows_', 'factor')}, bts AS (SELECT factor, horizon, direction, score, sharpe, total_return, max_drawdown, win_rate, NULL AS error FROM ev JOIN mt USING (factor)),
lg AS (UNPIVOT (SELECT timestamp, symbol, {names} FROM panel) ON {names} INTO NAME factor VALUE value), {_radar_sql('bts', [], 'lg')}
SELECT ts_text AS timestamp, {S.rnd('symbol factor theme ~value ~percentile signal signal_label setup direction direction_label ~confidence confidence_label ~signal_score ~sharpe ~score ^total_return ^max_drawdown ~win_rate horizon', 5)},
  signal_label || '; at ' || floor(percentile * 100 + 0.5)::BIGINT || '% of its history, ' || CASE WHEN direction >= 0 THEN 'high' ELSE 'low' END || ' values favour returns, confidence ' || confidence_label AS interpretation FROM rad"""
    o["decision_cards"] = _cards_sql()
    o["cockpit"] = _cockpit_sql()
    o["candle_payloads"] = f"WITH {S.EVENT_BARS} SELECT timestamp, symbol, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume, asset_class, frequency, 'okx' AS exchange, upper(symbol) AS okx_inst_id, true AS okx_confirmed FROM bars WHERE hour(timestamp) <> 23"
    sums = ", ".join(f"round(coalesce(sum(weight) FILTER (symbol = '{s}'), 0), 6) + 0.0::DOUBLE AS \"{s}\"" for s in ("AF", "AO", "NF", "NO", "RF", "RO"))
    o["pivot_weights"] = f"{Q._B}, {S.backtest('rows_')} SELECT timestamp, {sums} FROM w GROUP BY timestamp"
    o["semi_join_fold"] = f"{Q._P} SELECT timestamp, symbol, round(mom_5, 6) + 0.0::DOUBLE AS mom_5 FROM panel WHERE timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'"
    o["topk_per_symbol"] = f"WITH {S.EVENT_BARS} SELECT symbol, timestamp, close, r::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS r FROM bars) WHERE r <= 8"
    line = S.line_bars().replace("bars AS (", "lines AS (", 1)
    o["union_all"] = f"WITH {S.EVENT_BARS}, {line} SELECT asset_class, frequency, symbol, count(*)::BIGINT AS n, min(timestamp) AS first, max(timestamp) AS last FROM (SELECT * FROM bars UNION ALL SELECT * FROM lines) GROUP BY ALL"
    state = "CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END"
    runs = f"re AS (SELECT 'run-' || user_id::VARCHAR AS run_id, ts AS \"at\", event_id AS seq, {state} AS status, CASE WHEN event_id % 4 = 3 THEN 'error ' || event_type END AS error FROM events)"
    o["run_latest_state"] = f"WITH {runs} SELECT run_id, min(\"at\") AS created_at, max(\"at\") AS updated_at, last(status ORDER BY \"at\", seq) AS status, last(error ORDER BY \"at\", seq) AS error FROM re GROUP BY run_id"
    o["run_logs_after"] = f"WITH {runs} SELECT seq AS id, run_id, status AS level, error AS message FROM re WHERE seq > 500 ORDER BY seq LIMIT 200"
    o["artifact_last_rows"] = f"WITH {S.EVENT_BARS} SELECT {S.rnd(Q.BAR_COLS)} FROM bars ORDER BY bars.timestamp DESC, symbol DESC LIMIT 200"
    o["csv_roundtrip"] = f"WITH {S.line_bars()} SELECT timestamp, symbol, open, high, low, close, volume, asset_class, frequency FROM bars"
    return o
