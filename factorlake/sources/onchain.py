"""On-chain metrics by an injected fetcher: one reply per symbol and metric, a failure is a warning in its row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions.numerics import number
from factorlake.operators import context
from factorlake.schemas import DataRequest

# Base currencies with metrics, and the provider's names of these.
ASSETS = {"BTC": "btc", "ETH": "eth"}
METRICS = ("AdrActCnt", "TxCnt")
COLUMNS = {"AdrActCnt": "active_addresses", "TxCnt": "tx_count"}
PROVIDER = "coinmetrics_community"
REPLY = "symbol string, asset string, metric string, payload string, warning string"


@dataclass
class Metrics:
    """`fetch(asset, metric, start, end) -> reply text` is injected and runs in the tasks, one symbol and metric each."""

    fetch: Callable[[str, str, str, str], str]
    metrics: tuple[str, ...] = METRICS

    def load(self, spark: SparkSession, request: DataRequest) -> DataFrame:
        """(symbol, asset, metric, payload, warning): payload is null exactly where there is a warning."""
        fetch, start, end = self.fetch, request.start.isoformat(), request.end.isoformat()
        names = [F.struct(F.lit(k).alias("base"), F.lit(v).alias("asset")) for k, v in ASSETS.items()]
        symbols = spark.createDataFrame([(i.symbol,) for i in request.universe], "symbol string")
        base = F.substring_index(F.translate(F.upper("symbol"), "/", "-"), "-", 1)
        asset = F.filter(F.array(*names), lambda a: a["base"] == base)
        wanted = symbols.select("symbol", F.get(asset, F.lit(0))["asset"].alias("asset"), F.explode(F.array(*map(F.lit, self.metrics))).alias("metric"))

        def fetched(frames):
            for f in frames:
                payloads, warnings = [], []
                for a, metric in zip(f["asset"], f["metric"]):
                    payload, warning = None, None
                    if a is None:
                        warning = "no on-chain metrics of this asset"
                    else:
                        try:
                            payload = fetch(a, metric, start, end)
                        except Exception as e:  # one metric's failure leaves the others
                            warning = f"{metric}: {e}"
                    payloads.append(payload)
                    warnings.append(warning)
                yield f.assign(payload=payloads, warning=warnings)

        return wanted.repartition(max(1, len(request.universe)), "symbol", "metric").mapInPandas(fetched, REPLY)


def metrics(replies: DataFrame) -> DataFrame:
    """(timestamp, symbol, asset, metric, value) of the replies' rows; times and values that can't be read are null, rows without a time leave."""
    rows = F.from_json("payload", "data array<map<string,string>>")["data"]
    x = replies.filter("payload is not null").select("symbol", "asset", "metric", F.explode(rows).alias("x"))
    # Times end in nine digits and a Z; the day and the second are what is asked for.
    at = F.regexp_replace(F.substring(F.col("x")["time"], 1, 19), "T", " ").try_cast("timestamp_ntz")
    return x.select(at.alias("timestamp"), "symbol", "asset", "metric", number(F.col("x")[F.col("metric")]).alias("value")).filter("timestamp is not null")


def context_of(replies: DataFrame, provider: str = PROVIDER) -> DataFrame:
    """The replies' metrics as the on-chain context: one row per symbol and time, with changes and a label."""
    rows = metrics(replies)
    of = lambda metric: rows.filter(F.col("metric") == metric).select("timestamp", "symbol", F.lit(provider).alias("provider"), "asset", F.col("value").alias(COLUMNS[metric]))
    return context.onchain(*map(of, METRICS))


def warnings(replies: DataFrame) -> DataFrame:
    """(symbol, metric, warning) of what could not be fetched."""
    return replies.filter("warning is not null").select("symbol", "metric", "warning")


def context_warnings(replies: DataFrame) -> DataFrame:
    """These, and what has no column or came without rows."""
    known = F.col("metric").isin(*COLUMNS)
    bare = replies.filter(known & F.col("warning").isNull()).join(metrics(replies).select("symbol", "metric").distinct(), ["symbol", "metric"], "left_anti")
    empty = bare.select("symbol", "metric", F.concat("metric", F.lit(" came without rows")).alias("warning"))
    unknown = replies.filter(~known & F.col("warning").isNull()).select("symbol", "metric", F.concat(F.lit("no column for the metric "), "metric").alias("warning"))
    return warnings(replies).unionByName(empty).unionByName(unknown)
