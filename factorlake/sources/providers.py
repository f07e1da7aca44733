"""Market data providers by name: synthetic, CSV, Parquet, and REST ones with an injected fetcher."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.functions import workdir
from factorlake.operators import technicals
from factorlake.operators.prepare import normalise
from factorlake.schemas import FREQUENCIES, DataRequest, code
from factorlake.sources import exchange, payloads
from factorlake.streaming.feeds import spot_id


def within(market: DataFrame, request: DataRequest) -> DataFrame:
    """The request's symbols and its half-open time range."""
    t = F.col("timestamp")
    return market.filter(F.col("symbol").isin(request.symbols) & (t >= F.lit(request.start).cast("timestamp_ntz")) & (t < F.lit(request.end).cast("timestamp_ntz")))


@dataclass
class Synthetic:
    """Seeded random walks, made on the executors: each bar's shock is a function of (seed, symbol, index)."""

    seed: int = 42

    def load(self, spark: SparkSession, request: DataRequest) -> DataFrame:
        step = FREQUENCIES[request.frequency]
        start, n = request.start, int((request.end - request.start).total_seconds() // step)
        if n < 90:
            start, n = request.end - timedelta(seconds=252 * step), 252
        rows = [(i.symbol, i.asset_class, k) for k, i in enumerate(request.universe)]
        symbols = spark.createDataFrame(rows, "symbol string, asset_class string, k int")
        bars = symbols.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

        def uniform(salt: int):
            bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(self.seed)), F.lit(str(salt)), "symbol", F.col("i").cast("string"))), 1, 8), 16, 10).cast("double")
            return (bits + 0.5) / 4294967296.0

        normal = lambda a: F.sqrt(-2.0 * F.log(uniform(a))) * F.cos(uniform(a + 1) * 6.283185307179586)
        scale = {"1d": 0.025, "1h": 0.008, "5m": 0.003, "1m": 0.0015}[request.frequency]
        w = Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        base = F.lit(50.0) * (F.col("k") + 1)
        d = bars.withColumns({"r": normal(1) * scale + 0.0002, "a": F.abs(normal(3)) * scale * 0.4, "b": F.abs(normal(5)) * scale * 0.4, "u": uniform(7)})
        d = d.withColumn("close", base * F.exp(F.sum("r").over(w)))
        d = d.withColumn("open", F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy("i")), base))
        at = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("i") * step).cast("decimal(18,6)"))
        high, low = F.greatest("open", "close") * (1 + F.col("a")), F.least("open", "close") / (1 + F.col("b"))
        return d.select(at.alias("timestamp"), "symbol", "open", high.alias("high"), low.alias("low"), "close", (F.lit(1e6) * (0.5 + F.col("u"))).alias("volume"), "asset_class", F.lit(request.frequency).alias("frequency"))


@dataclass
class Csv:
    """A header-CSV file or folder; a file without a symbol column gives its name, upper-cased."""

    path: str

    def load(self, spark: SparkSession, request: DataRequest) -> DataFrame:
        raw = spark.read.option("header", True).csv(self.path)
        if "symbol" not in raw.columns:
            raw = raw.withColumn("symbol", F.upper(F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")))
        m = within(normalise(raw), request)
        return m.withColumn("frequency", F.coalesce("frequency", F.lit(request.frequency)))


@dataclass
class ParquetBars:
    path: str

    def load(self, spark: SparkSession, request: DataRequest) -> DataFrame:
        # Filters first, as they reach the scan.
        return normalise(within(spark.read.parquet(self.path), request))


@dataclass
class Candles:
    """Pages of an exchange's candle history. `fetch(inst_id, bar, after) -> JSON text` is injected and runs in the tasks, one instrument each."""

    fetch: Callable[[str, str, str | None], str]
    pages: int = 30
    unconfirmed: bool = False

    def load(self, spark: SparkSession, request: DataRequest) -> DataFrame:
        import json

        fetch, pages, bar, floor = self.fetch, self.pages, code(request.frequency, "okx"), request.start.timestamp() * 1000

        def paged(frames):
            import pandas as pd

            for f in frames:
                for symbol, inst in zip(f["symbol"], f["inst_id"]):
                    after = None
                    for _ in range(pages):
                        text = fetch(inst, bar, after)
                        yield pd.DataFrame({"symbol": [symbol], "inst_id": [inst], "payload": [text]})
                        rows = json.loads(text).get("data") or []
                        oldest = min((int(r[0]) for r in rows if r), default=None)
                        if oldest is None or str(oldest) == after or oldest <= floor:
                            break
                        after = str(oldest)

        ids = spark.createDataFrame([(i.symbol, i.exchange or spot_id(i.symbol)) for i in request.universe], "symbol string, inst_id string").repartition(len(request.universe))
        replies = ids.mapInPandas(paged, "symbol string, inst_id string, payload string")
        made = payloads.candles(replies, request.universe[0].asset_class, request.frequency, self.unconfirmed)
        kinds = spark.createDataFrame([(i.symbol, i.asset_class) for i in request.universe], "symbol string, asset_class string").dropDuplicates(["symbol"])
        return within(made.drop("asset_class").join(kinds, "symbol").select(*made.columns), request)


@dataclass
class Rows:
    """Any library's bars: `fetch(symbol, start, end, frequency) -> [(time or epoch ms, o, h, l, c, v), ...]` is injected and runs in the tasks, one symbol each."""

    fetch: Callable[[str, str, str, str], list[tuple]]

    def load(self, spark: SparkSession, request: DataRequest) -> DataFrame:
        fetch, start, end, bar = self.fetch, request.start.isoformat(), request.end.isoformat(), request.frequency

        def fetched(frames):
            import pandas as pd

            for f in frames:
                for symbol, kind in zip(f["symbol"], f["asset_class"]):
                    rows = [(str(pd.to_datetime(r[0], unit="ms") if isinstance(r[0], (int, float)) else r[0]), symbol, *map(str, r[1:6]), kind, bar) for r in fetch(symbol, start, end, bar)]
                    if rows:
                        yield pd.DataFrame(rows, columns=["timestamp", "symbol", "open", "high", "low", "close", "volume", "asset_class", "frequency"])

        ids = spark.createDataFrame([(i.symbol, i.asset_class) for i in request.universe], "symbol string, asset_class string").repartition(len(request.universe))
        text = "timestamp string, symbol string, open string, high string, low string, close string, volume string, asset_class string, frequency string"
        return within(normalise(ids.mapInPandas(fetched, text)), request)


TEXT = "timestamp string, symbol string, open string, high string, low string, close string, volume string, asset_class string, frequency string"


def _per_symbol(spark: SparkSession, request: DataRequest, library: str, bars_of: Callable) -> DataFrame:
    """Normalised bars of bars_of(symbol) -> [(time, o, h, l, c, v) as text], a task for each symbol; no bars at all is an error."""

    def fetched(frames):
        import pandas as pd

        for f in frames:
            for symbol, kind in zip(f["symbol"], f["asset_class"]):
                rows = [(r[0], symbol, *(None if x is None else str(x) for x in r[1:6]), kind, bar) for r in bars_of(symbol)]
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in TEXT.split(", ")])

    bar = request.frequency
    ids = spark.createDataFrame([(i.symbol, i.asset_class) for i in request.universe], "symbol string, asset_class string").repartition(len(request.universe))
    raw = workdir.written(ids.mapInPandas(fetched, TEXT))  # asked for once
    if raw.isEmpty():
        raise RuntimeError(f"{library} has no bars of {', '.join(request.symbols)}")
    return normalise(raw)


@dataclass
class Downloads:
    """A download library's rows: `fetch(symbol, start, end, interval) -> [{"Datetime" or "Date", "Open", "High", "Low", "Close", "Volume"}, ...]`.

    start and end are days. A symbol without rows is left out; the time is in the
    column Datetime where the rows have one, else in Date.
    """

    fetch: Callable[[str, str, str, str], list[dict]]

    def load(self, spark: SparkSession, request: DataRequest) -> DataFrame:
        fetch, span, interval = self.fetch, (f"{request.start:%Y-%m-%d}", f"{request.end:%Y-%m-%d}"), code(request.frequency, "yfinance")

        def bars_of(symbol: str) -> list[tuple]:
            rows = fetch(symbol, *span, interval)
            time = "Datetime" if rows and "Datetime" in rows[0] else "Date"
            return [(str(r[time]), *(r[c] for c in ("Open", "High", "Low", "Close", "Volume"))) for r in rows]

        return _per_symbol(spark, request, "yfinance", bars_of)


@dataclass
class Since:
    """One page from the request's start on: `fetch(symbol, timeframe, since) -> [(ms, o, h, l, c, v), ...]`, times in milliseconds since 1970, UTC."""

    fetch: Callable[[str, str, int], list[tuple]]

    def load(self, spark: SparkSession, request: DataRequest) -> DataFrame:
        fetch, since, timeframe = self.fetch, exchange.millis_of(request.start), code(request.frequency, "ccxt")

        def bars_of(symbol: str) -> list[tuple]:
            import pandas as pd

            return [(str(pd.to_datetime(r[0], unit="ms")), *r[1:6]) for r in fetch(symbol, timeframe, since)]

        return within(_per_symbol(spark, request, "ccxt", bars_of), request)


PROVIDERS = {"synthetic": lambda c: Synthetic(int(c.get("seed", 42))), "csv": lambda c: Csv(c["path"]), "parquet": lambda c: ParquetBars(c["path"]), "yfinance": lambda c: Downloads(c["download"]) if "download" in c else Rows(c["fetch"]), "ccxt": lambda c: Since(c["ohlcv"]) if "ohlcv" in c else Rows(c["fetch"]), "okx": lambda c: Candles(c["fetch"], int(c.get("max_pages", 30)), bool(c.get("include_unconfirmed")))}


def build(config: dict):
    """The provider that a config's `provider` names."""
    name = str(config.get("provider", "synthetic")).lower()
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}")
    return PROVIDERS[name](config)


def tail(market: DataFrame, symbol: str, limit: int = 240) -> DataFrame:
    """The last bars (20 to 1000) of one symbol, oldest first."""
    n = min(max(limit, 20), 1000)
    return market.filter(F.col("symbol") == symbol).orderBy(F.col("timestamp").desc()).limit(n).orderBy("timestamp")


def live_series(market: DataFrame, symbol: str, limit: int = 240, warm_up: int = 30) -> DataFrame:
    """The last bars (20 to 1000) of one symbol with technical indicators, oldest first; `warm_up` earlier bars feed the indicators and don't show."""
    n = min(max(limit, 20), 1000)
    newest = F.col("timestamp").desc()
    bars = market.filter(F.col("symbol") == symbol).orderBy(newest).limit(n + warm_up)
    return technicals.panel(bars).orderBy(newest).limit(n).orderBy("timestamp")
