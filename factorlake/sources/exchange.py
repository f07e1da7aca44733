"""An exchange's candle history as a batch data source: a partition for each instrument and page of time.

`fetch(inst_id, bar, after) -> reply text` is injected and runs in the tasks; it gives
the newest candles before `after` (milliseconds as text). Filters on symbol and timestamp
are pushed down where spark.sql.python.filterPushdown.enabled says so: they rule out
instruments and pages before anything is asked for. A request that fails is made
again on its own, from where its page had come to; what the page already has stays.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from factorlake.schemas import FREQUENCIES, DataRequest, code
from factorlake.streaming.feeds import spot_id

SCHEMA = "timestamp timestamp_ntz, symbol string, open double, high double, low double, close double, volume double, asset_class string, frequency string, inst_id string, confirmed boolean"
PER_PAGE = 300
ATTEMPTS = 3
Fetch = Callable[[str, str, str], str]


def millis_of(t: datetime) -> int:
    return round(t.replace(tzinfo=t.tzinfo or timezone.utc).timestamp() * 1000)


@dataclass
class Page(InputPartition):
    """One instrument's candles from start to before end, in milliseconds."""

    symbol: str
    inst_id: str
    asset_class: str
    start: int
    end: int


def _number(text: object) -> float | None:
    try:
        x = float(text)
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


class CandleReader(DataSourceReader):
    def __init__(self, fetch: Fetch, universe: list[tuple[str, str, str]], bar: str, start: int, end: int, per_page: int, attempts: int, pause: float):
        self.fetch, self.universe, self.bar, self.start, self.end = fetch, universe, bar, start, end
        self.width, self.attempts, self.pause = per_page * FREQUENCIES[bar] * 1000, attempts, pause

    def partitions(self) -> list[Page]:
        pages = [Page(*u, a, min(a + self.width, self.end)) for u in self.universe for a in range(self.start, self.end, self.width)]
        return pages or [Page("", "", "", 0, 0)]

    def _asked(self, inst_id: str, after: int) -> list[list]:
        """The rows of one reply; what fails is asked for again, and no more than that."""
        for attempt in range(self.attempts):
            try:
                reply = json.loads(self.fetch(inst_id, code(self.bar, "okx"), str(after)))
                if str(reply.get("code", "0")) != "0":
                    raise OSError(f"exchange error {reply['code']}: {reply.get('msg', '')}")
                return [r for r in reply.get("data") or [] if len(r) >= 9]
            except (OSError, ValueError):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.pause * 2**attempt)
        return []

    def read(self, page: Page) -> Iterator[tuple]:
        after = page.end
        while page.symbol and after > page.start:
            rows = self._asked(page.inst_id, after)
            for r in rows:
                if page.start <= int(r[0]) < min(after, page.end):
                    at = datetime.fromtimestamp(int(r[0]) / 1000, timezone.utc).replace(tzinfo=None)
                    yield (at, page.symbol, *map(_number, r[1:6]), page.asset_class, self.bar, page.inst_id, str(r[8]) == "1")
            oldest = min((int(r[0]) for r in rows), default=after)
            if oldest >= after:  # nothing older is there
                return
            after = oldest


class PushedCandleReader(CandleReader):
    """For sessions that push filters down to Python sources. Filters on time stay with Spark as well, as pages are coarser."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            of = getattr(f, "attribute", None)
            if of == ("symbol",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.universe = [u for u in self.universe if u[0] in wanted]
                continue
            if of == ("timestamp",) and isinstance(getattr(f, "value", None), datetime):
                at = millis_of(f.value)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start, at)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.end = min(self.end, at + 1)
            yield f


def load(spark: SparkSession, fetch: Fetch, request: DataRequest, per_page: int = PER_PAGE, attempts: int = ATTEMPTS, pause: float = 0.05, unconfirmed: bool = False) -> DataFrame:
    """Bars of the request's universe and time; open candles only if asked for."""
    universe = [(i.symbol, i.exchange or spot_id(i.symbol), i.asset_class) for i in request.universe]
    kind = PushedCandleReader if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true" else CandleReader
    made = (fetch, universe, request.frequency, millis_of(request.start), millis_of(request.end), per_page, attempts, pause)

    class ExchangeCandles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "exchange_candles"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> CandleReader:
            return kind(*made)

    spark.dataSource.register(ExchangeCandles)
    bars = spark.read.format("exchange_candles").load()
    return bars if unconfirmed else bars.filter("confirmed")
