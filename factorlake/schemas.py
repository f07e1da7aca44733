"""Column lists, enumerations and request types."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

REQUIRED = ("timestamp", "symbol", "open", "high", "low", "close", "volume")
PRICES = ("open", "high", "low", "close")
OHLCV = (*PRICES, "volume")
MARKET = "timestamp timestamp_ntz, symbol string, open double, high double, low double, close double, volume double, asset_class string, frequency string"
ASSET_CLASSES = ("crypto", "equity")
FREQUENCIES = {"1d": 86_400, "1h": 3_600, "5m": 300, "1m": 60}
ALIASES = {"daily": "1d", "day": "1d", "d": "1d", "hourly": "1h", "hour": "1h", "h": "1h", "5min": "5m", "5minute": "5m", "1min": "1m", "minute": "1m"}


# Each library's own name for a bar.
CODES = {
    "pandas": {"1d": "D", "1h": "h", "5m": "5min", "1m": "min"},
    "yfinance": {"1d": "1d", "1h": "1h", "5m": "5m", "1m": "1m"},
    "ccxt": {"1d": "1d", "1h": "1h", "5m": "5m", "1m": "1m"},
    "okx": {"1d": "1Dutc", "1h": "1H", "5m": "5m", "1m": "1m"},
}


def code(bar: str, library: str) -> str:
    """What a library calls a bar of this length."""
    if library not in CODES:
        raise ValueError(f"no bar codes of {library!r}")
    return CODES[library][frequency(bar)]


def frequency(value: str) -> str:
    v = str(value).strip().lower()
    v = ALIASES.get(v, v)
    if v not in FREQUENCIES:
        raise ValueError(f"unknown frequency {value!r}")
    return v


def asset_class(value: str) -> str:
    v = str(value).strip().lower()
    if v not in ASSET_CLASSES:
        raise ValueError(f"unknown asset class {value!r}")
    return v


@dataclass(frozen=True)
class Instrument:
    symbol: str
    asset_class: str = "equity"
    exchange: str | None = None
    currency: str = "USD"

    @classmethod
    def of(cls, raw: str | dict) -> Instrument:
        if isinstance(raw, str):
            return cls(raw)
        return cls(str(raw["symbol"]), asset_class(raw.get("asset_class", "equity")), raw.get("exchange"), raw.get("currency", "USD"))


@dataclass(frozen=True)
class DataRequest:
    universe: tuple[Instrument, ...]
    start: datetime
    end: datetime
    frequency: str = "1d"
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.universe:
            raise ValueError("a request names at least one instrument")
        if self.start >= self.end:
            raise ValueError("a request's start is before its end")

    @classmethod
    def of(cls, raw: dict) -> DataRequest:
        return cls(tuple(map(Instrument.of, raw.get("universe", ()))), datetime.fromisoformat(raw["start"]), datetime.fromisoformat(raw["end"]), frequency(raw.get("frequency", "1d")))

    @property
    def symbols(self) -> list[str]:
        return [i.symbol for i in self.universe]
