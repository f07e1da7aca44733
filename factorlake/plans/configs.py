"""Run configs: every value checked before Spark starts, saved whole or not at all, and presets."""

from __future__ import annotations

import json
import math
import os
from datetime import date, timedelta
from pathlib import Path

from factorlake.operators.backtest import BacktestConfig
from factorlake.operators.prepare import parse_adjustments
from factorlake.operators.walkforward import WalkForwardConfig
from factorlake.schemas import DataRequest
from factorlake.sources.providers import PROVIDERS


def _counts(section: dict, key: str, default: list[int], least: int = 1) -> list[int]:
    found = section.get(key, default)
    if not isinstance(found, (list, tuple)) or not found or any(isinstance(v, bool) or not isinstance(v, int) or v < least for v in found):
        raise ValueError(f"{key!r} is a list of whole numbers from {least}")
    return list(found)


def adjustments(config: dict) -> list:
    """The scenario rules of a config: its own section, or that of its data."""
    return parse_adjustments(config.get("adjustments", config["data"].get("adjustments")))


def validate(config: object) -> dict:
    """config, if a run can be made of it; else ValueError says which value is wrong."""
    if not isinstance(config, dict):
        raise ValueError("a config is an object")
    for key in ("data", "factors", "backtest"):
        if not isinstance(config.get(key), dict):
            raise ValueError(f"the config lacks the section {key!r}")
    for key in ("ml", "walk_forward", "signals", "derivatives", "microstructure", "onchain"):
        if config.get(key) is not None and not isinstance(config[key], dict):
            raise ValueError(f"the section {key!r} is an object")
    data = config["data"]
    for key in ("start", "end", "universe"):
        if not data.get(key):
            raise ValueError(f"the data lack {key!r}")
    request = DataRequest.of(data)
    if len(set(request.symbols)) < len(request.symbols) or not all(s.strip() for s in request.symbols):
        raise ValueError("a symbol is named once and not empty")
    provider = str(data.get("provider", "synthetic")).lower()
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}")
    adjustments(config)
    f = config["factors"]
    _counts(f, "windows", [5, 10, 20], 2)
    horizons = _counts(f, "horizons", [1])
    for key in ("min_observations", "min_cross_section_assets"):
        _counts({key: [f.get(key, 1)]}, key, [])
    b = BacktestConfig.of(config["backtest"])
    numbers = (b.quantile, b.transaction_cost_bps, b.slippage_bps, b.spread_multiplier, b.funding_multiplier)
    if not all(math.isfinite(x) for x in numbers):
        raise ValueError("a backtest's costs and quantile are finite numbers")
    if b.horizon not in horizons:
        raise ValueError(f"the backtest's horizon {b.horizon} is none of the factors' horizons")
    known = set(WalkForwardConfig.__dataclass_fields__)
    unknown = sorted(set(config.get("walk_forward") or {}) - known)
    if unknown:
        raise ValueError(f"unknown walk-forward settings: {', '.join(unknown)}")
    return config


def confined(root: str | Path, path: str | Path) -> Path:
    """path, resolved from root and links followed, which has to be root or within it."""
    base = Path(root).resolve()
    found = (base / path).resolve()
    if not found.is_relative_to(base):
        raise ValueError(f"{path} is outside of {base}")
    return found


def load(path: str | Path) -> dict:
    return validate(json.loads(Path(path).read_text(encoding="utf-8")))


def save(path: str | Path, config: dict) -> None:
    """Checks, writes beside and renames: a reader sees the old config or the new one."""
    path = Path(path)
    text = json.dumps(validate(config), indent=2, ensure_ascii=False) + "\n"
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.{os.getpid()}")
    beside.write_text(text, encoding="utf-8")
    os.replace(beside, path)


# What the presets differ in.
PRESETS = {
    "smoke": {"days": 10, "pages": 1, "windows": [5, 10, 20], "horizons": [5], "horizon": 5, "annualization": 1752, "folds": 2, "history": 20, "ml": False},
    "trend": {"days": 45, "pages": 3, "windows": [5, 10, 20, 60], "horizons": [5, 20], "horizon": 20, "annualization": 438, "folds": 3, "history": 40, "ml": False},
    "deep": {"days": 365, "pages": 20, "windows": [5, 10, 20, 60], "horizons": [5, 20], "horizon": 20, "annualization": 438, "folds": 3, "history": 100, "ml": True},
}


def preset(name: str, today: date) -> dict:
    """A config of hourly exchange bars up to the day after today: smoke, trend or deep."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}")
    p = PRESETS[name]
    return validate(
        {
            "data": {
                "provider": "okx", "frequency": "1h", "max_pages": p["pages"], "start": (today - timedelta(days=p["days"])).isoformat(), "end": (today + timedelta(days=1)).isoformat(),
                "universe": [{"symbol": s, "asset_class": "crypto"} for s in ("ETH-USD", "BTC-USD")],
            },
            "factors": {"windows": p["windows"], "horizons": p["horizons"], "min_observations": 50, "min_cross_section_assets": 2}, "ml": {"enabled": p["ml"], "n_estimators": 30, "seed": 7},
            "derivatives": {"enabled": True, "history_enabled": True, "history_limit": p["history"]}, "microstructure": {"enabled": True}, "onchain": {"enabled": True, "provider": "coinmetrics_community"},
            "walk_forward": {"enabled": True, "splits": p["folds"], "train_fraction": 0.55, "embargo": 1, "min_train": 40, "min_test": 12},
            "backtest": {"horizon": p["horizon"], "mode": "long_short", "top_n": 1, "bottom_n": 1, "transaction_cost_bps": 5.0, "slippage_bps": 2.0, "spread_multiplier": 0.5, "funding_enabled": True, "annualization": p["annualization"]},
        }
    )
