"""What a page shows of a run: its summary, a snapshot of its tables, and an export of all of it as JSON.

A table has no order of its own, so its first and last rows are those by the columns in
ORDER. Records are JSON objects with every column: what is no finite number is null. A
text that begins with the folder `root` is shown from there ("./runs/1").
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.functions.numerics import finite
from factorlake.plans import configs

# Rows of each table in a summary (below 0: the last ones; None: all) and in a snapshot.
SUMMARY = {
    "derivatives_snapshot": 50, "derivatives_history": -100, "microstructure_snapshot": 50, "onchain_metrics": -100, "raw_snapshots": None, "decision_cards": None, "backtest_metrics": None, "technical_indicators": -120,
    "indicator_states": None, "factor_backtests": 50, "walk_forward": 50, "factor_signals": 80, "top_factor": None, "data_quality_summary": None, "source_overall": None,
}
SNAPSHOT = {
    "source_status": 100, "data_quality": 100, "derivatives_snapshot": 50, "derivatives_history": 200, "microstructure_snapshot": 50, "onchain_metrics": 120, "raw_snapshots": 100, "technical_indicators": 300,
    "indicator_states": 50, "decision_cards": 50, "factor_evaluation": 25, "factor_backtests": 50, "walk_forward": 50, "factor_signals": 100, "backtest_returns": 800, "market_data": 50,
}
ORDER = {
    "factor_backtests": ("sharpe desc", "factor"), "factor_evaluation": ("score desc", "factor", "horizon"), "factor_signals": ("signal_score desc", "symbol", "factor"), "walk_forward": ("fold",), "backtest_returns": ("timestamp",),
    "source_status": ("scope", "symbol"), "data_quality": ("symbol",), "raw_snapshots": ("snapshot_id",), "factor_candidates": ("name",), "top_factor": ("factor",), "data_quality_issues": ("symbol", "issue"),
    "backtest_metrics": ("periods",), "data_quality_summary": ("worst_symbol",), "source_overall": ("status",),
}
TIMES = ("timestamp", "symbol")
RESERVED = (".git", "runs", "factorlake", "tests")
BARS = (20, 5000)


def _by(name: str, turned: bool = False) -> list[Column]:
    """The order of a table, or its reverse."""
    out = []
    for c in ORDER.get(name, TIMES):
        column, _, down = c.partition(" ")
        out.append(F.col(column).desc_nulls_last() if bool(down) != turned else F.col(column).asc_nulls_last() if not turned else F.col(column).asc_nulls_first())
    return out


def _prefix(root: str | None) -> str | None:
    """Where a JSON text begins with root, as a pattern for Java and Python."""
    return None if not root else r'(?<!\\)"' + re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", json.dumps(str(root).rstrip("/"))[1:-1]) + '(?=[/"])'


def scrubbed(text: str, root: str | None) -> str:
    """JSON text whose strings don't tell where root is."""
    return text if not root else re.sub(_prefix(root), '".', text)


def as_json(frame: DataFrame, root: str | None = None) -> DataFrame:
    """One column `value`: a JSON object for each row, nulls included."""
    kinds = dict(frame.dtypes)
    clean = lambda c: finite(F.col(f"`{c}`")) if kinds[c] in ("double", "float") else F.col(f"`{c}`").cast("string") if kinds[c].startswith(("timestamp", "date")) else F.col(f"`{c}`")
    text = F.to_json(F.struct(*(clean(c).alias(c) for c in frame.columns)), {"ignoreNullFields": "false"})
    return frame.select((F.regexp_replace(text, _prefix(root), '".') if root else text).alias("value"))


def records(frame: DataFrame, name: str, rows: int | None, root: str | None = None) -> list[dict]:
    """The first rows of a table by its order, the last ones where rows is below 0, all where it is None; only these leave their tasks."""
    if rows is None:
        return [json.loads(r["value"]) for r in as_json(frame.orderBy(*_by(name)), root).collect()]
    part = frame.orderBy(*_by(name, rows < 0)).limit(abs(rows))
    return [json.loads(r["value"]) for r in as_json(part.orderBy(*_by(name)), root).collect()]


def read(spark: SparkSession, folder: str, name: str, csv: bool = False) -> DataFrame:
    path = f"{folder.rstrip('/')}/{name}"
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if csv else spark.read.parquet(path)


def summary(spark: SparkSession, folder: str, artifacts: dict[str, str], csv: bool = False, warnings: list[str] | None = None) -> dict:
    """Counts and the capped tables of a written run."""
    table = {n: read(spark, folder, n, csv) for n in artifacts}
    market, keys = table["market_data"], {"timestamp", "symbol"}
    return {
        "rows": market.count(), "symbols": sorted(r["symbol"] for r in market.select("symbol").distinct().collect()), "format": "csv" if csv else "parquet",
        "factor_count": len([c for c in table["factor_panel"].columns if c not in keys and not c.startswith("fwd_return_")]), "candidate_count": table["factor_candidates"].count(),
        "onchain_health": {"warnings": list(warnings or []), "rows": table["onchain_metrics"].count()},
        "outputs": dict(artifacts),
    } | {n: records(table[n], n, rows) for n, rows in SUMMARY.items() if n in table}


def write_text(spark: SparkSession, text: str, path: str) -> str:
    """text as a folder of one file, wherever path is."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
    return path


def _summary_of(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(f"{folder.rstrip('/')}/summary").first()["value"])


def snapshot(spark: SparkSession, folder: str, root: str | None = None) -> dict:
    """The last rows (by each table's order; the first where that is best first) of a run's tables, and its summary."""
    about = _summary_of(spark, folder)
    csv = about["format"] == "csv"
    last = lambda n, rows: rows if " desc" in ORDER.get(n, TIMES)[0] else -rows
    out = {n: records(read(spark, folder, n, csv), n, last(n, rows), root) for n, rows in SNAPSHOT.items() if n in about["outputs"]}
    returns = out.pop("backtest_returns", [])
    curve = [{k: r[k] for k in ("timestamp", "equity_curve", "net_return")} for r in returns]
    return json.loads(scrubbed(json.dumps({"folder": folder, "summary": about, "tables": out, "equity_curve": curve, "artifacts": sorted(about["outputs"])}), root))


def allowed_target(root: str | Path, target: str | Path, run: str | Path) -> Path:
    """target, if an export may go there: within root, not root, the run's own folder, or one that is kept for something else."""
    found = configs.confined(root, target)
    if found == Path(root).resolve() or found == Path(run).resolve() or found.name in RESERVED:
        raise ValueError(f"nothing is exported into {found}")
    return found


def export(spark: SparkSession, folder: str, target: str, bars: int = 1000, root: str | None = None, config: dict | None = None, runs: DataFrame | None = None) -> dict[str, str]:
    """All of a run as JSON under target: every table whole, each symbol's last bars (20 to 5000) with
    their indicators, the summary, config, last 50 runs, health and an empty live feed. Returns the paths.
    Tables are written by the tasks; with root given, texts don't tell where it is.
    """
    about = _summary_of(spark, folder)
    csv, base, out = about["format"] == "csv", target.rstrip("/"), {}
    for name in sorted(about["outputs"]):
        out[name] = f"{base}/artifacts/{name}"
        as_json(read(spark, folder, name, csv), root).write.mode("overwrite").text(out[name])
    n = min(max(bars, BARS[0]), BARS[1])
    last = Window.partitionBy("symbol").orderBy(F.col("timestamp").desc())
    shown = read(spark, folder, "technical_indicators" if "technical_indicators" in about["outputs"] else "market_data", csv).withColumn("__n", F.row_number().over(last)).filter(F.col("__n") <= n).drop("__n")
    out["market"] = f"{base}/api/market"
    shown.repartition("symbol").sortWithinPartitions("symbol", "timestamp").write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("symbol").json(out["market"])
    texts = {
        "summary": about, "config": {"config": config or {}}, "health": {"status": "ok", "mode": "static"},
        "realtime": {"status": "static", "error": None, "startedAt": None, "stoppedAt": None, "messageCount": 0, "orderBooks": [], "trades": [], "liquidations": [], "events": []},
        "runs": {"runs": [json.loads(r["value"]) for r in as_json(runs.orderBy(F.col("updated_at").desc_nulls_last(), "run_id").limit(50)).collect()] if runs is not None else []},
    }
    for name, value in texts.items():
        out[name] = write_text(spark, scrubbed(json.dumps(value, ensure_ascii=False, default=str), root), f"{base}/api/{name}")
    about_site = {"mode": "static", "source": folder, "target": target, "api": sorted([*texts, "market"]), "artifacts": sorted(about["outputs"])}
    out["manifest"] = write_text(spark, scrubbed(json.dumps(about_site), root), f"{base}/manifest")
    return out
