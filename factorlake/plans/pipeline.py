"""The research run: a JSON config to bars, factors, evaluation, backtests, signals, cards and artifacts."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions import workdir
from factorlake.operators import backtest, context, decisions, evaluation, factors, mining, prepare, quality, signals, store, technicals, walkforward
from factorlake.plans import configs, site
from factorlake.schemas import DataRequest
from factorlake.sources import onchain, providers

EMPTY = {
    "derivatives": "timestamp timestamp_ntz, symbol string, annualized_funding_rate double, oi_usd double, crowding string, crowding_label string, interpretation string",
    "history": "timestamp timestamp_ntz, symbol string, annualized_funding_rate double, oi_usd double, long_short_ratio double",
    "micro": "timestamp timestamp_ntz, symbol string, microstructure_label string, spread_bps double, depth_imbalance double, interpretation string",
    "onchain": "timestamp timestamp_ntz, symbol string, active_addresses double, active_address_change double, tx_count double, tx_count_change double, onchain_label string, interpretation string",
}


# The section of each feed and the switches in it, which are on unless false.
SWITCHES = {"derivatives": ("derivatives", "enabled"), "history": ("derivatives", "enabled", "history_enabled"), "micro": ("microstructure", "enabled"), "onchain": ("onchain", "enabled")}
ONCHAIN = "coinmetrics_community"


def allowed_feeds(config: dict, feeds: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], list[str]]:
    """The feeds that a run may use, and warnings.

    Exchange feeds go with the okx provider only; the on-chain one needs a section of
    its own that names no other provider. What is switched off is as if not given.
    """
    exchange = str(config["data"].get("provider", "")).lower() == "okx"
    chain = config.get("onchain") or {}
    named = str(chain.get("provider", ONCHAIN)).lower()
    fits = {"derivatives": exchange, "history": exchange, "micro": exchange, "onchain": bool(chain) and named == ONCHAIN}
    on = {k: all((config.get(section) or {}).get(s) is not False for s in switches) for k, (section, *switches) in SWITCHES.items()}
    unknown = [f"unknown on-chain provider {named}"] if chain and on["onchain"] and named != ONCHAIN else []
    return {k: v for k, v in feeds.items() if fits[k] and on[k]}, unknown


class Canceled(RuntimeError):
    pass


@dataclass
class RunContext:
    run_id: str = "run"
    log: Callable[[str, str], None] = lambda level, message: None
    is_canceled: Callable[[], bool] = lambda: False

    def checkpoint(self, message: str) -> None:
        if self.is_canceled():
            raise Canceled(self.run_id)
        self.log("INFO", message)


@dataclass
class Runner:
    spark: SparkSession
    config: dict
    context: RunContext = field(default_factory=RunContext)
    feeds: dict[str, DataFrame] = field(default_factory=dict)  # derivatives, history, micro, onchain, where there are any
    onchain_fetch: Callable[[str, str, str, str], str] | None = None  # asks for on-chain metrics where no such feed is given

    warnings: list[str] = field(default_factory=list)
    _kept: list[DataFrame] = field(default_factory=list)

    def validate(self) -> None:
        configs.validate(self.config)

    def _keep(self, frame: DataFrame) -> DataFrame:
        """frame, kept until the run has been written."""
        self._kept.append(frame.persist())
        return frame

    def release(self) -> None:
        for frame in self._kept:
            frame.unpersist()
        self._kept.clear()

    def frames(self) -> dict[str, DataFrame]:
        """Every result of the run by artifact name, lazy but for what the forest fits."""
        self.validate()
        c, tell = self.config, self.context.checkpoint
        data = c["data"]
        request = DataRequest.of(data)
        tell("load market")
        raw = providers.build(data).load(self.spark, request)
        market = self._keep(prepare.adjust(prepare.normalise(raw), configs.adjustments(c)))
        asked = dict(self.feeds)
        if self.onchain_fetch and "onchain" not in asked:
            replies = workdir.written(onchain.Metrics(self.onchain_fetch).load(self.spark, request))
            asked["onchain"] = onchain.context_of(replies)
        given, warnings = allowed_feeds(c, asked)
        if "onchain" in given and "onchain" not in self.feeds:
            # One row for each symbol and metric that failed.
            warnings += [f"{r.symbol}: {r.warning}" for r in onchain.context_warnings(replies).orderBy("symbol", "metric").collect()]
        self.warnings = warnings
        for w in warnings:
            self.context.log("WARN", w)
        feeds = {k: given.get(k, self.spark.createDataFrame([], s)) for k, s in EMPTY.items()}
        tell("quality")
        report = self._keep(quality.symbols(market))
        windows, horizons = [int(w) for w in c["factors"].get("windows", [5, 10, 20])], tuple(int(h) for h in c["factors"].get("horizons", [1]))
        least = int(c["factors"].get("min_observations", 30))
        tell("factors")
        panel = self._keep(factors.panel(market, windows, horizons))
        names = factors.names(windows)
        found = factors.candidates(self.spark, windows)
        ml = c.get("ml") or {}
        if ml.get("enabled"):
            predicted, extra = mining.forest(market, windows, horizons[0], int(ml.get("n_estimators", 80)), seed=int(ml.get("seed", 7)))
            if extra:
                panel = self._keep(factors.combine([panel, predicted]))
                names = [*names, extra[0]["name"]]
                found = found.unionByName(self.spark.createDataFrame([(e["name"], e["source"], e["description"]) for e in extra], found.schema))
        tell("evaluation")
        scored = self._keep(evaluation.evaluate(panel, names, horizons, least, int(c["factors"].get("min_cross_section_assets", 3))))
        b = c["backtest"]
        config = backtest.BacktestConfig.of(b)
        top = evaluation.select_top(scored, config.horizon)
        rows = backtest.factor_rows(panel, names, scored, config.horizon)
        best = rows.join(F.broadcast(top.select("factor")), "factor", "left_semi").drop("factor")
        curve = backtest.returns(best, config, spreads=given.get("micro"), rates=given.get("history"))
        tell("backtests")
        swept = self._keep(backtest.sweep(panel, names, scored, config, given.get("micro"), given.get("history")))
        wf = walkforward.WalkForwardConfig(**(c.get("walk_forward") or {}))
        tell("signals and cards")
        radar = self._keep(signals.radar(panel, names, swept, int((c.get("signals") or {}).get("min_history", 20))))
        level = quality.summary(report).first()["status"]
        provider = str(data.get("provider", "synthetic")).lower()
        now = datetime.fromisoformat(c["generated_at"]) if c.get("generated_at") else datetime.now(timezone.utc).replace(tzinfo=None)
        indicators = technicals.panel(market)
        status = context.source_status(provider, request.frequency, market, {"derivatives_snapshot": given.get("derivatives"), "derivatives_history": given.get("history"), "microstructure": given.get("micro"), "onchain": given.get("onchain")}, now)
        return {
            "market_data": market, "data_quality": report, "data_quality_issues": quality.issues(report), "data_quality_summary": quality.summary(report), "source_status": status, "source_overall": context.overall_status(status, provider),
            "derivatives_snapshot": feeds["derivatives"], "derivatives_history": feeds["history"], "microstructure_snapshot": feeds["micro"], "onchain_metrics": feeds["onchain"], "technical_indicators": indicators,
            "indicator_states": technicals.states(indicators), "factor_panel": panel, "factor_candidates": found, "factor_evaluation": scored, "top_factor": top, "backtest_returns": curve.drop("drawdown"), "backtest_metrics": backtest.metrics(curve, config),
            "factor_backtests": swept, "walk_forward": walkforward.validate(market, panel, names, wf, config, given.get("micro"), given.get("history")), "factor_signals": radar,
            "decision_cards": decisions.cards(market, radar, feeds["derivatives"], feeds["history"], feeds["micro"], feeds["onchain"], level), "raw_snapshots": store.manifest(market, self.context.run_id, "market_data", provider, "market_data"),
        }

    def run(self, folder: str, csv: bool = False) -> dict:
        """Writes all artifacts and the summary, which it returns; what is too large for a summary is capped there."""
        try:
            paths = store.write_artifacts(self.frames(), folder, csv)
        finally:
            self.release()
        out = {"run_id": self.context.run_id, "config_hash": store.config_hash(self.config), "artifacts": paths} | site.summary(self.spark, folder, paths, csv, self.warnings)
        out |= {"metrics": out["backtest_metrics"], "quality": out["data_quality_summary"], "source": out["source_overall"]}
        site.write_text(self.spark, json.dumps(out, ensure_ascii=False), f"{folder.rstrip('/')}/summary")
        self.context.checkpoint("done")
        return out


def export_site(spark: SparkSession, folder: str, target: str, bars_per_symbol: int = 500, root: str | None = None, config: dict | None = None, runs: DataFrame | None = None) -> dict[str, str]:
    """A run as JSON under target, see site.export; with root given, target has to be a folder of its own within it."""
    if root:
        site.allowed_target(root, target, folder)
    return site.export(spark, folder, target, bars_per_symbol, root, config, runs)
