"""Queries of bars, factors, evaluation, backtests and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions import workdir
from factorlake.functions.numerics import rounded
from factorlake.operators import backtest, evaluation, factors, walkforward
from factorlake.plans import sqltext as S
from factorlake.sources import bars

WINDOWS, HORIZONS = list(S.WINDOWS), S.HORIZONS
NAMES = factors.names(WINDOWS)
CONFIG = backtest.BacktestConfig(transaction_cost_bps=5.0, slippage_bps=2.0)
FOLDS = walkforward.WalkForwardConfig(enabled=True, splits=3, train_fraction=0.5, embargo=2, min_train=30, min_test=20)
FEW = walkforward.WalkForwardConfig(enabled=True, splits=2, train_fraction=0.5, embargo=1, min_test=20)
ONE = "mom_5"


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return factors.panel(bars.events_hourly(spark, d), WINDOWS, HORIZONS)


def _eval(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluate(_panel(spark, d), NAMES, HORIZONS)


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.observations(_panel(spark, d), NAMES, HORIZONS)


def _line_panel(spark: SparkSession, d: str) -> DataFrame:
    return factors.panel(bars.lineitem_daily(spark, d), WINDOWS, HORIZONS)


def _one(spark: SparkSession, d: str, panel: DataFrame | None = None) -> DataFrame:
    p = _line_panel(spark, d) if panel is None else panel
    return backtest.one(p, ONE, 1)


def rates(spark: SparkSession, d: str) -> DataFrame:
    """A weekly funding history for each symbol of the daily bars."""
    t = bars.read(spark, d, "lineitem")
    week = F.date_trunc("week", "l_shipdate").cast("timestamp_ntz")
    return t.groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), week.alias("timestamp")).agg(((F.avg("l_discount") - 0.05) * 3.0 * 365.0).alias("annualized_funding_rate"))


RATES = "rates AS (SELECT l_returnflag || l_linestatus AS symbol, date_trunc('week', l_shipdate)::TIMESTAMP AS timestamp, (avg(l_discount) - 0.05::DOUBLE) * 3.0::DOUBLE * 365.0::DOUBLE AS annualized_funding_rate FROM lineitem GROUP BY ALL)"


def spreads(spark: SparkSession, d: str) -> DataFrame:
    return bars.read(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol")).agg((F.avg("l_tax") * 100.0).alias("spread_bps"))


SPREADS = "spreads AS (SELECT l_returnflag || l_linestatus AS symbol, avg(l_tax) * 100.0::DOUBLE AS spread_bps FROM lineitem GROUP BY ALL)"
LONG_ONLY = backtest.BacktestConfig(mode="long_only", quantile=0.4)
COSTLY = backtest.BacktestConfig(transaction_cost_bps=5.0, slippage_bps=2.0, spread_multiplier=0.5, funding_enabled=True, funding_multiplier=1.0, annualization=8760)
ROWS = f"rows_ AS (SELECT timestamp, symbol, {ONE} AS value, 1 AS direction, fwd_return_1 AS target FROM panel WHERE {ONE} IS NOT NULL AND fwd_return_1 IS NOT NULL)"
_P = f"WITH {S.EVENT_BARS},\n{S.panel()}"
_B = f"WITH {S.line_bars()},\n{S.panel()},\n{ROWS}"
METRICS = "^total_return ^annualized_return ~annualized_volatility ~sharpe ^max_drawdown ~win_rate ~average_turnover ~average_execution_cost ~average_funding_cost periods"
BIG = ("total_return", "annualized_return", "max_drawdown", "equity_curve", "test_total_return", "test_max_drawdown")
EVAL_COLS = "factor horizon observations ~pooled_pearson ~pooled_spearman ~mean_cross_section_ic ~ic_ir ~positive_cross_section_ic_ratio ~mean_time_series_ic ~quantile_spread direction ~score"
BAR_COLS = "timestamp symbol open high low close volume asset_class frequency"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Rank IC of five-bar momentum at each horizon, with the rank portfolio's metrics."""
    rows = evaluation.observations(_panel(spark, d), [ONE], HORIZONS)
    ic = evaluation.cross_section_summary(evaluation.cross_section_ic(rows))
    m = backtest.metrics(backtest.returns(_one(spark, d, _panel(spark, d)), CONFIG), CONFIG)
    return rounded(ic.join(F.broadcast(m.select("sharpe", "total_return", "periods")), how="cross"))


def bt_metrics_costly(spark: SparkSession, d: str) -> DataFrame:
    r = backtest.returns(_one(spark, d), COSTLY, spreads=spreads(spark, d), rates=rates(spark, d))
    return rounded(backtest.metrics(r, COSTLY), 6, BIG)


def _funding(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.funding_costs(backtest.weights(_one(spark, d), COSTLY), rates(spark, d), COSTLY), 8)


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    p = workdir.written(_line_panel(spark, d))
    out = backtest.sweep(p, NAMES, evaluation.evaluate(p, NAMES, (1,)), CONFIG)
    return rounded(out.drop("error"), 5, BIG)


def _folds(spark: SparkSession, d: str) -> DataFrame:
    return walkforward.folds(bars.events_hourly(spark, d), FOLDS)


def _walk(spark: SparkSession, d: str) -> DataFrame:
    m = bars.events_hourly(spark, d)
    return rounded(walkforward.validate(m, factors.panel(m, WINDOWS), NAMES, FOLDS, CONFIG), 5, BIG)


def _walk_costly(spark: SparkSession, d: str) -> DataFrame:
    """Folds after spreads and funding, on daily bars."""
    m = bars.lineitem_daily(spark, d)
    return rounded(walkforward.validate(m, factors.panel(m, WINDOWS), NAMES, FOLDS, COSTLY, spreads(spark, d), rates(spark, d)), 5, BIG)


BACKWARDS = backtest.BacktestConfig.of({"transaction_cost_bps": 5, "slippage_bps": 2, "funding_enabled": True, "funding_cost_multiplier": 1.0, "funding_rate_column": "realized_rate", "annualization": 8760, "direction": -1})


def _backwards(spark: SparkSession, d: str) -> DataFrame:
    """The factor against its direction, with funding by a column that the config names."""
    t = bars.read(spark, d, "lineitem")
    realized = t.groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("timestamp")).agg(((F.avg("l_tax") - 0.04) * 3.0 * 365.0).alias("realized_rate"))
    r = backtest.returns(backtest.single(_line_panel(spark, d), ONE, BACKWARDS), BACKWARDS, rates=realized)
    return rounded(backtest.metrics(r, BACKWARDS), 6, BIG)


def _sixty(spark: SparkSession, d: str) -> DataFrame:
    """Folds over the first 60 bar times: the first training slice is 30 of them."""
    times = bars.events_hourly(spark, d).select("timestamp").distinct().orderBy("timestamp").limit(60)
    return walkforward.folds(times, FEW)


def _sweep_costly(spark: SparkSession, d: str) -> DataFrame:
    p = workdir.written(_line_panel(spark, d))
    out = backtest.sweep(p, NAMES, evaluation.evaluate(p, NAMES, (1,)), COSTLY, spreads(spark, d), rates(spark, d))
    return rounded(out.drop("error"), 5, BIG)


def books(spark: SparkSession, d: str) -> DataFrame:
    """Two book snapshots for each symbol of the daily bars, and one without a spread."""
    t = bars.read(spark, d, "lineitem")
    day = F.date_trunc("year", "l_shipdate").cast("timestamp_ntz")
    return t.groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), day.alias("timestamp")).agg(F.when(F.year(F.first(day)) < 1998, F.avg("l_tax") * 100.0).alias("spread_bps"))


BOOKS = "books AS (SELECT l_returnflag || l_linestatus AS symbol, date_trunc('year', l_shipdate)::TIMESTAMP AS timestamp, CASE WHEN year(l_shipdate) < 1998 THEN avg(l_tax) * 100.0::DOUBLE END AS spread_bps FROM lineitem GROUP BY symbol, timestamp, year(l_shipdate))"


def _combine(spark: SparkSession, d: str) -> DataFrame:
    m = bars.events_hourly(spark, d)
    a = factors.panel(m, [3]).filter("symbol <> 'click'").select("timestamp", "symbol", "mom_3")
    b = factors.panel(m, [5]).filter("mom_5 > 0").select("timestamp", "symbol", "mom_5")
    return rounded(factors.combine([a, b]))


def queries() -> dict:
    f = {}
    f["bars_events_1h"] = lambda s, d: bars.events_hourly(s, d)
    f["bars_lineitem_1d"] = lambda s, d: bars.lineitem_daily(s, d)
    f["bars_supplier_1d"] = lambda s, d: bars.suppliers_daily(s, d)
    groups = {"factor_return_1": ["return_1"]} | {f"factor_{g}": [n for n in NAMES if n.rpartition("_")[0] in k] for g, k in (("momentum_reversal", ("mom", "reversal")), ("volatility", ("volatility",)), ("ma_gap", ("ma_gap",)), ("volume_zscore", ("volume_zscore",)), ("range_position", ("range_position",)), ("amihud", ("amihud",)))}
    for g, cols in groups.items():
        f[g] = lambda s, d, cols=cols: rounded(_panel(s, d).select("timestamp", "symbol", *cols))
    f["factor_panel_wide"] = lambda s, d: rounded(factors.panel(bars.lineitem_daily(s, d), WINDOWS))
    f["factor_panel_long"] = lambda s, d: rounded(factors.long_panel(_panel(s, d).select("timestamp", "symbol", *NAMES), NAMES))
    f["forward_returns"] = lambda s, d: rounded(_panel(s, d).select("timestamp", "symbol", *(f"fwd_return_{h}" for h in HORIZONS)))
    f["factor_candidates"] = lambda s, d: factors.candidates(s, WINDOWS)
    f["panel_outer_combine"] = _combine
    f["eval_pooled"] = lambda s, d: rounded(evaluation.pooled(_obs(s, d)))
    f["eval_cs_ic_series"] = lambda s, d: rounded(evaluation.cross_section_ic(_obs(s, d)))
    f["eval_ic_summary"] = lambda s, d: rounded(evaluation.cross_section_summary(evaluation.cross_section_ic(_obs(s, d))))
    f["eval_ts_ic"] = lambda s, d: rounded(evaluation.time_series_ic(_obs(s, d)))
    f["eval_quantile_spread"] = lambda s, d: rounded(evaluation.quantile_spread(_obs(s, d)))
    f["eval_full"] = lambda s, d: rounded(_eval(s, d))
    f["select_top_factor"] = lambda s, d: rounded(evaluation.select_top(_eval(s, d), 1))
    f["bt_weights_long_short"] = lambda s, d: rounded(backtest.weights(_one(s, d), CONFIG))
    f["bt_weights_long_only"] = lambda s, d: rounded(backtest.weights(_one(s, d), LONG_ONLY))
    f["bt_turnover"] = lambda s, d: rounded(backtest.turnover(backtest.weights(_one(s, d), CONFIG)).filter("turnover > 0"))
    f["bt_exec_cost"] = lambda s, d: rounded(backtest.execution_costs(backtest.turnover(backtest.weights(_one(s, d), COSTLY)), COSTLY, spreads(s, d)), 8)
    f["bt_funding_asof"] = _funding
    f["bt_returns"] = lambda s, d: rounded(backtest.returns(_one(s, d), CONFIG).drop("drawdown"), 6, BIG)
    f["bt_metrics"] = lambda s, d: rounded(backtest.metrics(backtest.returns(_one(s, d), CONFIG), CONFIG), 6, BIG)
    f["bt_metrics_costly"] = bt_metrics_costly
    f["bt_direction_and_rate_column"] = _backwards
    f["bt_sides"] = lambda s, d: rounded(backtest.sides(backtest.weights(_one(s, d), CONFIG)))
    f["bt_all_factors"] = _sweep
    f["bt_all_factors_costly"] = _sweep_costly
    f["bt_spread_last_row_wins"] = lambda s, d: rounded(backtest.execution_costs(backtest.turnover(backtest.weights(_one(s, d), COSTLY)), COSTLY, books(s, d)), 8)
    f["wf_folds"] = _folds
    f["wf_folds_sixty"] = _sixty
    f["wf_results"] = _walk
    f["wf_results_costly"] = _walk_costly
    return f


def _description(name: str) -> str:
    return factors.DESCRIPTIONS[name if name == "return_1" else name.rpartition("_")[0]].replace("'", "''")


def _folds_sql(c: walkforward.WalkForwardConfig = FOLDS) -> str:
    # Counts as the survey states them: least first training slice, room behind it, equal test slices.
    t, e, k = c.min_test, c.embargo, c.splits
    return f"""ft AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i FROM (SELECT DISTINCT timestamp FROM bars)),
nt AS (SELECT count(*) AS n FROM ft),
ta AS (SELECT n, greatest({t}, floor(n * {c.train_fraction})::BIGINT) AS t0 FROM nt),
tb AS (SELECT n, CASE WHEN n - t0 - {e} < {t} THEN greatest({t}, n - {t} - {e}) ELSE t0 END AS train FROM ta),
tc AS (SELECT n, train, greatest({t}, floor((n - train - {e}) / {k}.0)::BIGINT) AS test FROM tb),
fi AS (SELECT i::INT AS fold, train + (i - 1) * test - 1 AS e, train + (i - 1) * test + {e} AS s, least(train + (i - 1) * test + {e} + test - 1, n - 1) AS l, n FROM tc, range(1, {k + 1}) t(i)),
folds AS (SELECT fold, (SELECT min(timestamp) FROM ft) AS train_start, a.timestamp AS train_end, b.timestamp AS test_start, c.timestamp AS test_end FROM fi JOIN ft a ON a.i = e JOIN ft b ON b.i = s JOIN ft c ON c.i = l WHERE l - s + 1 >= {t})"""


def _walk_sql(head: str = _P, more: str = "", **costs) -> str:
    names = ", ".join(NAMES)
    def side(name: str, cond: str) -> str:
        return f"""{name}b AS (SELECT fold, timestamp, symbol, lead(close, 1) OVER (PARTITION BY fold, symbol ORDER BY timestamp) / nullif(close, 0) - 1 AS target FROM bars JOIN folds ON {cond}),
{name} AS (UNPIVOT (SELECT fold, timestamp, symbol, target, {names} FROM {name}b JOIN panel USING (timestamp, symbol) WHERE target IS NOT NULL) ON {names} INTO NAME factor VALUE value)"""
    rank = lambda x: S.avg_rank(x, "fold, factor")
    return f"""{head},
{more}{_folds_sql()},
{side('tr', 'timestamp <= train_end')},
{side('te', 'timestamp BETWEEN test_start AND test_end')},
tk AS (SELECT fold, factor, {rank('value')} AS a, {rank('target')} AS b FROM tr),
sc AS (SELECT fold, factor, count(*)::BIGINT AS train_observations, {S.corr('a', 'b')} AS train_spearman FROM tk GROUP BY ALL HAVING count(*) >= 30),
be AS (SELECT *, abs(train_spearman) * sqrt(train_observations::DOUBLE) AS train_score, (CASE WHEN train_spearman >= 0 THEN 1 ELSE -1 END)::INT AS direction FROM sc
       QUALIFY row_number() OVER (PARTITION BY fold ORDER BY abs(train_spearman) * sqrt(train_observations::DOUBLE) DESC NULLS LAST, factor) = 1),
rows_ AS (SELECT te.*, direction FROM te JOIN be USING (fold, factor)),
{S.backtest('rows_', 'fold', **costs)}
SELECT {S.rnd('fold train_start train_end test_start test_end')}, {', '.join(f"CASE WHEN test_periods IS NOT NULL THEN {x} END AS {n}" for n, x in (('factor', 'factor'), ('train_observations', 'train_observations'), ('train_spearman', 'round(train_spearman, 5) + 0.0::DOUBLE'), ('train_score', 'round(train_score, 5) + 0.0::DOUBLE'), ('direction', 'direction')))}, {S.rnd('^test_total_return ~test_sharpe ^test_max_drawdown ~test_win_rate test_periods', 5)}, 2::INT AS embargo,
  CASE WHEN factor IS NULL THEN 'no factor to choose' WHEN test_periods IS NULL THEN 'no test rows' END AS error
FROM folds LEFT JOIN be USING (fold) LEFT JOIN (SELECT fold, total_return AS test_total_return, sharpe AS test_sharpe, max_drawdown AS test_max_drawdown, win_rate AS test_win_rate, periods AS test_periods FROM mt) USING (fold)"""


def oracle_sql() -> dict[str, str]:
    o = {}
    o["bars_events_1h"] = f"WITH {S.EVENT_BARS} SELECT {S.rnd(BAR_COLS)} FROM bars"
    o["bars_lineitem_1d"] = f"WITH {S.line_bars()} SELECT {S.rnd(BAR_COLS)} FROM bars"
    o["bars_supplier_1d"] = f"WITH {S.line_bars('l_suppkey::VARCHAR')} SELECT {S.rnd(BAR_COLS)} FROM bars"
    cols = lambda names: S.rnd("timestamp symbol " + " ".join("~" + n for n in names))
    groups = {"factor_return_1": ["return_1"], "factor_momentum_reversal": [n for n in NAMES if n.startswith(("mom", "rev"))]}
    groups |= {f"factor_{k}": [n for n in NAMES if n.startswith(k + "_")] for k in ("volatility", "ma_gap", "volume_zscore", "range_position", "amihud")}
    for g, names in groups.items():
        o[g] = f"{_P} SELECT {cols(names)} FROM panel"
    o["factor_panel_wide"] = f"WITH {S.line_bars()}, {S.panel(horizons=())} SELECT {cols(NAMES)} FROM panel"
    o["factor_panel_long"] = f"{_P} SELECT timestamp, symbol, factor, round(value, 6) + 0.0::DOUBLE AS value FROM (UNPIVOT (SELECT timestamp, symbol, {', '.join(NAMES)} FROM panel) ON {', '.join(NAMES)} INTO NAME factor VALUE value)"
    o["forward_returns"] = f"{_P} SELECT {cols([f'fwd_return_{h}' for h in HORIZONS])} FROM panel"
    texts = ", ".join(f"('{n}', 'operator', '{_description(n)}')" for n in NAMES)
    o["factor_candidates"] = f"SELECT * FROM (VALUES {texts}) t(name, source, description)"
    o["panel_outer_combine"] = f"{_P} SELECT timestamp, symbol, round(a.mom_3, 6) + 0.0::DOUBLE AS mom_3, round(b.mom_5, 6) + 0.0::DOUBLE AS mom_5 FROM (SELECT timestamp, symbol, mom_3 FROM panel WHERE symbol <> 'click') a FULL JOIN (SELECT timestamp, symbol, mom_5 FROM panel WHERE mom_5 > 0) b USING (timestamp, symbol)"
    e = S.base()
    o["eval_pooled"] = f"{e} SELECT {S.rnd('horizon factor observations ~pooled_pearson ~pooled_spearman')} FROM po"
    o["eval_cs_ic_series"] = f"{e} SELECT {S.rnd('horizon factor timestamp ~ic n')} FROM cs"
    o["eval_ic_summary"] = f"{e} SELECT {S.rnd('horizon factor ~cs_ic ~ic_ir ~positive_cross_section_ic_ratio')} FROM csum"
    o["eval_ts_ic"] = f"{e} SELECT {S.rnd('horizon factor ~mean_time_series_ic')} FROM ti"
    o["eval_quantile_spread"] = f"{e} SELECT {S.rnd('horizon factor ~quantile_spread')} FROM qs"
    o["eval_full"] = f"{e} SELECT {S.rnd(EVAL_COLS)} FROM ev"
    o["select_top_factor"] = f"{e} SELECT {S.rnd(EVAL_COLS)} FROM ev WHERE horizon = 1 ORDER BY ev.score DESC NULLS LAST, factor LIMIT 1"
    bt = f"{_B}, {S.backtest('rows_')}"
    o["bt_weights_long_short"] = f"{bt} SELECT {S.rnd('timestamp symbol ~weight ~target')} FROM w"
    o["bt_weights_long_only"] = f"{_B}, {S.backtest('rows_', mode='long_only', quantile=0.4)} SELECT {S.rnd('timestamp symbol ~weight ~target')} FROM w"
    o["bt_turnover"] = f"{bt} SELECT {S.rnd('timestamp symbol ~turnover')} FROM moved WHERE moved.turnover > 0"
    o["bt_sides"] = f"{bt} SELECT timestamp, count_if(weight > 0)::INT AS longs, count_if(weight < 0)::INT AS shorts, round(sum(abs(weight)), 6) + 0.0::DOUBLE AS gross, round(sum(weight), 6) + 0.0::DOUBLE AS net FROM w GROUP BY timestamp"
    costly = f"{_B}, {RATES}, {SPREADS},{S.backtest('rows_', ann=8760, spread=0.5, funding=1.0)}"
    o["bt_exec_cost"] = f"{costly} SELECT {S.rnd('timestamp ~turnover ~execution_cost', 8)} FROM ex"
    o["bt_funding_asof"] = f"{costly} SELECT {S.rnd('timestamp ~funding_cost', 8)} FROM fu"
    o["bt_returns"] = f"{bt} SELECT {S.rnd('timestamp ~gross_return ~turnover ~execution_cost ~funding_cost ~total_cost ~net_return ^equity_curve')} FROM rt"
    o["bt_metrics"] = f"{bt} SELECT {S.rnd(METRICS)} FROM mt"
    o["bt_metrics_costly"] = f"{costly} SELECT {S.rnd(METRICS)} FROM mt"
    back = f"WITH {S.line_bars()},\n{S.panel()},\n{ROWS.replace('1 AS direction', '-1 AS direction')}, {RATES.replace('avg(l_discount) - 0.05', 'avg(l_tax) - 0.04')}, {S.backtest('rows_', ann=8760, funding=1.0)}"
    o["bt_direction_and_rate_column"] = f"{back} SELECT {S.rnd(METRICS)} FROM mt"
    one = ",\n".join(("WITH " + S.line_bars(), S.panel(), S.long(horizons=(1,)), S.EVAL))
    rows = "rows_ AS (SELECT factor, timestamp, symbol, value, target, direction FROM obs JOIN (SELECT factor, direction FROM ev) USING (factor))"
    o["bt_all_factors"] = f"{one}, {rows}, {S.backtest('rows_', 'factor')} SELECT {S.rnd('factor horizon direction ~score ~pooled_spearman ~quantile_spread observations ' + METRICS, 5)} FROM ev LEFT JOIN mt USING (factor)"
    o["bt_all_factors_costly"] = f"{one}, {rows}, {RATES}, {SPREADS}, {S.backtest('rows_', 'factor', ann=8760, spread=0.5, funding=1.0)} SELECT {S.rnd('factor horizon direction ~score ~pooled_spearman ~quantile_spread observations ' + METRICS, 5)} FROM ev LEFT JOIN mt USING (factor)"
    last = "spreads AS (SELECT symbol, spread_bps FROM books WHERE spread_bps IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1)"
    o["bt_spread_last_row_wins"] = f"{_B}, {BOOKS}, {last}, {S.backtest('rows_', ann=8760, spread=0.5)} SELECT {S.rnd('timestamp ~turnover ~execution_cost', 8)} FROM ex"
    o["wf_folds"] = f"WITH {S.EVENT_BARS}, {_folds_sql()} SELECT * FROM folds"
    sixty = "bars AS (SELECT timestamp FROM (SELECT DISTINCT timestamp FROM all_bars) ORDER BY timestamp LIMIT 60)"
    o["wf_folds_sixty"] = f"WITH {S.EVENT_BARS.replace('bars AS (', 'all_bars AS (', 1)}, {sixty}, {_folds_sql(FEW)} SELECT * FROM folds"
    o["wf_results"] = _walk_sql()
    o["wf_results_costly"] = _walk_sql(f"WITH {S.line_bars()},\n{S.panel()}", f"{RATES},\n{SPREADS},\n", ann=8760, spread=0.5, funding=1.0)
    return o
