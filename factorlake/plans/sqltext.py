"""Building blocks of the DuckDB twins: named CTEs over the registered views."""

from __future__ import annotations

WINDOWS = (3, 5, 10, 20)
HORIZONS = (1, 5)

EVENT_BARS = """bars AS (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp, event_type AS symbol, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume, 'crypto' AS asset_class, '1h' AS frequency
  FROM events GROUP BY ALL)"""

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


def line_bars(symbol: str = "l_returnflag || l_linestatus") -> str:
    return f"""bars AS (
  SELECT l_shipdate::TIMESTAMP AS timestamp, {symbol} AS symbol, first(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS open, max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS close, sum(l_quantity)::DOUBLE AS volume, 'equity' AS asset_class, '1d' AS frequency
  FROM lineitem GROUP BY ALL)"""


W = "PARTITION BY symbol ORDER BY timestamp"


def least(w: int) -> int:
    return max(2, min(w, max(3, w // 2)))


def roll(f: str, x: str, n: int, mp: int, by: str = W) -> str:
    over = f"OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {mp} THEN {f}({x}) {over} END"


def deviation(x: str, n: int, mp: int, by: str = W) -> str:
    """Population deviation by the running mean, value after value: whole volumes give many equal scores, which another order of sums would tell apart."""
    over = f"OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    step = "{'n': p.n + 1, 'a': p.a + (q.a - p.a) / (p.n + 1), 'm': p.m + (q.a - p.a) * ((q.a - p.a) - (q.a - p.a) / (p.n + 1))}"
    each = f"list_transform(list({x}) {over}, lambda v: {{'n': 1.0::DOUBLE, 'a': v::DOUBLE, 'm': 0.0::DOUBLE}})"
    return f"CASE WHEN count({x}) {over} >= {mp} THEN sqrt(list_reduce({each}, lambda p, q: {step}).m / count({x}) {over}) END"


def factor_names(windows=WINDOWS) -> list[str]:
    return ["return_1", *(f"{k}_{w}" for w in windows for k in ("mom", "reversal", "volatility", "ma_gap", "volume_zscore", "range_position", "amihud"))]


def panel(windows=WINDOWS, horizons=HORIZONS) -> str:
    """CTEs r and panel over bars."""
    cols = ["timestamp", "symbol", "return_1"]
    for w in windows:
        m = least(w)
        cols += [
            f"close / nullif(lag(close, {w}) OVER ({W}), 0) - 1 AS mom_{w}", f"-(close / nullif(lag(close, {w}) OVER ({W}), 0) - 1) AS reversal_{w}",
            f"{roll('stddev_pop', 'return_1', w, m)} AS volatility_{w}", f"close / nullif({roll('avg', 'close', w, m)}, 0) - 1 AS ma_gap_{w}",
            f"(volume - {roll('avg', 'volume', w, m)}) / nullif({deviation('volume', w, m)}, 0) AS volume_zscore_{w}",
            f"(close - {roll('min', 'low', w, m)}) / nullif({roll('max', 'high', w, m)} - {roll('min', 'low', w, m)}, 0) AS range_position_{w}",
            f"{roll('avg', 'amihud_1', w, m)} AS amihud_{w}",
        ]
    cols += [f"lead(close, {h}) OVER ({W}) / nullif(close, 0) - 1 AS fwd_return_{h}" for h in horizons]
    return f"""r AS (SELECT *, abs(return_1) / nullif(volume, 0) AS amihud_1 FROM (SELECT *, close / nullif(lag(close) OVER ({W}), 0) - 1 AS return_1 FROM bars)),
panel AS (SELECT {', '.join(cols)} FROM r)"""


def long(windows=WINDOWS, horizons=HORIZONS, min_obs: int = 30) -> str:
    """CTEs up to obs: (horizon, factor, timestamp, symbol, value, target, n)."""
    names = ", ".join(factor_names(windows))
    fwd = ", ".join(f"fwd_return_{h}" for h in horizons)
    parts = " UNION ALL ".join(f"SELECT {h}::INT AS horizon, factor, timestamp, symbol, value, fwd_return_{h} AS target FROM l WHERE fwd_return_{h} IS NOT NULL" for h in horizons)
    return f"""l AS (UNPIVOT (SELECT timestamp, symbol, {names}, {fwd} FROM panel) ON {names} INTO NAME factor VALUE value),
obs AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY horizon, factor) AS n FROM ({parts})) WHERE n >= {min_obs})"""


def avg_rank(x: str, keys: str) -> str:
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE)"


def corr(a: str, b: str) -> str:
    return f"CASE WHEN count(*) >= 3 AND min({a}) < max({a}) AND min({b}) < max({b}) THEN covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) END"


def ranked(name: str, keys: str) -> str:
    return f"{name} AS (SELECT {keys}, value, target, {avg_rank('value', keys)} AS a, {avg_rank('target', keys)} AS b FROM obs)"


K = "horizon, factor"


def _bucket() -> str:
    terms = []
    for k in range(1, 5):
        p = f"(({k}.0::DOUBLE / q) * 100.0::DOUBLE / 100.0::DOUBLE * (n - 1))"
        edge = f"(CASE WHEN {p} - floor({p}) >= 0.5 THEN (floor({p}) + 2) - (1.0::DOUBLE - ({p} - floor({p}))) ELSE floor({p}) + 1 + ({p} - floor({p})) END)"
        terms.append(f"(CASE WHEN {k} < q AND r > {edge} THEN 1 ELSE 0 END)")
    return " + ".join(terms)


EVAL = f"""{ranked('pr', K)},
po AS (SELECT {K}, count(*)::BIGINT AS observations, {corr('value', 'target')} AS pooled_pearson, {corr('a', 'b')} AS pooled_spearman FROM pr GROUP BY ALL),
{ranked('cr', K + ', timestamp')},
cs AS (SELECT * FROM (SELECT {K}, timestamp, {corr('a', 'b')} AS ic, count(*)::BIGINT AS n FROM cr GROUP BY ALL) WHERE n >= 3 AND ic IS NOT NULL),
csum AS (SELECT {K}, avg(ic) AS cs_ic, CASE WHEN count(ic) > 1 AND stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) END AS ic_ir, avg((round(ic, 12) > 0)::INT::DOUBLE) AS positive_cross_section_ic_ratio FROM cs GROUP BY ALL),
{ranked('sr', K + ', symbol')},
ti AS (SELECT {K}, avg(ic) AS mean_time_series_ic FROM (SELECT {K}, symbol, {corr('a', 'b')} AS ic, count(*) AS n FROM sr GROUP BY ALL) WHERE n >= 20 GROUP BY ALL),
qk AS (SELECT {K}, least(5, count(DISTINCT value)) AS q FROM obs GROUP BY ALL),
qr AS (SELECT *, {_bucket()} AS bkt FROM (SELECT obs.*, q, row_number() OVER (PARTITION BY {K} ORDER BY value, timestamp, symbol) AS r FROM obs JOIN qk USING ({K}) WHERE q >= 2)),
qs AS (SELECT {K}, avg(target) FILTER (bkt = q - 1) - avg(target) FILTER (bkt = 0) AS quantile_spread FROM qr GROUP BY ALL),
ev AS (SELECT factor, horizon, observations, pooled_pearson, pooled_spearman, coalesce(cs_ic, pooled_spearman) AS mean_cross_section_ic, ic_ir, positive_cross_section_ic_ratio, mean_time_series_ic, quantile_spread,
         (CASE WHEN pooled_spearman >= 0 THEN 1 ELSE -1 END)::INT AS direction, abs(pooled_spearman) * sqrt(observations::DOUBLE) AS score
       FROM po LEFT JOIN csum USING ({K}) LEFT JOIN ti USING ({K}) LEFT JOIN qs USING ({K}))"""


def base(bars: str = EVENT_BARS) -> str:
    return ",\n".join(("WITH " + bars, panel(), long(), EVAL))


def rnd(cols: str, digits: int = 6) -> str:
    """Select list with the doubles among `cols` rounded: by digits after ~, to 9 significant ones as text after ^."""
    one = {"~": lambda c: f"round({c}, {digits}) + 0.0::DOUBLE AS {c}", "^": lambda c: f"format('{{:.8e}}', {c} + 0.0::DOUBLE) AS {c}"}
    return ", ".join(one[c[0]](c[1:]) if c[0] in one else c for c in cols.split())


def count_of(explicit: int | None, quantile: float) -> str:
    return f"greatest(1, least(n, {explicit if explicit is not None else f'ceil(n * {quantile}::DOUBLE)'}))::INT"


def backtest(rows: str, keys: str = "", mode: str = "long_short", quantile: float = 0.2, bps: float = 7.0, ann: int = 252, spread: float = 0.0, funding: float | None = None) -> str:
    """CTEs w, moved, ex, fu, rt, mt over `rows`: (keys, timestamp, symbol, value, direction, target)."""
    k = keys + ", " if keys else ""
    using = f"({k}timestamp)"
    top = count_of(None, quantile)
    if mode == "long_only":
        t, b = top, "0"
    else:
        t, b = f"CASE WHEN n = 1 THEN {top} ELSE least({top}, n - 1) END", f"CASE WHEN n = 1 THEN 0 ELSE least({top}, n - least({top}, n - 1)) END"
    by = f"PARTITION BY {keys}" if keys else ""
    grid = f"SELECT * FROM (SELECT DISTINCT {k}timestamp FROM w) JOIN (SELECT DISTINCT {k}symbol FROM w) {f'USING ({keys})' if keys else 'ON true'}"
    cost = f"{bps}::DOUBLE" + (f" + greatest(coalesce(spread_bps, 0.0::DOUBLE), 0.0::DOUBLE) * {spread}::DOUBLE" if spread else "")
    fu = (
        f"SELECT {k}timestamp, sum(coalesce(weight * annualized_funding_rate / {float(ann)}::DOUBLE * {funding}::DOUBLE, 0.0::DOUBLE)) AS funding_cost FROM (SELECT w.*, rates.annualized_funding_rate FROM w ASOF LEFT JOIN rates ON w.symbol = rates.symbol AND w.timestamp >= rates.timestamp) GROUP BY ALL"
        if funding is not None
        else f"SELECT {k}timestamp, 0.0::DOUBLE AS funding_cost FROM w GROUP BY ALL"
    )
    return f"""wn AS (SELECT *, count(*) OVER (PARTITION BY {k}timestamp) AS n, row_number() OVER (PARTITION BY {k}timestamp ORDER BY value * direction, symbol) AS r FROM {rows}),
wt AS (SELECT *, ({t})::INT AS top, ({b})::INT AS bottom FROM wn),
w AS (SELECT {k}timestamp, symbol, CASE WHEN r > n - top THEN 1.0::DOUBLE / top ELSE -1.0::DOUBLE / bottom END AS weight, target FROM wt WHERE r > n - top OR r <= bottom),
dense AS (SELECT {k}timestamp, symbol, coalesce(weight, 0.0::DOUBLE) AS weight FROM ({grid}) LEFT JOIN w USING ({k}timestamp, symbol)),
moved AS (SELECT {k}timestamp, symbol, coalesce(abs(weight - lag(weight) OVER (PARTITION BY {k}symbol ORDER BY timestamp)), abs(weight)) AS turnover FROM dense),
ex AS (SELECT {k}timestamp, sum(turnover) AS turnover, sum(turnover * ({cost}) / 10000.0::DOUBLE) AS execution_cost FROM moved {'LEFT JOIN spreads USING (symbol)' if spread else ''} GROUP BY ALL),
fu AS ({fu}),
gr AS (SELECT {k}timestamp, sum(weight * target) AS gross_return FROM w GROUP BY ALL),
rt AS (SELECT * REPLACE (CASE WHEN isfinite(equity_curve) THEN equity_curve END AS equity_curve) FROM (SELECT *, product(net_return + 1.0::DOUBLE) OVER ({by} ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS equity_curve FROM
  (SELECT *, execution_cost + funding_cost AS total_cost, gross_return - (execution_cost + funding_cost) AS net_return FROM gr JOIN ex USING {using} JOIN fu USING {using}))),
dd AS (SELECT *, equity_curve / nullif(max(equity_curve) OVER ({by} ORDER BY timestamp ROWS UNBOUNDED PRECEDING), 0) - 1 AS drawdown FROM rt),
mt AS (SELECT {k}last(equity_curve ORDER BY timestamp) - 1 AS total_return, CASE WHEN last(equity_curve ORDER BY timestamp) > 0 THEN pow(last(equity_curve ORDER BY timestamp), {float(ann)}::DOUBLE / count(*)) - 1 END AS annualized_return,
  stddev_pop(net_return) * sqrt({float(ann)}::DOUBLE) AS annualized_volatility, CASE WHEN stddev_pop(net_return) > 0 THEN avg(net_return) / stddev_pop(net_return) * sqrt({float(ann)}::DOUBLE) END AS sharpe,
  min(drawdown) AS max_drawdown, avg((net_return > 0)::INT::DOUBLE) AS win_rate, avg(turnover) AS average_turnover, avg(execution_cost) AS average_execution_cost, avg(funding_cost) AS average_funding_cost, count(*)::BIGINT AS periods
  FROM dd {f'GROUP BY {keys}' if keys else ''})"""
