"""Rank portfolios, costs and metrics, with any further keys (factor, fold) as partition keys.

A sweep over factors is one job: weights, turnover, costs and the equity curve
carry the keys along. A symbol that leaves the portfolio trades too.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from factorlake.functions import ranges
from factorlake.functions.numerics import div, finite, number
from factorlake.functions.ranges import RANGE
from factorlake.operators.factors import long_panel


@dataclass(frozen=True)
class BacktestConfig:
    horizon: int = 1
    mode: str = "long_short"
    quantile: float = 0.2
    top_n: int | None = None
    bottom_n: int | None = None
    transaction_cost_bps: float = 0.0
    slippage_bps: float = 0.0
    spread_multiplier: float = 0.0
    funding_enabled: bool = False
    funding_multiplier: float = 1.0
    annualization: int = 252
    direction: int = 1
    funding_rate_column: str = "annualized_funding_rate"

    @classmethod
    def of(cls, raw: dict, direction: int = 1) -> BacktestConfig:
        """The config in a run's section, whose multipliers may be named spread_cost_multiplier and funding_cost_multiplier; other keys are none of a backtest's."""
        named = {{"spread_cost_multiplier": "spread_multiplier", "funding_cost_multiplier": "funding_multiplier"}.get(k, k): v for k, v in raw.items()}
        known = {f.name: f.type for f in fields(cls)}
        as_type = {"int": int, "float": float, "bool": bool, "str": str, "int | None": lambda v: None if v is None else int(v)}
        try:
            return cls(**{"direction": direction} | {k: as_type[known[k]](v) for k, v in named.items() if k in known})
        except TypeError as e:
            raise ValueError(f"a backtest's setting has the wrong type: {e}") from e

    def __post_init__(self) -> None:
        if self.horizon <= 0:
            raise ValueError("a horizon is positive")
        if self.mode not in ("long_short", "long_only"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.direction not in (1, -1):
            raise ValueError("a direction is 1 or -1")

    @property
    def base_bps(self) -> float:
        return max(self.transaction_cost_bps, 0.0) + max(self.slippage_bps, 0.0)


def _count(explicit: int | None, quantile: float, n: Column) -> Column:
    wanted = F.lit(explicit) if explicit is not None else F.ceil(n * F.lit(quantile))
    return F.greatest(F.lit(1), F.least(n, wanted)).cast("int")


def weights(rows: DataFrame, config: BacktestConfig, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, timestamp, symbol, weight, target) of rows (keys, timestamp, symbol, value, direction, target); only held symbols."""
    at = Window.partitionBy(*keys, "timestamp")
    signal = F.col("value") * F.col("direction")
    n = F.count(F.lit(1)).over(at)
    r = F.row_number().over(at.orderBy(signal, "symbol"))
    ranked = rows.withColumns({"n": n, "r": r})
    top, bottom = _count(config.top_n, config.quantile, F.col("n")), _count(config.bottom_n, config.quantile, F.col("n"))
    long_only = F.lit(config.mode == "long_only") | (F.col("n") == 1)
    top = F.when(long_only, top).otherwise(F.least(top, F.col("n") - 1))
    bottom = F.when(long_only, 0).otherwise(F.least(bottom, F.col("n") - top))
    w = F.when(F.col("r") > F.col("n") - top, div(F.lit(1.0), top)).when(F.col("r") <= bottom, -div(F.lit(1.0), bottom))
    return ranked.withColumn("weight", w).filter("weight is not null").select(*keys, "timestamp", "symbol", "weight", "target")


def sides(w: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, timestamp, longs, shorts, gross, net) of holdings; reading it fails where a symbol is held on both sides at a time."""
    symbols = lambda side: F.collect_set(F.when(side, F.col("symbol")))
    g = w.groupBy(*keys, "timestamp").agg(
        symbols(F.col("weight") > 0).alias("up"), symbols(F.col("weight") < 0).alias("down"), F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net")
    )
    apart = F.when(F.arrays_overlap("up", "down"), F.raise_error(F.lit("a symbol is held on both sides"))).otherwise(F.size("up"))
    return g.select(*keys, "timestamp", apart.alias("longs"), F.size("down").alias("shorts"), "gross", "net")


def apart(w: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """w; reading it fails where a symbol is held twice at a time, on one side or both."""
    twice = F.count(F.lit(1)).over(Window.partitionBy(*keys, "timestamp", "symbol")) > 1
    return w.withColumn("weight", F.when(twice, F.raise_error(F.concat(F.lit("a symbol is held more than once at one time: "), "symbol"))).otherwise(F.col("weight")))


def one(wide: DataFrame, factor: str, horizon: int, direction: int = 1) -> DataFrame:
    """(timestamp, symbol, value, direction, target) of one factor of a panel; an unknown factor or horizon is refused, and reading no rows at all fails."""
    for c in (factor, f"fwd_return_{horizon}"):
        if c not in wide.columns:
            raise ValueError(f"the panel has no column {c!r}")
    rows = wide.select("timestamp", "symbol", F.col(factor).alias("value"), F.lit(direction).alias("direction"), F.col(f"fwd_return_{horizon}").alias("target")).dropna(subset=["value", "target"])
    if rows.isEmpty():
        raise ValueError(f"the factor {factor!r} has no row with a forward return")
    return rows


def single(wide: DataFrame, factor: str, config: BacktestConfig) -> DataFrame:
    """The rows of one factor at the config's horizon and in its direction."""
    return one(wide, factor, config.horizon, config.direction)


def turnover(w: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, timestamp, symbol, turnover): |change of weight| of each holding, and of each exit at the time after its last holding.

    A symbol that is not held weighs 0, so this is the dense grid of times and
    symbols without its zeros: rows grow with holdings, not with the grid.
    """
    of = Window.partitionBy(*keys).orderBy("timestamp")
    times = w.select(*keys, "timestamp").distinct()
    times = times.select(*keys, "timestamp", F.row_number().over(of).alias("i"), F.lead("timestamp").over(of).alias("then"))
    own = Window.partitionBy(*keys, "symbol").orderBy("timestamp")
    held = w.select(*keys, "timestamp", "symbol", "weight").join(times, [*keys, "timestamp"])
    before = F.when(F.lag("i").over(own) == F.col("i") - 1, F.lag("weight").over(own)).otherwise(0.0)
    leaves = F.col("then").isNotNull() & F.coalesce(F.lead("i").over(own) > F.col("i") + 1, F.lit(True))
    moves = held.select(*keys, "symbol", F.array(F.struct("timestamp", F.abs(F.col("weight") - before).alias("turnover")), F.when(leaves, F.struct(F.col("then").alias("timestamp"), F.abs("weight").alias("turnover")))).alias("m"))
    return moves.select(*keys, "symbol", F.explode(F.array_compact("m")).alias("x")).select(*keys, "x.timestamp", "symbol", "x.turnover")


def latest_spreads(spreads: DataFrame, order: str | None = None) -> DataFrame:
    """(symbol, spread_bps): each symbol's last known spread by timestamp and, at one timestamp or without any, by the column `order`; without one the larger counts."""
    last = F.struct(*(c for c in ("timestamp",) if c in spreads.columns), order or "spread_bps", "spread_bps")
    return spreads.filter(F.col("symbol").isNotNull() & F.col("spread_bps").isNotNull()).groupBy("symbol").agg(F.max_by("spread_bps", last).alias("spread_bps"))


def execution_costs(moved: DataFrame, config: BacktestConfig, spreads: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, timestamp, turnover, execution_cost). spreads: (symbol, spread_bps), of which each symbol's latest counts."""
    bps: Column = F.lit(config.base_bps)
    if spreads is not None and config.spread_multiplier > 0:
        moved = moved.join(latest_spreads(spreads), "symbol", "left")
        bps = bps + F.greatest(F.coalesce("spread_bps", F.lit(0.0)), F.lit(0.0)) * config.spread_multiplier
    cost = F.col("turnover") * bps / F.lit(10_000.0)
    return moved.groupBy(*keys, "timestamp").agg(F.sum("turnover").alias("turnover"), F.sum(cost).alias("execution_cost"))


def as_of(left: DataFrame, right: DataFrame, value: str, keys: tuple[str, ...] = (), by: str = "symbol", order: str | None = None) -> DataFrame:
    """left with the last non-null `value` of right at or before each row's timestamp, per `by`.

    Both sides meet in ranges of (by, timestamp): right's rows stand first at equal
    timestamps, a running last-non-null carries them forward within a range, and
    each range is told the last value of its first `by` in earlier ones. So one
    symbol's history may be longer than a task holds. Of several of right's
    values at one time the last by the column `order` counts; without one, the largest.
    right is shared by all keys, so where left has keys its distinct times are looked up
    once and joined back. A null `by` has no value.
    """
    if keys:
        return left.join(as_of(left.select("timestamp", by).distinct(), right, value, (), by, order), ["timestamp", by])
    a = left.withColumn("__side", F.lit(1))
    b = right.filter(F.col(value).isNotNull() & F.col(by).isNotNull()).select("timestamp", by, F.col(value).alias("__v"), F.col(order or value).alias("__order")).withColumn("__side", F.lit(0))
    at = ("timestamp", "__side", "__order", "__v")
    both = ranges.dealt(a.unionByName(b, allowMissingColumns=True), (by,), at)
    place = F.struct(*at)
    pieces = both.groupBy(by, RANGE).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), place)).alias("__last"))
    carry = ranges.carried(pieces, (by,), __carry=F.last("__last", ignorenulls=True).over(ranges.earlier((by,))))
    here = F.last("__v", ignorenulls=True).over(ranges.own((by,), at))
    return ranges.met(both.withColumn("__here", here), carry, (by,)).withColumn(value, F.coalesce("__here", "__carry")).filter("__side = 1").drop("__v", "__side", "__order", "__here", "__carry", RANGE)


def funding_costs(w: DataFrame, rates: DataFrame, config: BacktestConfig, keys: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """(keys, timestamp, funding_cost): weight times the last known annualised rate, per bar; nothing where rates has no such column."""
    rate = config.funding_rate_column
    if rate not in rates.columns:
        return w.select(*keys, "timestamp").distinct().withColumn("funding_cost", F.lit(0.0))
    met = as_of(w.select(*keys, "timestamp", "symbol", "weight"), rates.withColumn(rate, number(rate)), rate, keys, order=order)
    cost = F.coalesce(F.col("weight") * F.col(rate) / F.lit(float(max(config.annualization, 1))) * F.lit(config.funding_multiplier), F.lit(0.0))
    return met.groupBy(*keys, "timestamp").agg(F.sum(cost).alias("funding_cost"))


def returns(rows: DataFrame, config: BacktestConfig, keys: tuple[str, ...] = (), spreads: DataFrame | None = None, rates: DataFrame | None = None) -> DataFrame:
    """(keys, timestamp, gross_return, turnover, execution_cost, funding_cost, total_cost, net_return, equity_curve, drawdown)."""
    w = apart(weights(rows, config, keys), keys).persist()
    on = [*keys, "timestamp"]
    gross = w.groupBy(*on).agg(F.coalesce(F.sum(F.col("weight") * F.col("target")), F.lit(0.0)).alias("gross_return"))
    out = gross.join(execution_costs(turnover(w, keys), config, spreads, keys), on, "full_outer")
    if rates is not None and config.funding_enabled:
        out = out.join(funding_costs(w, rates, config, keys), on, "full_outer")
    else:
        out = out.withColumn("funding_cost", F.lit(0.0))
    out = out.fillna(0.0, ["gross_return", "turnover", "execution_cost", "funding_cost"])
    out = out.withColumn("total_cost", F.col("execution_cost") + F.col("funding_cost")).withColumn("net_return", F.col("gross_return") - F.col("total_cost"))
    out = curve(out, keys)  # writes its ranges, so the holdings are done with
    w.unpersist()
    return out


def _scaled(rows: DataFrame, factor: Column, exponent: Column, over: WindowSpec) -> DataFrame:
    """rows with __m and __k: the running product of factor * 2^exponent is __m * 2^__k, and |__m| stays near 1, so nothing overflows."""
    s = F.sum(F.coalesce(finite(F.log2(F.abs(factor))), F.lit(0.0)) + exponent).over(over)
    rows = rows.withColumn("__k", F.round(s).cast("int"))
    step = F.col("__k") - F.coalesce(F.lag("__k").over(over), F.lit(0))
    return rows.withColumn("__m", F.product(factor * F.pow(F.lit(2.0), exponent - step)).over(over))


def curve(r: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """r with equity_curve, the running product of 1 + net_return, and drawdown, that against the curve's running maximum.

    A product beyond a double's range is no number, and neither is any after it; one that has come to 0 stays there.
    So ranges of (keys, timestamp) are told the product before them, which they multiply on row by row, and then how the
    first earlier range ended that left a double's range, and the largest value so far. The products told are
    made of scaled ones, as a range may pass that range by itself where the curve does not.
    """
    at = ("timestamp",)
    own, place = ranges.own(keys, at), Window.partitionBy(*keys, RANGE).orderBy(*at)
    d = ranges.dealt(r, keys, at)
    f = F.col("net_return") + 1.0
    pieces = _scaled(d, f, F.lit(0), place).groupBy(*keys, RANGE).agg(F.max_by("__m", "timestamp").alias("m"), F.max_by("__k", "timestamp").alias("k"))
    pieces = _scaled(pieces, F.col("m"), F.col("k"), Window.partitionBy(*keys).orderBy(RANGE))
    half = F.floor(F.col("__k") / 2)
    pieces = pieces.withColumn("all", F.col("__m") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), F.col("__k") - half))
    carry = ranges.carried(pieces, keys, __before=F.last("all").over(ranges.earlier(keys)))
    starts = (F.row_number().over(place) == 1) & F.col("__before").isNotNull()
    d = ranges.met(d, carry, keys).withColumn("__f", F.when(starts, F.col("__before") * F.coalesce(f, F.lit(1.0))).otherwise(f)).withColumn("__p", F.product("__f").over(own))
    ends = d.groupBy(*keys, RANGE).agg(F.max_by("__p", "timestamp").alias("end"), F.max(finite("__p")).alias("top"))
    # The first range to end at 0 or beyond all doubles; those after it have no curve of their own.
    left = F.first(F.when((F.col("end") == 0) | finite("end").isNull(), F.col("end")), ignorenulls=True).over(ranges.earlier(keys))
    ends = ends.withColumn("left", left).withColumn("top", F.when(F.col("left").isNull(), F.col("top")).otherwise(finite("left")))
    carry = ranges.carried(ends, keys, __left=F.col("left"), __top=F.max("top").over(ranges.earlier(keys)))
    d = ranges.met(d.drop("__before", "__f"), carry, keys).withColumn("equity_curve", finite(F.coalesce("__left", "__p")))
    peak = F.greatest("__top", F.max("equity_curve").over(own))
    return d.withColumn("drawdown", div("equity_curve", peak) - 1.0).drop("__p", "__left", "__top", RANGE)


def metrics(r: DataFrame, config: BacktestConfig, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key. Drawdown is against the running maximum of the curve, so a loss in the first bar doesn't count."""
    d = r if "drawdown" in r.columns else curve(r.drop("equity_curve"), keys)
    ann = float(config.annualization)
    g = d.groupBy(*keys).agg(
        (F.max_by("equity_curve", "timestamp") - 1.0).alias("total_return"), F.avg("net_return").alias("mean"), F.stddev_pop("net_return").alias("sd"), F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"), F.avg("turnover").alias("average_turnover"), F.avg("execution_cost").alias("average_execution_cost"),
        F.avg("funding_cost").alias("average_funding_cost"), F.count(F.lit(1)).alias("periods"),
    )
    root = ann**0.5
    return g.select(
        *keys, "total_return", F.when(F.col("total_return") > -1, F.pow(F.col("total_return") + 1.0, F.lit(ann) / F.col("periods")) - 1.0).alias("annualized_return"), (F.col("sd") * root).alias("annualized_volatility"),
        F.when(F.col("sd") > 0, div("mean", "sd") * root).alias("sharpe"), "max_drawdown", "win_rate", "average_turnover", "average_execution_cost", "average_funding_cost", "periods",
    )


def factor_rows(wide: DataFrame, factors: list[str], evaluation: DataFrame, horizon: int) -> DataFrame:
    """(factor, timestamp, symbol, value, direction, target) of each evaluated factor."""
    long = long_panel(wide.select("timestamp", "symbol", *factors, F.col(f"fwd_return_{horizon}").alias("target")).filter("target is not null"), factors)
    return long.join(F.broadcast(evaluation.filter(F.col("horizon") == horizon).select("factor", "direction")), "factor")


def sweep(wide: DataFrame, factors: list[str], evaluation: DataFrame, config: BacktestConfig, spreads: DataFrame | None = None, rates: DataFrame | None = None) -> DataFrame:
    """Metrics, after all costs, of every evaluated factor at the config's horizon, in one job; error says where a factor has no rows."""
    rows = factor_rows(wide, factors, evaluation, config.horizon)
    m = metrics(returns(rows, config, ("factor",), spreads, rates), config, ("factor",))
    head = evaluation.filter(F.col("horizon") == config.horizon).select("factor", "horizon", "direction", "score", "pooled_spearman", "quantile_spread", "observations")
    return head.join(m, "factor", "left").withColumn("error", F.when(F.col("periods").isNull(), F.lit("no rows")))
