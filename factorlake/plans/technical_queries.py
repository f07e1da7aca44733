"""Queries of market preparation, data quality and technical indicators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions.numerics import rounded
from factorlake.operators import prepare, quality, technicals
from factorlake.plans import sqltext as S
from factorlake.schemas import OHLCV
from factorlake.sources import bars

RULES = [
    {"symbol": "click", "field": "close", "operation": "multiply", "value": 1.1, "start": "2024-01-05", "end": "2024-01-10"},
    {"symbol": "view", "field": "volume", "operation": "add", "value": -2.0},
    {"symbol": "signup", "field": "open", "operation": "set", "value": 50.0, "start": "2024-01-20"},
]


def raw(spark: SparkSession, d: str) -> DataFrame:
    """Defective text bars: every seventh hour twice, some unparsable, inverted or empty fields."""
    b = bars.events_hourly(spark, d).withColumn("seq", F.lit(1))
    again = b.filter(F.hour("timestamp") % 7 == 0).withColumns({"close": F.col("close") + 1.0, "seq": F.lit(2)})
    u = b.unionByName(again)
    u = u.withColumns({"high": F.when(F.hour("timestamp") == 5, F.col("low") - 1.0).otherwise(F.col("high")), "volume": F.when(F.hour("timestamp") == 6, 0.0).otherwise(F.col("volume"))})
    text = {c: F.col(c).cast("string") for c in OHLCV}
    text["open"] = F.when(F.hour("timestamp") == 9, "n/a").otherwise(text["open"])
    text["low"] = F.when(F.hour("timestamp") == 10, "").when(F.hour("timestamp") == 11, "NaN").otherwise(text["low"])
    return u.withColumns(text)


RAW = f"""{S.EVENT_BARS},
raw AS (SELECT timestamp, symbol, CASE WHEN hour(timestamp) = 9 THEN NULL ELSE open END AS open, CASE WHEN hour(timestamp) = 5 THEN low - 1 ELSE high END AS high,
               CASE WHEN hour(timestamp) IN (10, 11) THEN NULL ELSE low END AS low, close, CASE WHEN hour(timestamp) = 6 THEN 0 ELSE volume END AS volume, asset_class, frequency, seq
        FROM (SELECT *, 1 AS seq FROM bars UNION ALL SELECT * REPLACE (close + 1 AS close), 2 AS seq FROM bars WHERE hour(timestamp) % 7 = 0))"""


def _normal(spark: SparkSession, d: str) -> DataFrame:
    return prepare.normalise(raw(spark, d), "seq").drop("seq")


def _adjusted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prepare.adjust(bars.events_hourly(spark, d), prepare.parse_adjustments(RULES)))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return quality.symbols(raw(spark, d))


def _indicators(*cols: str):
    return lambda s, d: rounded(technicals.panel(bars.events_hourly(s, d)).select("timestamp", "symbol", *cols), DIGITS)


DIGITS = 7
GROUPS = {
    "ti_sma_bb_donchian_vwap": ("sma_20", "sma_50", "bb_mid_20", "bb_upper_20", "bb_lower_20", "bb_percent_b_20", "donchian_high_20", "donchian_low_20", "donchian_position_20", "vwap_20"),
    "ti_obv": ("obv", "obv_slope_20"), "ti_mfi": ("mfi_14",), "ti_ema": ("ema_20", "ema_50", "ema_200"), "ti_macd": ("macd", "macd_signal", "macd_hist"), "ti_rsi": ("rsi_14",),
    "ti_atr": ("atr_14", "atr_percent_14"), "ti_supertrend": ("supertrend_10_3", "supertrend_direction_10_3"), "ti_adx": ("adx_14", "plus_di_14", "minus_di_14"), "ti_stoch_rsi": ("stoch_rsi_k_14", "stoch_rsi_d_14"),
}
STATE_ROUNDED = tuple(c for c in technicals.STATE_COLUMNS if c not in ("timestamp", "symbol"))


def queries() -> dict:
    q = {
        "normalize_dedupe_last": _normal,
        "adjust_multiply_add_set": _adjusted,
        "quality_symbols": lambda s, d: rounded(_symbols(s, d)),
        "quality_issues": lambda s, d: quality.issues(_symbols(s, d)),
        "quality_summary": lambda s, d: rounded(quality.summary(_symbols(s, d))),
        "indicator_states": lambda s, d: rounded(technicals.states(technicals.panel(bars.events_hourly(s, d))), 4),
    }
    return q | {k: _indicators(*cols) for k, cols in GROUPS.items()}


def smoother(y: str, x: str, alpha: float) -> str:
    """y after x: y starts at the first x that is there and keeps still where x is missing."""
    return f"CASE WHEN {x} IS NULL THEN r.{y} WHEN r.{y} IS NULL THEN {x} ELSE {alpha!r}::DOUBLE * {x} + (1.0::DOUBLE - {alpha!r}::DOUBLE) * r.{y} END"


def technical_sql() -> str:
    a = {"e20": 2 / 21, "e50": 2 / 51, "e200": 2 / 201, "e12": 2 / 13, "e26": 2 / 27}
    ema = ", ".join(f"{smoother(k, 'b.close', v)} AS {k}" for k, v in a.items())
    w14 = 1 / 14
    w = S.W
    roll = S.roll
    return f"""WITH RECURSIVE {S.EVENT_BARS},
b AS (SELECT *, row_number() OVER ({w}) AS i, lag(close) OVER ({w}) AS pc, greatest(high - low, abs(high - lag(close) OVER ({w})), abs(low - lag(close) OVER ({w}))) AS tr,
        CASE WHEN high - lag(high) OVER ({w}) > lag(low) OVER ({w}) - low AND high - lag(high) OVER ({w}) > 0 THEN high - lag(high) OVER ({w}) ELSE 0.0::DOUBLE END AS pdm,
        CASE WHEN lag(low) OVER ({w}) - low > high - lag(high) OVER ({w}) AND lag(low) OVER ({w}) - low > 0 THEN lag(low) OVER ({w}) - low ELSE 0.0::DOUBLE END AS mdm,
        greatest(close - lag(close) OVER ({w}), 0.0::DOUBLE) AS gain, greatest(lag(close) OVER ({w}) - close, 0.0::DOUBLE) AS loss FROM bars),
bb AS (SELECT * REPLACE (CASE WHEN i > 1 THEN gain END AS gain, CASE WHEN i > 1 THEN loss END AS loss) FROM b),
z AS (SELECT DISTINCT symbol, 0::BIGINT AS i, NULL::DOUBLE AS e20, NULL::DOUBLE AS e50, NULL::DOUBLE AS e200, NULL::DOUBLE AS e12, NULL::DOUBLE AS e26, NULL::DOUBLE AS g, NULL::DOUBLE AS l, NULL::DOUBLE AS a14, NULL::DOUBLE AS a10,
        NULL::DOUBLE AS p, NULL::DOUBLE AS m, NULL::DOUBLE AS sig, 0::BIGINT AS sign_, NULL::DOUBLE AS dxs, 0::BIGINT AS dxn, NULL::DOUBLE AS up, NULL::DOUBLE AS lo, 0::INT AS dir, NULL::DOUBLE AS pdi, NULL::DOUBLE AS mdi FROM bars),
rec AS (SELECT * FROM z UNION ALL
  SELECT symbol, i, e20, e50, e200, e12, e26, g, l, a14, a10, p, m,
    CASE WHEN mac IS NULL THEN osig WHEN osig IS NULL THEN mac ELSE 0.2::DOUBLE * mac + (1.0::DOUBLE - 0.2::DOUBLE) * osig END, osign + (mac IS NOT NULL)::INT,
    CASE WHEN dx IS NULL THEN odxs WHEN odxs IS NULL THEN dx ELSE {w14!r}::DOUBLE * dx + (1.0::DOUBLE - {w14!r}::DOUBLE) * odxs END, odxn + (dx IS NOT NULL)::INT, nup, nlo,
    (CASE WHEN nup IS NULL THEN 0 WHEN odir = 0 THEN CASE WHEN close >= nlo THEN 1 ELSE -1 END WHEN odir < 0 AND close > nup THEN 1 WHEN odir > 0 AND close < nlo THEN -1 ELSE odir END)::INT, pdi, mdi
  FROM (SELECT *, 100.0::DOUBLE * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx,
          CASE WHEN bu IS NULL THEN NULL WHEN oup IS NULL OR bu < oup OR pc > oup THEN bu ELSE oup END AS nup, CASE WHEN bl IS NULL THEN NULL WHEN olo IS NULL OR bl > olo OR pc < olo THEN bl ELSE olo END AS nlo
    FROM (SELECT *, CASE WHEN i >= 26 THEN e12 - e26 END AS mac, CASE WHEN i >= 14 THEN 100.0::DOUBLE * p / nullif(a14, 0) END AS pdi, CASE WHEN i >= 14 THEN 100.0::DOUBLE * m / nullif(a14, 0) END AS mdi,
            CASE WHEN i >= 10 THEN (high + low) / 2.0::DOUBLE + 3.0::DOUBLE * a10 END AS bu, CASE WHEN i >= 10 THEN (high + low) / 2.0::DOUBLE - 3.0::DOUBLE * a10 END AS bl
      FROM (SELECT b.symbol, b.i, b.high, b.low, b.close, b.pc, {ema}, {smoother('g', 'b.gain', w14)} AS g, {smoother('l', 'b.loss', w14)} AS l, {smoother('a14', 'b.tr', w14)} AS a14, {smoother('a10', 'b.tr', 0.1)} AS a10,
              {smoother('p', 'b.pdm', w14)} AS p, {smoother('m', 'b.mdm', w14)} AS m, r.sig AS osig, r.sign_ AS osign, r.dxs AS odxs, r.dxn AS odxn, r.up AS oup, r.lo AS olo, r.dir AS odir
            FROM rec r JOIN bb b ON b.symbol = r.symbol AND b.i = r.i + 1)))),
sm AS (SELECT bb.*, CASE WHEN bb.i >= 10 THEN e20 END AS ema_20, CASE WHEN bb.i >= 25 THEN e50 END AS ema_50, CASE WHEN bb.i >= 100 THEN e200 END AS ema_200,
    CASE WHEN bb.i >= 15 THEN 100.0::DOUBLE - 100.0::DOUBLE / (1.0::DOUBLE + g / nullif(l, 0)) END AS rsi_14, CASE WHEN bb.i >= 26 THEN e12 - e26 END AS macd, CASE WHEN sign_ >= 9 THEN sig END AS macd_signal,
    CASE WHEN bb.i >= 14 THEN a14 END AS atr_14, CASE WHEN dir > 0 THEN lo WHEN dir < 0 THEN up END AS supertrend_10_3, dir AS supertrend_direction_10_3, CASE WHEN dxn >= 14 THEN dxs END AS adx_14, pdi AS plus_di_14, mdi AS minus_di_14,
    (high + low + close) / 3.0::DOUBLE AS tp FROM bb JOIN rec USING (symbol, i)),
s1 AS (SELECT *, tp * volume AS flow, tp - lag(tp) OVER ({w}) AS tpc, coalesce(sign(close - pc) * volume, 0.0::DOUBLE) AS signed,
    {roll('avg', 'close', 20, 10)} AS sma_20, {roll('avg', 'close', 50, 20)} AS sma_50, {roll('stddev_pop', 'close', 20, 10)} AS sd, {roll('max', 'high', 20, 10)} AS donchian_high_20, {roll('min', 'low', 20, 10)} AS donchian_low_20,
    (rsi_14 - ({roll('min', 'rsi_14', 14, 14)})) / nullif(({roll('max', 'rsi_14', 14, 14)}) - ({roll('min', 'rsi_14', 14, 14)}), 0) AS sr FROM sm),
s2 AS (SELECT *, CASE WHEN tpc > 0 THEN flow ELSE 0.0::DOUBLE END AS uf, CASE WHEN tpc < 0 THEN flow ELSE 0.0::DOUBLE END AS df, sum(signed) OVER ({w} ROWS UNBOUNDED PRECEDING) AS obv, {roll('avg', 'sr', 3, 1)} AS stoch_rsi_k_14 FROM s1),
ti AS (SELECT *, macd - macd_signal AS macd_hist, sma_20 AS bb_mid_20, sma_20 + 2.0::DOUBLE * sd AS bb_upper_20, sma_20 - 2.0::DOUBLE * sd AS bb_lower_20,
    (close - (sma_20 - 2.0::DOUBLE * sd)) / nullif((sma_20 + 2.0::DOUBLE * sd) - (sma_20 - 2.0::DOUBLE * sd), 0) AS bb_percent_b_20, atr_14 / nullif(close, 0) AS atr_percent_14,
    ({roll('sum', 'flow', 20, 5)}) / nullif({roll('sum', 'volume', 20, 5)}, 0) AS vwap_20, obv - lag(obv, 20) OVER ({w}) AS obv_slope_20,
    100.0::DOUBLE - 100.0::DOUBLE / (1.0::DOUBLE + ({roll('sum', 'uf', 14, 14)}) / nullif({roll('sum', 'df', 14, 14)}, 0)) AS mfi_14, {roll('avg', 'stoch_rsi_k_14', 3, 1)} AS stoch_rsi_d_14,
    (close - donchian_low_20) / nullif(donchian_high_20 - donchian_low_20, 0) AS donchian_position_20 FROM s2)"""


def _states_sql() -> str:
    up, down = "ema_alignment IN ('BULL_STACK', 'BULL_SETUP')", "ema_alignment IN ('BEAR_STACK', 'BEAR_SETUP')"
    label = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in technicals.BIAS_LABELS.items())
    sign = lambda x, v: f"CASE WHEN {x} > 0 THEN {v}::DOUBLE WHEN {x} < 0 THEN -{v}::DOUBLE ELSE 0.0::DOUBLE END"
    cols = " ".join(("~" if c in {"last_close", "technical_score", "confidence", "rsi_14", "macd_hist", "bb_percent_b_20", "atr_percent_14", "vwap_20", "obv_slope_20", "adx_14", "mfi_14", "stoch_rsi_k_14", "donchian_position_20", "support_level", "resistance_level"} else "") + c for c in technicals.STATE_COLUMNS)
    fixed = ", ".join(f"'{v}' AS {k}" for k, v in technicals.TRIGGERS.items())
    return f"""{technical_sql()},
la AS (SELECT * FROM ti QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1),
al AS (SELECT *, CASE WHEN ema_20 IS NULL OR ema_50 IS NULL THEN 'UNKNOWN' WHEN close > ema_20 AND ema_20 > ema_50 AND ema_50 > ema_200 THEN 'BULL_STACK' WHEN close < ema_20 AND ema_20 < ema_50 AND ema_50 < ema_200 THEN 'BEAR_STACK'
   WHEN close > ema_20 AND ema_20 > ema_50 THEN 'BULL_SETUP' WHEN close < ema_20 AND ema_20 < ema_50 THEN 'BEAR_SETUP' ELSE 'MIXED' END AS ema_alignment FROM la),
po AS (SELECT *, (CASE WHEN adx_14 >= 25 THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END) * (CASE ema_alignment WHEN 'BULL_STACK' THEN 2.0 WHEN 'BULL_SETUP' THEN 1.0 WHEN 'BEAR_STACK' THEN -2.0 WHEN 'BEAR_SETUP' THEN -1.0 ELSE 0.0 END::DOUBLE
   + {sign('supertrend_direction_10_3', '1.0')} + {sign('close - vwap_20', '0.75')} + {sign('macd - macd_signal', '0.75')}
   + CASE WHEN rsi_14 >= 52 AND rsi_14 <= 68 THEN 0.5 WHEN rsi_14 >= 32 AND rsi_14 <= 48 THEN -0.5 WHEN rsi_14 >= 78 THEN -0.35 WHEN rsi_14 <= 22 THEN 0.35 ELSE 0.0 END::DOUBLE
   + CASE WHEN donchian_position_20 >= 0.8 THEN 0.5 WHEN donchian_position_20 <= 0.2 THEN -0.5 ELSE 0.0 END::DOUBLE + {sign('obv_slope_20', '0.35')}) AS points FROM al),
st AS (SELECT *, close AS last_close, points AS technical_score, supertrend_direction_10_3 AS supertrend_direction,
   CASE WHEN points >= 3 THEN 'LEAN_LONG' WHEN points >= 1.5 THEN 'WATCH_LONG' WHEN points <= -3 THEN 'LEAN_SHORT' WHEN points <= -1.5 THEN 'WATCH_SHORT' ELSE 'NEUTRAL' END AS technical_bias,
   greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN atr_percent_14 > 0.12 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END) * (least(abs(points) / 5.25::DOUBLE, 1.0::DOUBLE) + coalesce(greatest(0.0::DOUBLE, least(0.2::DOUBLE, (adx_14 - 15.0::DOUBLE) / 40.0::DOUBLE)), 0.0::DOUBLE)))) AS confidence,
   coalesce(close >= vwap_20, false) AS above_vwap,
   CASE WHEN {up} AND supertrend_direction_10_3 >= 0 THEN 'UP_' || CASE WHEN adx_14 >= 25 THEN 'STRONG' ELSE 'WEAK' END WHEN {down} AND supertrend_direction_10_3 <= 0 THEN 'DOWN_' || CASE WHEN adx_14 >= 25 THEN 'STRONG' ELSE 'WEAK' END ELSE 'MIXED' END AS trend_state,
   CASE WHEN rsi_14 >= 72 THEN 'OVERBOUGHT' WHEN rsi_14 <= 28 THEN 'OVERSOLD' WHEN macd_hist > 0 AND coalesce(stoch_rsi_k_14 >= 0.5, true) THEN 'RISING' WHEN macd_hist < 0 AND coalesce(stoch_rsi_k_14 <= 0.5, true) THEN 'FALLING' ELSE 'NEUTRAL' END AS momentum_state,
   CASE WHEN atr_percent_14 >= 0.08 THEN 'HIGH' WHEN bb_percent_b_20 >= 1 OR bb_percent_b_20 <= 0 THEN 'BREAKOUT' ELSE 'NORMAL' END AS volatility_state,
   CASE WHEN obv_slope_20 > 0 AND coalesce(mfi_14 >= 50, true) THEN 'CONFIRMING' WHEN obv_slope_20 < 0 AND coalesce(mfi_14 <= 50, true) THEN 'DIVERGING' ELSE 'NEUTRAL' END AS volume_state,
   coalesce(supertrend_10_3, vwap_20, ema_20, donchian_low_20) AS support_level, coalesce(donchian_high_20, bb_upper_20, ema_20) AS resistance_level, {fixed} FROM po),
sv AS (SELECT *, CASE technical_bias {label} END AS technical_bias_label, 'averages ' || ema_alignment || '; trend ' || trend_state || '; momentum ' || momentum_state || CASE WHEN above_vwap THEN '; at or above VWAP' ELSE '; below VWAP' END AS interpretation FROM st)
SELECT {S.rnd(cols, 4)} FROM sv"""


QUALITY = f"""WITH {RAW},
kn AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp, open NULLS FIRST, high NULLS FIRST, low NULLS FIRST, close NULLS FIRST, volume NULLS FIRST ROWS UNBOUNDED PRECEDING) AS known FROM raw),
mv AS (SELECT *, abs(known / nullif(lag(known) OVER (PARTITION BY symbol ORDER BY timestamp, open NULLS FIRST, high NULLS FIRST, low NULLS FIRST, close NULLS FIRST, volume NULLS FIRST), 0) - 1) AS move FROM kn),
ba AS (SELECT symbol, count(*)::BIGINT AS rows, min(timestamp) AS start, max(timestamp) AS "end", (count(*) - count(DISTINCT timestamp))::BIGINT AS duplicate_timestamps,
   count_if(open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL)::BIGINT AS missing_values,
   count_if(open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR high < greatest(open, close) OR low > least(open, close) OR low > high)::BIGINT AS invalid_prices,
   count_if(volume <= 0)::BIGINT AS zero_or_negative_volume, count_if(move > 0.6)::BIGINT AS extreme_returns FROM mv GROUP BY symbol),
sp AS (SELECT symbol, epoch(timestamp) - lag(epoch(timestamp)) OVER (PARTITION BY symbol ORDER BY timestamp) AS step FROM (SELECT DISTINCT symbol, timestamp FROM raw)),
gp AS (SELECT symbol, count_if(step > 6480)::BIGINT AS large_time_gaps, sum(CASE WHEN step > 6480 THEN greatest(0, round_even(step / 3600.0::DOUBLE, 0) - 1) ELSE 0 END)::BIGINT AS estimated_missing_bars FROM sp GROUP BY symbol),
qu AS (SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - (duplicate_timestamps * 1.0::DOUBLE + missing_values * 1.0::DOUBLE + invalid_prices * 1.5::DOUBLE + zero_or_negative_volume * 0.6::DOUBLE + extreme_returns * 0.8::DOUBLE + estimated_missing_bars * 0.5::DOUBLE) / rows) AS quality_score FROM ba LEFT JOIN gp USING (symbol)),
qq AS (SELECT *, CASE WHEN quality_score >= 0.98 THEN 'PASS' WHEN quality_score >= 0.9 THEN 'WARN' ELSE 'FAIL' END AS status FROM qu)"""


def oracle_sql() -> dict[str, str]:
    o = {}
    bars_cols = "timestamp, symbol, open, high, low, close, volume, asset_class, frequency"
    o["normalize_dedupe_last"] = f"WITH {RAW} SELECT {bars_cols} FROM raw WHERE open IS NOT NULL AND low IS NOT NULL QUALIFY row_number() OVER (PARTITION BY timestamp, symbol ORDER BY seq DESC) = 1"
    o["adjust_multiply_add_set"] = f"""WITH {S.EVENT_BARS},
a AS (SELECT * REPLACE (CASE WHEN symbol = 'click' AND timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10' THEN close * 1.1::DOUBLE ELSE close END AS close,
  CASE WHEN symbol = 'view' THEN volume - 2.0::DOUBLE ELSE volume END AS volume, CASE WHEN symbol = 'signup' AND timestamp >= TIMESTAMP '2024-01-20' THEN 50.0::DOUBLE ELSE open END AS open) FROM bars),
c AS (SELECT * REPLACE (greatest(volume, 0) AS volume, greatest(open, 0.01::DOUBLE) AS open, greatest(high, 0.01::DOUBLE) AS high, greatest(low, 0.01::DOUBLE) AS low, greatest(close, 0.01::DOUBLE) AS close) FROM a),
e AS (SELECT * REPLACE (greatest(high, open, close) AS high, least(low, open, close) AS low) FROM c)
SELECT {S.rnd('timestamp symbol ~open ~high ~low ~close ~volume asset_class frequency')} FROM e"""
    counts = "duplicate_timestamps missing_values invalid_prices zero_or_negative_volume extreme_returns large_time_gaps estimated_missing_bars"
    o["quality_symbols"] = f"{QUALITY} SELECT {S.rnd('symbol rows start \"end\" ' + counts + ' ~quality_score status')} FROM qq"
    o["quality_issues"] = f"{QUALITY} SELECT symbol, issue, CASE WHEN issue IN ('duplicate_timestamps', 'missing_values', 'invalid_prices') THEN 'high' ELSE 'medium' END AS severity, count FROM (UNPIVOT (SELECT symbol, {', '.join(counts.split())} FROM qq) ON {', '.join(counts.split())} INTO NAME issue VALUE count) WHERE count > 0"
    total = " + ".join(c for c in counts.split() if c != "large_time_gaps")
    o["quality_summary"] = f"{QUALITY} SELECT count(*)::BIGINT AS symbol_count, sum(rows)::BIGINT AS row_count, sum({total})::BIGINT AS issue_count, arg_min(symbol, quality_score) AS worst_symbol, round(min(quality_score), 6) + 0.0::DOUBLE AS worst_score, CASE WHEN count_if(status = 'FAIL') > 0 THEN 'FAIL' WHEN count_if(status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM qq"
    t = technical_sql()
    for k, cols in GROUPS.items():
        names = " ".join(("" if c == "supertrend_direction_10_3" else "~") + c for c in cols)
        o[k] = f"{t} SELECT {S.rnd('timestamp symbol ' + names, DIGITS)} FROM ti"
    o["indicator_states"] = _states_sql()
    return o
