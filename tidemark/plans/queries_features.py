"""Queries on features and market structure, each with its twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators.windows import PLACE
from tidemark.plans import features, store, strategy, structure, table
from tidemark.plans import sql as q
from tidemark.plans.queries_bars import rounded
from tidemark.sources import tape as src
from tidemark.sources.datasets import kept
from tidemark.sources.manifest import staged

QUERIES, ORACLE = {}, {}


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


KEY = ["symbol", "ts_utc"]


def m5(spark, d, ratio_too=False):
    """Bars of five minutes with their ATR, kept."""
    return kept(spark, d, f"m5-{ratio_too}", lambda: features.with_atr(src.bars(spark, d, 5), ratio_too))


def _priced_bars(spark, d):
    return m5(spark, d).select(*KEY, "high", "low", "close", "atr", PLACE)


def pick(df, plain, doubles, places=6):
    return rounded(df.select(*KEY, *plain, *doubles), places)


# the twin of m5(): bars with atr, a (the denominator), event_time, available_at
VA = f"{q.M5},\n" + q.atr(long=20, least=10)
LAG, POS = q.lag, q.pos

_ANATOMY = f"""{VA}, an AS (SELECT *, CAST(sign(close - open) AS INTEGER) AS dir, (high - low) / 0.01 AS range_pts, abs(close - open) / {POS('high - low')} AS body_frac,
  (high - greatest(open, close)) / {POS('high - low')} AS upper_wick_frac, (least(open, close) - low) / {POS('high - low')} AS lower_wick_frac, (close - low) / {POS('high - low')} AS close_loc,
  (high - low) / a AS range_atr, (close - open) / a AS body_atr, (high - greatest(open, close)) / a AS upper_wick_atr, (least(open, close) - low) / a AS lower_wick_atr,
  (open - {LAG('close')}) / a AS gap_atr, (close - {LAG('close')}) / a AS ret_atr, tick_volume / {POS(q.full('median', 'tick_volume', 288, least=48))} AS volume_rel FROM v)"""
_AN = ["range_pts", "body_frac", "upper_wick_frac", "lower_wick_frac", "close_loc", "range_atr", "body_atr", "upper_wick_atr", "lower_wick_atr", "gap_atr", "ret_atr", "volume_rel"]
register("feat_anatomy", q.query(_ANATOMY, "an", [*KEY, "dir", "tick_volume"], _AN))(lambda spark, d: pick(features.anatomy(m5(spark, d)), ["dir", "tick_volume"], _AN))

_CODE = lambda x: f"CASE WHEN {x} > 0 THEN 'U' WHEN {x} < 0 THEN 'D' WHEN {x} = 0 THEN '-' END"


def _run(source: str, value: str, name: str, into: str) -> str:
    return f"""{name}0 AS (SELECT *, CASE WHEN lag(1) OVER {q.W} IS NULL OR {value} IS DISTINCT FROM lag({value}) OVER {q.W} THEN 1 ELSE 0 END AS {name}_new FROM {source}),
{name}1 AS (SELECT *, sum({name}_new) OVER (PARTITION BY symbol ORDER BY ts_utc ROWS UNBOUNDED PRECEDING) AS {name}_id FROM {name}0),
{name} AS (SELECT *, row_number() OVER (PARTITION BY symbol, {name}_id ORDER BY ts_utc) AS {into} FROM {name}1)"""


_SEQUENCE = f"""{_ANATOMY}, {_run('an', 'dir', 'rd', 'run_dir')},
s0 AS (SELECT *, {LAG('dir')} AS dir_lag1, {LAG('dir', 2)} AS dir_lag2, {LAG('body_atr')} AS body_atr_lag1, {LAG('close_loc')} AS close_loc_lag1, {LAG('range_atr')} AS range_atr_lag1, CAST(run_dir * dir AS INTEGER) AS streak,
  CAST({q.full('sum', 'CAST(dir = 1 AS INTEGER)', 5)} AS INTEGER) AS up_count_5, CAST({q.full('sum', 'CAST(dir = 1 AS INTEGER)', 10)} AS INTEGER) AS up_count_10,
  {', '.join(f"(close - {LAG('close', n)}) / a AS ret{n}_atr" for n in (3, 5, 10, 20))},
  high <= {LAG('high')} AND low >= {LAG('low')} AS inside_bar, high > {LAG('high')} AND low < {LAG('low')} AS outside_bar, high > {LAG('high')} AS higher_high, low < {LAG('low')} AS lower_low,
  low > {LAG('low')} AS higher_low, high < {LAG('high')} AS lower_high, ({q.full('avg', 'high - low', 5)}) / {POS(q.full('avg', 'high - low', 20))} AS compression,
  {q.full('max', 'high', 20)} AS top, {q.full('min', 'low', 20)} AS bottom, coalesce(date_diff('minute', {LAG('ts_utc')}, ts_utc) - 5, 0) AS gap FROM rd),
{_run('s0', 'inside_bar', 'ri', 'run_inside')},
s1 AS (SELECT *, {_CODE('dir_lag2')} || {_CODE('dir_lag1')} || {_CODE('dir')} AS dirs_3, CAST(CASE WHEN inside_bar THEN run_inside ELSE 0 END AS INTEGER) AS inside_streak, (top - close) / a AS dist_high20_atr, (close - bottom) / a AS dist_low20_atr,
  (close - bottom) / {POS('top - bottom')} AS pos_in_range20, sum(CAST(gap > 1440 AS INTEGER)) OVER (PARTITION BY symbol ORDER BY ts_utc ROWS UNBOUNDED PRECEDING) AS week_id FROM ri),
sq AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, week_id ORDER BY ts_utc) - 1 AS INTEGER) AS bars_since_week_open, CAST(gap AS INTEGER) AS gap_before_min FROM s1)"""
_SQP = ["dir_lag1", "dir_lag2", "dirs_3", "streak", "up_count_5", "up_count_10", "inside_bar", "outside_bar", "inside_streak", "higher_high", "lower_low", "higher_low", "lower_high", "bars_since_week_open", "gap_before_min"]
_SQD = ["body_atr_lag1", "close_loc_lag1", "range_atr_lag1", "ret3_atr", "ret5_atr", "ret10_atr", "ret20_atr", "compression", "dist_high20_atr", "dist_low20_atr", "pos_in_range20"]
register("feat_sequence", q.query(_SEQUENCE, "sq", [*KEY, *_SQP], _SQD))(lambda spark, d: pick(features.sequence(features.anatomy(m5(spark, d))), _SQP, _SQD))

_VOL = f"""{q.M5}, {q.atr(long=576, least=144)}, periods AS (SELECT DISTINCT symbol AS ps, date_trunc('week', ts_utc) AS period FROM v),
seen AS (SELECT ps, period, vol_ratio FROM periods JOIN v ON ps = symbol AND CAST(ts_utc AS DATE) < period AND CAST(ts_utc AS DATE) >= period - INTERVAL 21 DAY WHERE vol_ratio IS NOT NULL),
edges AS (SELECT ps, period, list_sort(list(vol_ratio))[CAST(round_even((1.0::DOUBLE / 3) * (count(*) - 1), 0) AS BIGINT) + 1] AS lo, list_sort(list(vol_ratio))[CAST(round_even((2.0::DOUBLE / 3) * (count(*) - 1), 0) AS BIGINT) + 1] AS hi FROM seen GROUP BY ALL HAVING count(*) >= 500),
vl AS (SELECT *, CASE WHEN close > 0 AND {LAG('close')} > 0 THEN ln(close / nullif({LAG('close')}, 0)) END AS lg FROM v),
vr AS (SELECT vl.*, ({q.full('stddev_samp', 'lg', 20)}) * 1e4 AS rv20_bps, CASE WHEN vol_ratio IS NULL OR lo IS NULL THEN NULL WHEN vol_ratio < lo THEN 'low' WHEN vol_ratio < hi THEN 'mid' ELSE 'high' END AS vol_regime FROM vl LEFT JOIN edges ON ps = symbol AND period = date_trunc('week', ts_utc))"""
register("feat_volatility", q.query(_VOL, "vr", [*KEY, "vol_regime"], ["rv20_bps"], places=4))(lambda spark, d: pick(features.volatility(features.with_atr(src.bars(spark, d, 5), long=576, least=144), 21, 500, "week"), ["vol_regime"], ["rv20_bps"], 4))

_ZM = {k: q.minute(q.zone(z)) for k, z in (("tokyo", "Asia/Tokyo"), ("london", "Europe/London"), ("ny", "America/New_York"))}
_MOD = lambda x: f"CAST((({x}) % 1440 + 1440) % 1440 AS INTEGER)"
_SESSION = f"""{q.M5}, z AS (SELECT *, {', '.join(f'{m} AS m_{k}' for k, m in _ZM.items())} FROM m5),
i AS (SELECT *, m_tokyo >= 540 AND m_tokyo < 1080 AS in_tokyo, m_london >= 480 AND m_london < 1020 AS in_london, m_ny >= 480 AND m_ny < 1020 AS in_new_york FROM z),
se AS (SELECT symbol, ts_utc, in_tokyo, in_london, in_new_york, CASE WHEN in_london AND in_new_york THEN 'overlap' WHEN in_london THEN 'london' WHEN in_new_york THEN 'new_york' WHEN in_tokyo THEN 'asian' ELSE 'off' END AS session,
  {_MOD('m_tokyo - 540')} AS min_since_tokyo_open, {_MOD('m_london - 480')} AS min_since_london_open, {_MOD('m_ny - 480')} AS min_since_ny_open, {_MOD('1020 - m_ny')} AS min_to_rollover,
  CAST(date_part('hour', ts_utc) AS INTEGER) AS hour_utc, CAST(isodow(ts_utc) AS INTEGER) AS dow FROM i)"""
_SE = ["session", "in_tokyo", "in_london", "in_new_york", "min_since_tokyo_open", "min_since_london_open", "min_since_ny_open", "min_to_rollover", "hour_utc", "dow"]
register("feat_session", f"WITH {_SESSION} SELECT * FROM se")(lambda spark, d: features.session(src.bars(spark, d, 5)).select(*KEY, *_SE))

_DW = "(PARTITION BY symbol, trading_day ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DB = "(PARTITION BY symbol, trading_day ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_DAILY = f"""{VA}, td AS (SELECT *, CAST({q.NY} + INTERVAL 7 HOUR AS DATE) AS trading_day FROM v),
dd AS (SELECT symbol AS ds, trading_day AS dt, max(high) AS dh, min(low) AS dl, arg_max(close, ts_utc) AS dc, count(*) AS db FROM td GROUP BY ALL),
pd AS (SELECT ds, dt, lag(dh) OVER (PARTITION BY ds ORDER BY dt) AS pdh, lag(dl) OVER (PARTITION BY ds ORDER BY dt) AS pdl, lag(dc) OVER (PARTITION BY ds ORDER BY dt) AS pdc, lag(db) OVER (PARTITION BY ds ORDER BY dt) AS pdb FROM dd),
d0 AS (SELECT *, max(high) OVER {_DW} AS hi_day, min(low) OVER {_DW} AS lo_day, first_value(open) OVER {_DW} AS open_day, coalesce(high > pdh AND close < pdh, false) AS pdh_sweep, coalesce(low < pdl AND close > pdl, false) AS pdl_sweep,
  coalesce(bool_or(coalesce(close > pdh, false)) OVER {_DB}, false) AS pdh_accepted_before, coalesce(bool_or(coalesce(close < pdl, false)) OVER {_DB}, false) AS pdl_accepted_before FROM td LEFT JOIN pd ON ds = symbol AND dt = trading_day),
da AS (SELECT *, (close - open_day) / a AS dist_day_open_atr, (hi_day - lo_day) / a AS day_range_atr, (close - lo_day) / {POS('hi_day - lo_day')} AS pos_in_day_range, (close - pdh) / a AS dist_prev_high_atr, (close - pdl) / a AS dist_prev_low_atr, (close - pdc) / a AS dist_prev_close_atr,
  CASE WHEN pdh_sweep THEN (high - pdh) / a END AS pdh_sweep_depth_atr, CASE WHEN pdl_sweep THEN (pdl - low) / a END AS pdl_sweep_depth_atr,
  CAST(sum(CAST(pdh_sweep AS INTEGER)) OVER {_DW} AS INTEGER) AS pdh_sweeps_today, CAST(sum(CAST(pdl_sweep AS INTEGER)) OVER {_DW} AS INTEGER) AS pdl_sweeps_today FROM d0)"""
_DAP = ["trading_day", "pdh_sweep", "pdl_sweep", "pdh_sweeps_today", "pdl_sweeps_today", "pdh_accepted_before", "pdl_accepted_before"]
_DAD = ["dist_day_open_atr", "day_range_atr", "pos_in_day_range", "dist_prev_high_atr", "dist_prev_low_atr", "dist_prev_close_atr", "pdh_sweep_depth_atr", "pdl_sweep_depth_atr"]
register("feat_daily_sweeps", q.query(_DAILY, "da", [*KEY, *_DAP], _DAD))(lambda spark, d: pick(features.daily(m5(spark, d)), _DAP, _DAD))


def _sweep_sql(level: str, side: int) -> str:
    return f"SELECT symbol, available_at AS decision_time, event_time, {side} AS side, {level} AS level, {level}_sweep_depth_atr AS depth_atr, trading_day FROM da WHERE {level}_sweep AND atr_pts > 0 AND pdb >= 60 AND {level}_sweep_depth_atr <= 1.5 AND NOT {level}_accepted_before AND {level}_sweeps_today = 1"


@register("prev_day_sweep", q.query(f"{_DAILY}, ev AS ({_sweep_sql('pdh', -1)} UNION ALL {_sweep_sql('pdl', 1)})", "ev", ["symbol", "decision_time", "event_time", "side", "level", "trading_day"], ["depth_atr"]))
def prev_day_sweep(spark, d):
    """Both detectors: sweeps of the previous day's high and low."""
    from tidemark.plans.research import previous_day_sweeps

    b = features.session(features.daily(m5(spark, d)))
    out = previous_day_sweeps(b, "pdh", least_bars=60).unionByName(previous_day_sweeps(b, "pdl", least_bars=60))
    return rounded(out.select("symbol", "decision_time", "event_time", "side", "level", "trading_day", "depth_atr"))


def _htf(minutes: int, p: str) -> tuple[str, list[str], list[str]]:
    b = f"h{minutes}"
    L = lambda x, n=1: f"lag({x}, {n}) OVER {q.W}"
    ctes = f"""{VA}, {q.bars(minutes, b)}, {b}t AS (SELECT *, CAST(sign(close - open) AS INTEGER) AS dr, greatest(high - low, abs(high - {L('close')}), abs(low - {L('close')})) AS tr FROM {b}),
{b}a AS (SELECT *, {q.full('avg', 'tr', 14)} AS har, {q.full('avg', 'close', 20)} AS sma FROM {b}t), {_run(b + 'a', 'dr', b + 'r', 'rl')},
{b}f AS (SELECT symbol AS hs, ts_utc + INTERVAL '{minutes} minutes' AS {p}_close_utc, dr AS {p}_dir, (close - open) / {POS('har')} AS {p}_body_atr, (close - low) / {POS('high - low')} AS {p}_close_loc, (high - low) / {POS('har')} AS {p}_range_atr, (close - {L('close', 4)}) / {POS('har')} AS {p}_ret4_atr,
  (close - sma) / {POS('har')} AS {p}_trend_atr, (sma - {L('sma', 5)}) / {POS('har')} AS {p}_slope_atr, CAST(rl * dr AS INTEGER) AS {p}_streak, har / 0.01 AS {p}_atr_pts, low AS hl, high AS hh FROM {b}r),
hx AS (SELECT v.*, f.*, (close - hl) / {POS('hh - hl')} AS pos_in_{p}_prev FROM v ASOF LEFT JOIN {b}f f ON v.symbol = f.hs AND v.available_at >= f.{p}_close_utc)"""
    return ctes, [f"{p}_close_utc", f"{p}_dir", f"{p}_streak"], [*(f"{p}_{c}" for c in ("body_atr", "close_loc", "range_atr", "ret4_atr", "trend_atr", "slope_atr", "atr_pts")), f"pos_in_{p}_prev"]


for _m, _p, _n in ((15, "m15", "feat_htf_m15"), (60, "h1", "feat_htf_h1")):
    _ctes, _plain, _dbl = _htf(_m, _p)
    register(_n, q.query(_ctes, "hx", [*KEY, *_plain], _dbl))(lambda spark, d, m=_m, p=_p, plain=_plain, dbl=_dbl: pick(features.higher(m5(spark, d), src.bars(spark, d, m), m, p), plain, dbl))

_BOLL = f"""{VA}, b0 AS (SELECT *, {q.full('avg', 'close', 50)} AS mid, 2.1 * ({q.full('stddev_pop', 'close', 50)}) AS band FROM v),
bb AS (SELECT *, (close - (mid - band)) / {POS('(mid + band) - (mid - band)')} AS bb_pctb, ((mid + band) - (mid - band)) / a AS bb_width_atr, (close - mid) / a AS bb_mid_dist_atr, close > mid + band AS bb_close_above_upper, close < mid - band AS bb_close_below_lower, high > mid + band AS bb_high_above_upper, low < mid - band AS bb_low_below_lower FROM b0)"""
_BP = ["bb_close_above_upper", "bb_close_below_lower", "bb_high_above_upper", "bb_low_below_lower"]
_BD = ["bb_pctb", "bb_width_atr", "bb_mid_dist_atr"]
register("feat_bollinger", q.query(_BOLL, "bb", [*KEY, *_BP], _BD, places=5))(lambda spark, d: pick(features.bollinger(m5(spark, d)), _BP, _BD, 5))

_STOCH = f"""{q.M5}, k0 AS (SELECT *, 100 * (close - ({q.full('min', 'low', 14)})) / {POS(f"({q.full('max', 'high', 14)}) - ({q.full('min', 'low', 14)})")} AS stoch_k14 FROM m5), st AS (SELECT *, {q.full('avg', 'stoch_k14', 3)} AS stoch_d3 FROM k0)"""
register("feat_stoch", q.query(_STOCH, "st", KEY, ["stoch_k14", "stoch_d3"]))(lambda spark, d: pick(features.stochastic(src.bars(spark, d, 5)), [], ["stoch_k14", "stoch_d3"]))

_VWAP = f"""{VA}, td AS (SELECT *, CAST({q.NY} + INTERVAL 7 HOUR AS DATE) AS trading_day FROM v), vw AS (SELECT *, (close - sum((high + low + close) / 3 * tick_volume) OVER {_DW} / sum(tick_volume) OVER {_DW}) / a AS vwap_dist_atr FROM td)"""
register("feat_vwap", q.query(_VWAP, "vw", KEY, ["vwap_dist_atr"]))(lambda spark, d: pick(features.vwap(m5(spark, d)), [], ["vwap_dist_atr"]))

_OBV = f"""{q.M5}, o0 AS (SELECT *, sum(coalesce(sign(close - {LAG('close')}), 0) * tick_volume) OVER {q.W} AS obv FROM (SELECT *, {LAG('close')} AS pc FROM m5)),
o1 AS (SELECT *, obv - lag(obv, 20) OVER {q.W} AS flow, sum(tick_volume) OVER {q.last(20)} AS vol20 FROM o0), ob AS (SELECT symbol, ts_utc, flow / {POS('vol20')} AS obv_flow20 FROM o1)"""
_OBV = _OBV.replace(f"sign(close - {LAG('close')})", "sign(close - pc)")
register("feat_obv", q.query(_OBV, "ob", KEY, ["obv_flow20"]))(lambda spark, d: pick(features.obv(src.bars(spark, d, 5)), [], ["obv_flow20"]))


def _ema(n: int, x: str = "close", source: str = "", alpha: str | None = None) -> str:
    alpha = alpha or f"(2.0::DOUBLE / ({n} + 1))"
    fr = "(PARTITION BY symbol ORDER BY ts_utc ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN count({x}) OVER {fr} >= {n} THEN list_reduce(list({x}) FILTER ({x} IS NOT NULL) OVER {fr}, lambda acc, x: (1 - {alpha}) * acc + {alpha} * x) END"


# the recursive averages on hourly bars: the twin folds a growing list, which is quadratic
_EMA = f"""{q.M1}, {q.bars(60, 'h')}, {q.atr('h', 'v', 100, 10)},
e0 AS (SELECT *, {', '.join(f'{_ema(n)} AS e{n}' for n in (9, 21, 50, 200))} FROM v),
em AS (SELECT *, {', '.join(f'(close - e{n}) / a AS ema{n}_dist_atr' for n in (9, 21, 50, 200))}, {', '.join(f'(e{n} - lag(e{n}, 5) OVER {q.W}) / a AS ema{n}_slope_atr' for n in (50, 200))},
  CASE WHEN e9 - e21 > 0 AND lag(e9 - e21) OVER {q.W} <= 0 THEN 1 WHEN e9 - e21 < 0 AND lag(e9 - e21) OVER {q.W} >= 0 THEN -1 ELSE 0 END AS ema9_21_cross,
  CASE WHEN e200 IS NULL THEN NULL WHEN e9 > e21 AND e21 > e50 AND e50 > e200 THEN 1 WHEN e9 < e21 AND e21 < e50 AND e50 < e200 THEN -1 ELSE 0 END AS ema_stack FROM e0)"""
_EMD = [*(f"ema{n}_dist_atr" for n in (9, 21, 50, 200)), "ema50_slope_atr", "ema200_slope_atr"]


def _hourly(spark, d):
    return features.averages(features.with_atr(src.bars(spark, d, 60), False))


register("feat_ema_stack", q.query(_EMA, "em", [*KEY, "ema9_21_cross", "ema_stack"], _EMD))(lambda spark, d: pick(_hourly(spark, d), ["ema9_21_cross", "ema_stack"], _EMD))
_W14 = "(1.0::DOUBLE / 14)"
_RSI = f"""{q.M1}, {q.bars(60, 'h')}, {q.atr('h', 'v', 100, 10)},
r0 AS (SELECT symbol, ts_utc, greatest(close - {LAG('close')}, 0 * (close - {LAG('close')})) AS gain, greatest({LAG('close')} - close, 0 * (close - {LAG('close')})) AS loss, tr,
  CASE WHEN high - {LAG('high')} > {LAG('low')} - low AND high - {LAG('high')} > 0 THEN high - {LAG('high')} ELSE 0.0 END AS pdm, CASE WHEN {LAG('low')} - low > high - {LAG('high')} AND {LAG('low')} - low > 0 THEN {LAG('low')} - low ELSE 0.0 END AS mdm FROM v),
r1 AS (SELECT symbol, ts_utc, CASE WHEN lag(ts_utc) OVER {q.W} IS NULL THEN NULL ELSE gain END AS gain, CASE WHEN lag(ts_utc) OVER {q.W} IS NULL THEN NULL ELSE loss END AS loss, tr, pdm, mdm FROM r0),
r2 AS (SELECT symbol, ts_utc, {', '.join(f'{_ema(14, c, alpha=_W14)} AS w_{c}' for c in ('gain', 'loss', 'tr', 'pdm', 'mdm'))} FROM r1),
r3 AS (SELECT *, 100 * w_pdm / {POS('w_tr')} AS plus_di14, 100 * w_mdm / {POS('w_tr')} AS minus_di14 FROM r2),
r4 AS (SELECT *, 100 * abs(plus_di14 - minus_di14) / {POS('plus_di14 + minus_di14')} AS dx FROM r3),
rs AS (SELECT *, {_ema(14, 'dx', alpha=_W14)} AS adx14, CASE WHEN w_gain IS NULL OR w_loss IS NULL THEN NULL WHEN w_loss = 0 THEN CASE WHEN w_gain = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + w_gain / w_loss) END AS rsi14 FROM r4)"""
register("feat_rsi_adx", q.query(_RSI, "rs", KEY, ["rsi14", "adx14", "plus_di14", "minus_di14"]))(lambda spark, d: pick(_hourly(spark, d), [], ["rsi14", "adx14", "plus_di14", "minus_di14"]))
_MACD = f"""{q.M1}, {q.bars(60, 'h')}, {q.atr('h', 'v', 100, 10)}, c0 AS (SELECT *, {_ema(12)} AS e12, {_ema(26)} AS e26 FROM v), c1 AS (SELECT *, e12 - e26 AS macd FROM c0), c2 AS (SELECT *, {_ema(9, 'macd')} AS sig FROM c1), c3 AS (SELECT *, macd - sig AS hist FROM c2),
mc AS (SELECT *, macd / a AS macd_atr, sig / a AS macd_signal_atr, hist / a AS macd_hist_atr, CASE WHEN hist > 0 AND lag(hist) OVER {q.W} <= 0 THEN 1 WHEN hist < 0 AND lag(hist) OVER {q.W} >= 0 THEN -1 ELSE 0 END AS macd_cross FROM c3)"""
register("feat_macd", q.query(_MACD, "mc", [*KEY, "macd_cross"], ["macd_atr", "macd_signal_atr", "macd_hist_atr"]))(lambda spark, d: pick(_hourly(spark, d), ["macd_cross"], ["macd_atr", "macd_signal_atr", "macd_hist_atr"]))


def _five(spark, d):
    """The averages on five-minute bars, all rows; without twins, tests recompute them bar by bar."""
    return features.averages(m5(spark, d))


register("feat_ema_stack_m5")(lambda spark, d: pick(_five(spark, d), ["ema9_21_cross", "ema_stack"], _EMD))
register("feat_rsi_adx_m5")(lambda spark, d: pick(_five(spark, d), [], ["rsi14", "adx14", "plus_di14", "minus_di14"]))
register("feat_macd_m5")(lambda spark, d: pick(_five(spark, d), ["macd_cross"], ["macd_atr", "macd_signal_atr", "macd_hist_atr"]))

_HYG = f"""{_SEQUENCE},
l0 AS (SELECT *, last_value(CAST(CASE WHEN spread_points > 0 THEN spread_points END AS DOUBLE) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lvl FROM m1),
l1 AS (SELECT *, lvl / {POS(q.full('median', 'lvl', 1440, least=144))} AS known, date_part('hour', ts_utc) AS hr FROM l0),
l2 AS (SELECT *, CASE WHEN count(known) OVER (PARTITION BY symbol, hr ORDER BY ts_utc ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) >= 40 THEN list_sort(list(known) FILTER (known IS NOT NULL) OVER (PARTITION BY symbol, hr ORDER BY ts_utc ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))[CAST(floor(0.99 * (count(known) OVER (PARTITION BY symbol, hr ORDER BY ts_utc ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) - 1)) AS BIGINT) + 1] END AS p99 FROM l1),
l5 AS (SELECT symbol AS ls, time_bucket(INTERVAL '5 minutes', ts_utc) AS lt, arg_max(lvl, ts_utc) AS spread_pts, arg_max(coalesce(known, 1.0), ts_utc) AS spread_rel, bool_or(coalesce(known > p99, false)) AS hyg_abnormal_spread FROM l2 GROUP BY ALL),
hy0 AS (SELECT sq.*, spread_pts, spread_rel, hyg_abnormal_spread, {q.minute(q.NY)} AS nym, isodow({q.NY}) AS nyd FROM sq LEFT JOIN l5 ON ls = symbol AND lt = ts_utc),
hy1 AS (SELECT *, nym >= 1005 AND nym < 1110 AS hyg_rollover, bars_since_week_open < 3 AS hyg_week_first3, nyd = 5 AND nym >= 1005 AND nym < 1020 AS hyg_week_last3, gap_before_min > 1440 AS hyg_weekend_gap, bars_since_week_open < 19 AS hyg_spans_weekend_gap, m1_bars < 5 AS hyg_incomplete FROM hy0),
hy AS (SELECT *, hyg_rollover OR coalesce(hyg_abnormal_spread, false) OR hyg_week_first3 OR hyg_week_last3 AS hyg_no_entry FROM hy1)"""
_HYP = ["hyg_rollover", "hyg_abnormal_spread", "hyg_week_first3", "hyg_week_last3", "hyg_weekend_gap", "hyg_spans_weekend_gap", "hyg_incomplete", "hyg_no_entry"]


def hygienic(spark, d):
    """Anatomy, sequence, spread and hygiene on shortened look-backs."""
    b = features.sequence(features.anatomy(m5(spark, d)))
    s = features.minute_spread(src.bars(spark, d, 1), 1440, 144, 200, 40)
    return features.hygiene(b.join(s, KEY, "left"))


register("feat_spread_hygiene", q.query(_HYG, "hy", [*KEY, *_HYP], ["spread_pts", "spread_rel"]))(lambda spark, d: pick(hygienic(spark, d), _HYP, ["spread_pts", "spread_rel"]))

# structure

_FW = lambda x: f"last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BW = lambda x: f"last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _swings(source: str, k: int, out: str) -> str:
    past, nxt = f"(PARTITION BY symbol ORDER BY ts_utc ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)", f"(PARTITION BY symbol ORDER BY ts_utc ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
    whole = f"count(*) OVER (PARTITION BY symbol ORDER BY ts_utc ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) = {2 * k + 1}"
    return f"""{out}p AS (SELECT *, row_number() OVER {q.W} AS rn, CASE WHEN {whole} AND high > max(high) OVER {past} AND high >= max(high) OVER {nxt} THEN high END AS pivot_high, CASE WHEN {whole} AND low < min(low) OVER {past} AND low <= min(low) OVER {nxt} THEN low END AS pivot_low FROM {source}),
{out}c AS (SELECT *, lag(pivot_high, {k}) OVER {q.W} AS ch, lag(pivot_low, {k}) OVER {q.W} AS cl FROM {out}p),
{out}d AS (SELECT *, CASE WHEN ch IS NOT NULL THEN rn - {k} END AS chr, CASE WHEN cl IS NOT NULL THEN rn - {k} END AS clr, CASE WHEN ch IS NOT NULL THEN coalesce({_BW('ch')}, -1e9) END AS chp, CASE WHEN cl IS NOT NULL THEN coalesce({_BW('cl')}, -1e9) END AS clp FROM {out}c),
{out} AS (SELECT *, {_FW('ch')} AS hi, {_FW('chr')} AS hi_row, nullif({_FW('chp')}, -1e9) AS hi_prev, {_FW('cl')} AS lo, {_FW('clr')} AS lo_row, nullif({_FW('clp')}, -1e9) AS lo_prev FROM {out}d)"""


_TREND = "CASE WHEN hi_prev IS NULL OR lo_prev IS NULL THEN NULL WHEN hi > hi_prev AND lo > lo_prev THEN 1 WHEN hi < hi_prev AND lo < lo_prev THEN -1 ELSE 0 END"
_STATE = f"""{VA}, {_swings('v', 5, 'sw')},
ss AS (SELECT *, (close - hi) / a AS sw_hi_dist_atr, (close - lo) / a AS sw_lo_dist_atr, rn - hi_row AS sw_hi_age, rn - lo_row AS sw_lo_age, {_TREND} AS sw_trend, (hi - lo) / a AS rng_width_atr, (close - lo) / {POS('hi - lo')} AS rng_pos,
  coalesce(high > hi AND close < hi, false) AS sweep_high, coalesce(low < lo AND close > lo, false) AS sweep_low FROM sw),
st AS (SELECT *, CASE WHEN sweep_high THEN (high - hi) / a WHEN sweep_low THEN (lo - low) / a END AS sweep_depth_atr FROM ss)"""
register("swings", f"WITH {q.M5}, {_swings('m5', 5, 'sw')}, k AS (SELECT symbol, ts_utc, pivot_high, pivot_low, lead(ts_utc, 5) OVER {q.W} AS known_at FROM sw) SELECT symbol, ts_utc, 'high' AS kind, pivot_high AS price, known_at FROM k WHERE pivot_high IS NOT NULL UNION ALL SELECT symbol, ts_utc, 'low', pivot_low, known_at FROM k WHERE pivot_low IS NOT NULL")(
    lambda spark, d: structure.swings_table(src.bars(spark, d, 5))
)
_STP, _STD = ["sw_hi_age", "sw_lo_age", "sw_trend"], ["sw_hi_dist_atr", "sw_lo_dist_atr", "rng_width_atr", "rng_pos"]


def _state(spark, d):
    b = structure.swing_features(m5(spark, d))
    return b.withColumns({c: F.col(c).cast("long") for c in ("sw_hi_age", "sw_lo_age")})


register("swing_state", q.query(_STATE, "st", [*KEY, *_STP], _STD))(lambda spark, d: pick(_state(spark, d), _STP, _STD))
register("sweeps", q.query(_STATE, "st", [*KEY, "sweep_high", "sweep_low"], ["sweep_depth_atr"]))(lambda spark, d: pick(_state(spark, d), ["sweep_high", "sweep_low"], ["sweep_depth_atr"]))


def _break(name: str, level: str, s: int, source: str) -> str:
    up = s > 0
    gt = (lambda x, y: f"{x} > {y}") if up else (lambda x, y: f"{x} < {y}")
    touched = f"low <= plv_{name} + 0.25 * a AND close > plv_{name}" if up else f"high >= plv_{name} - 0.25 * a AND close < plv_{name}"
    failed = f"rn - prn_{name} <= 12 AND {'close < plv_' + name if up else 'close > plv_' + name}"
    return f"""{name}0 AS (SELECT *, coalesce({gt('close', level)}, false) AND NOT coalesce({gt('lag(close) OVER ' + q.W, level)}, false) AS sw_break_{name} FROM {source}),
{name}1 AS (SELECT *, CASE WHEN sw_break_{name} THEN rn END AS brn_{name}, CASE WHEN sw_break_{name} THEN {level} END AS blv_{name} FROM {name}0),
{name}2 AS (SELECT *, {_FW('brn_' + name)} AS urn_{name}, {_BW('brn_' + name)} AS prn_{name}, {_BW('blv_' + name)} AS plv_{name} FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN rn - urn_{name} <= 48 THEN rn - urn_{name} END AS bars_since_break_{name}, coalesce(rn - prn_{name} <= 24 AND {touched}, false) AS retest_{name}, coalesce({failed}, false) AS fb_{name} FROM {name}2),
{name} AS (SELECT *, fb_{name} AND coalesce(sum(CAST(fb_{name} AS INTEGER)) OVER (PARTITION BY symbol, prn_{name} ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS failed_break_{name} FROM {name}3)"""


_BREAK = f"{_STATE}, {_break('up', 'hi', 1, 'st')}, {_break('down', 'lo', -1, 'up')}"
_BK = [f"{c}_{n}" for n in ("up", "down") for c in ("sw_break", "bars_since_break", "retest", "failed_break")]


def _broken(spark, d):
    b = structure.break_features(structure.swing_features(m5(spark, d)))
    return b.withColumns({c: F.col(c).cast("long") for c in ("bars_since_break_up", "bars_since_break_down")})


register("breaks_retests", f"WITH {_BREAK} SELECT symbol, ts_utc, {', '.join(_BK)} FROM down")(lambda spark, d: _broken(spark, d).select(*KEY, *_BK))
register("h1_structure", q.query(f"""{VA}, {q.bars(60, 'h')}, {_swings('h', 3, 'hsw')}, hk AS (SELECT symbol AS hs, ts_utc + INTERVAL '60 minutes' AS known, {_TREND} AS h1_sw_trend, hi AS h1_hi, lo AS h1_lo FROM hsw),
hx AS (SELECT v.*, h1_sw_trend, (close - h1_hi) / a AS h1_sw_hi_dist_atr, (close - h1_lo) / a AS h1_sw_lo_dist_atr FROM v ASOF LEFT JOIN hk ON v.symbol = hs AND v.available_at >= known)""", "hx", [*KEY, "h1_sw_trend"], ["h1_sw_hi_dist_atr", "h1_sw_lo_dist_atr"]))(
    lambda spark, d: pick(structure.h1_features(m5(spark, d), src.bars(spark, d, 60)), ["h1_sw_trend"], ["h1_sw_hi_dist_atr", "h1_sw_lo_dist_atr"])
)


_EVENT = " UNION ALL ".join([f"SELECT symbol, ts_utc, '{k}' AS kind FROM ev WHERE {c}" for k, c in [*((f"{a}_{n}", f"{b}_{n}") for n in ("up", "down") for a, b in (("break", "sw_break"), ("failed_break", "failed_break"))), ("sweep_high", "sweep_high"), ("sweep_low", "sweep_low")]]
    + [f"SELECT symbol, ts_utc, 'retest_{n}' FROM (SELECT *, row_number() OVER (PARTITION BY symbol, k_{n} ORDER BY ts_utc) AS k FROM ev WHERE retest_{n}) WHERE k = 1" for n in ("up", "down")])
_BEFORE = "(PARTITION BY symbol ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
register("overlay_events", f"WITH {_BREAK}, ev AS (SELECT *, {', '.join(f'coalesce(sum(CAST(sw_break_{n} AS INTEGER)) OVER {_BEFORE}, 0) AS k_{n}' for n in ('up', 'down'))} FROM down) {_EVENT}")(lambda spark, d: structure.structure_events(_broken(spark, d)))


@register("overlay_lines")
def overlay_lines(spark, d):
    """The trendlines themselves, a row each."""
    return rounded(structure.lines_table(_priced_bars(spark, d)))


@register("overlay_levels")
def overlay_levels(spark, d):
    return rounded(structure.levels_now(_priced_bars(spark, d)))


@register("sr_levels")
def sr_levels(spark, d):
    return rounded(structure.level_features(_priced_bars(spark, d)))


@register("trendlines")
def trendlines(spark, d):
    b = structure.line_features(_priced_bars(spark, d))
    return rounded(b.drop("ch_up_pos", "ch_dn_pos", "ch_width_atr"))


@register("channels")
def channels(spark, d):
    b = structure.line_features(_priced_bars(spark, d))
    return rounded(b.select(*KEY, "ch_up_pos", "ch_dn_pos", "ch_width_atr"))


# rules and visibility

SPEC = {
    "name": "demo", "family": "momentum", "exit": {"stop_atr": 1.0, "target_atr": 1.5, "time_exit_bars": 24},
    "rules": [
        {"side": "long", "conditions": [{"feature": "close_loc", "op": ">", "value": 0.7}, {"feature": "streak", "op": ">=", "value": 2}]},
        {"side": "long", "conditions": [{"feature": "dirs_3", "op": "in", "value": ["UUU", "DUU"]}, {"feature": "ret_atr", "op": "between", "value": [0.5, 3.0]}]},
        {"side": "short", "conditions": [{"feature": "close_loc", "op": "<", "value": 0.3}, {"feature": "streak", "op": "<=", "value": -2}]},
        {"side": "short", "conditions": [{"feature": "dirs_3", "op": "not_in", "value": ["UUU", "DUU", "DDU"]}, {"feature": "ret5_atr", "op": ">", "value": 2.0}]},
    ],
    "filters": {"hours": list(range(6, 22)), "max_spread_rel": 2.5},
}

_LONG = "(coalesce(close_loc > 0.7, false) AND coalesce(streak >= 2, false)) OR (coalesce(dirs_3 IN ('UUU', 'DUU'), false) AND coalesce(ret_atr BETWEEN 0.5 AND 3.0, false))"
_SHORT = "(coalesce(close_loc < 0.3, false) AND coalesce(streak <= -2, false)) OR (coalesce(dirs_3 NOT IN ('UUU', 'DUU', 'DDU'), false) AND coalesce(ret5_atr > 2.0, false))"
SIGNALS = f"""{_HYG}, sg0 AS (SELECT *, {_LONG} AS lg, {_SHORT} AS sh FROM hy WHERE NOT hyg_no_entry AND atr_pts > 0 AND date_part('hour', ts_utc) BETWEEN 6 AND 21 AND spread_rel <= 2.5),
sig AS (SELECT symbol, available_at AS decision_time, event_time, CASE WHEN lg THEN 1 ELSE -1 END AS side, atr_pts FROM sg0 WHERE lg <> sh)"""


def with_rules(spark, d):
    """What the rules read, kept."""
    return kept(spark, d, "rules", lambda: hygienic(spark, d)).withColumns({"hour_utc": F.hour("ts_utc"), "dow": cal.iso_weekday(F.col("ts_utc"))})


register("signals_compile", q.query(SIGNALS, "sig", ["symbol", "decision_time", "event_time", "side"], ["atr_pts"]))(lambda spark, d: rounded(strategy.signals(with_rules(spark, d), SPEC)))


def _condition_sql(c: dict) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    x, op, v = c["feature"], c["op"], c["value"]
    if op == "between":
        return f"coalesce({x} BETWEEN {v[0]} AND {v[1]}, false)"
    if op in ("in", "not_in"):
        return f"coalesce({x} {'NOT IN' if op == 'not_in' else 'IN'} ({', '.join(map(lit, v))}), false)"
    return f"coalesce({x} {op} {lit(v)}, false)"


_GATES = {"hygiene": "NOT coalesce(hyg_no_entry, true)", "atr": "coalesce(atr_pts > 0, false)", "hours": "date_part('hour', ts_utc) BETWEEN 6 AND 21", "max_spread_rel": "coalesce(spread_rel <= 2.5, false)"}
_CHECKS = [f"SELECT symbol, event_time, 'gate {k}' AS name, CAST(NULL AS DOUBLE) AS actual, CAST(NULL AS VARCHAR) AS code, {g} AS passed FROM hy" for k, g in _GATES.items()]
for _i, _r in enumerate(SPEC["rules"]):
    for _c in _r["conditions"]:
        _name = f"{_r['side']} {_i + 1}: {_c['feature']} {_c['op']} {_c['value']}".replace("'", "''")
        _is_code = _c["feature"] == "dirs_3"
        _CHECKS.append(f"SELECT symbol, event_time, '{_name}', {'NULL' if _is_code else 'round(CAST(' + _c['feature'] + ' AS DOUBLE), 6)'}, {_c['feature'] if _is_code else 'NULL'}, {_condition_sql(_c)} FROM hy")


@register("signals_explain", f"WITH {_HYG} {' UNION ALL '.join(_CHECKS)}")
def signals_explain(spark, d):
    """Every check of every bar: gates and conditions, with the number or code that was compared."""
    rows = strategy.explain(with_rules(spark, d), SPEC)
    number = F.col("actual").try_cast("double")
    return rows.select("symbol", "event_time", "name", F.round(number, 6).alias("actual"), F.when(number.isNull(), F.col("actual")).alias("code"), "passed")


register("features_asof_visible", q.query(f"{_ANATOMY}", "an", [*KEY, "event_time", "available_at"], ["close_loc"], "WHERE available_at <= TIMESTAMP '2024-01-15 12:03:00'"))(
    lambda spark, d: rounded(store.as_of(features.anatomy(m5(spark, d)), "2024-01-15 12:03:00").select(*KEY, "event_time", "available_at", "close_loc"))
)


@register("availability_audit", f"WITH {VA} SELECT count(*) AS rows, count(*) FILTER (available_at IS NULL) AS unknown, count(*) FILTER (available_at < event_time + INTERVAL '5 minutes') AS too_early, count(*) - count(DISTINCT event_time) AS duplicates, 0::BIGINT AS forming_h1 FROM v")
def availability_audit(spark, d):
    return store.availability_audit(features.higher(m5(spark, d), src.bars(spark, d, 60), 60, "h1"))


@register("features_full")
def features_full(spark, d):
    """All 163 features of five-minute bars in one table; each group has a query of its own."""
    minute = staged(src.bars(spark, d, 1), "minute")
    return table.in_research_window(table.whole(minute), minute)


CUTS = ["2024-01-09 14:37:00", "2024-01-17 08:02:00"]


#: The twin of a leakage check: no column may differ.
_NO_LEAK = f"""SELECT unnest([{', '.join(f"'{c}'" for c in ('rows', 'open', 'high', 'low', 'close', 'm1_bars', *table.META, *table.FEATURES))}]) AS "column", CAST(0 AS BIGINT) AS mismatches"""


@register("leakage_recompute", _NO_LEAK)
def leakage_recompute(spark, d):
    """Mismatches by column between the full build and builds on cut histories: all must be 0."""
    minute = staged(src.bars(spark, d, 1), "minute")
    return store.recompute_check(minute, lambda m: staged(table.whole(m), "features"), CUTS).groupBy("column").agg(F.sum("mismatches").alias("mismatches"))


@register("leakage_perturb", _NO_LEAK)
def leakage_perturb(spark, d):
    minute = staged(src.bars(spark, d, 1), "minute")
    return store.perturb_check(minute, lambda m: staged(table.whole(m), "features"), CUTS[-1])


_REGIME = f"{_HYG}, {_SESSION.split(q.M5 + ', ', 1)[1]}"
_SECTIONS = [*(f"SELECT symbol, 'hygiene' AS section, '{c}' AS name, count(*) FILTER ({c}) AS n FROM hy GROUP BY symbol" for c in _HYP), "SELECT symbol, 'session', session, count(*) FROM se GROUP BY symbol, session"]
register("feature_summary", f"WITH {_REGIME}, su AS ({' UNION ALL '.join(_SECTIONS)}) SELECT symbol, section, name, n, round(n / (SELECT count(*) FROM hy), 6) AS share FROM su")(
    lambda spark, d: rounded(table.summary(features.session(hygienic(spark, d)).withColumn("vol_regime", F.lit(None).cast("string"))).where("section <> 'vol_regime'"))
)
_NULLS = [f"SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS nulls, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS share FROM sq" for c in [*_AN, *_SQP, *_SQD]]
register("null_shares", f"WITH {_SEQUENCE} {' UNION ALL '.join(_NULLS)}")(
    lambda spark, d: rounded(table.null_shares(features.sequence(features.anatomy(m5(spark, d))).select(*_AN, *_SQP, *_SQD)))
)
