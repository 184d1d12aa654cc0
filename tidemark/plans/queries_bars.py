"""Queries on ticks, bars, clock, quality and costs, each with its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import quantiles
from tidemark.operators.joins import compare_tables
from tidemark.plans import clock, costs, quality
from tidemark.plans import sql as q
from tidemark.sources import tape as src
from tidemark.sources.datasets import kept
from tidemark.sources.manifest import staged

QUERIES, ORACLE = {}, {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


BAR = ["symbol", "ts_utc", "open", "high", "low", "close", "tick_volume", "spread_points_min", "spread_points_max", "m1_bars"]

for _minutes, _name in ((5, "ohlc_m5"), (15, "ohlc_m15"), (60, "ohlc_h1")):
    register(_name, q.query(f"{q.M1}, {q.bars(_minutes, 'b')}", "b", BAR))(lambda spark, d, m=_minutes: src.bars(spark, d, m).select(*BAR))

register("ohlc_by_symbol_h1", "SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts_utc, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS tick_volume FROM events GROUP BY ALL")(
    lambda spark, d: src.bars(spark, d, 60, by_type=True).select("symbol", "ts_utc", "open", "high", "low", "close", "tick_volume")
)


@register("scan_prune_filter", "SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount >= 0.05 AND l_returnflag <> 'N'")
def scan_prune_filter(spark, d):
    x = src.table(spark, d, "lineitem").where(F.col("l_quantity").between(10, 20) & (F.col("l_discount") >= 0.05) & (F.col("l_returnflag") != "N"))
    return x.select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@register("bars_verify_full_outer", f"""WITH {q.M5}, {q.bars(15, 'a')},
b AS (SELECT symbol, time_bucket(INTERVAL '15 minutes', ts_utc) AS ts_utc, arg_min(open, ts_utc) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts_utc) AS close FROM m5 WHERE m1_bars > 1 GROUP BY symbol, time_bucket(INTERVAL '15 minutes', ts_utc))
SELECT symbol, ts_utc, a.open IS NOT NULL AS in_a, b.open IS NOT NULL AS in_b, coalesce(abs(a.open - b.open) <= 1e-6 AND abs(a.high - b.high) <= 1e-6 AND abs(a.low - b.low) <= 1e-6 AND abs(a.close - b.close) <= 1e-6, false) AS same FROM a FULL JOIN b USING (symbol, ts_utc)""")
def bars_verify_full_outer(spark, d):
    m1 = src.bars(spark, d, 1)
    busy = src.aggregate(m1, 5).where("m1_bars > 1").withColumn("spread_points", F.col("spread_points_min"))
    return compare_tables(src.aggregate(m1, 15), src.aggregate(busy, 15), ["symbol", "ts_utc"], ["open", "high", "low", "close"]).select("symbol", "ts_utc", "in_a", "in_b", "same")


_GAPS = f"""{q.M1},
g AS (SELECT symbol, ts_utc AS after, date_diff('minute', ts_utc, lead(ts_utc) OVER {q.W}) - 1 AS minutes FROM m1),
n AS (SELECT *, {q.zone('America/New_York', "after + INTERVAL '1 minute'")} AS ny FROM g WHERE minutes > 0),
c AS (SELECT symbol, after, minutes, CASE WHEN isodow(ny) >= 5 AND minutes >= 1440 THEN 'weekend' WHEN {q.minute('ny')} BETWEEN 1000 AND 1040 AND minutes BETWEEN 30 AND 150 THEN 'daily_break'
  WHEN minutes >= 150 THEN 'closure' WHEN minutes >= 30 THEN 'long_intraday' ELSE 'short_intraday' END AS category FROM n)"""
register("gap_classify", f"WITH {_GAPS} SELECT * FROM c")(lambda spark, d: quality.classify_gaps(src.bars(spark, d, 1)))
register("gap_summary", f"WITH {_GAPS} SELECT category, count(*) AS n, CAST(sum(minutes) AS BIGINT) AS total, max(minutes) AS longest, median(minutes) AS median FROM c GROUP BY category")(lambda spark, d: quality.gap_summary(quality.classify_gaps(src.bars(spark, d, 1))))

_BREAKS = f"""{q.M1},
b0 AS (SELECT symbol, ts_utc + INTERVAL '1 minute' AS starts, date_diff('minute', ts_utc, lead(ts_utc) OVER {q.W}) AS minutes FROM m1),
b1 AS (SELECT *, CAST(starts AS DATE) AS day, row_number() OVER (PARTITION BY symbol, CAST(starts AS DATE) ORDER BY minutes DESC, starts) AS k FROM b0 WHERE minutes BETWEEN 15 AND 150 AND isodow(starts) <= 5),
breaks AS (SELECT symbol, day, starts, minutes FROM b1 WHERE k = 1)"""
register("daily_breaks", f"WITH {_BREAKS} SELECT * FROM breaks")(lambda spark, d: clock.daily_breaks(src.bars(spark, d, 1), 15, 150))
_MODE = f"""{_BREAKS},
o AS (SELECT symbol, CAST(date_part('isoyear', starts) AS INTEGER) AS iso_year, CAST(date_part('week', starts) AS INTEGER) AS iso_week,
  round_even(((((date_diff('minute', ((CAST(day AS TIMESTAMP) + INTERVAL '1020 minutes') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', starts) + 720) % 1440) + 1440) % 1440 - 720) / 30, 0) / 2 + 0.0 AS offset_hours FROM breaks),
votes AS (SELECT symbol, iso_year, iso_week, offset_hours, count(*) AS n FROM o GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, iso_year, iso_week ORDER BY n DESC, offset_hours) AS k, CAST(sum(n) OVER (PARTITION BY symbol, iso_year, iso_week) AS BIGINT) AS n_days FROM votes),
weekly AS (SELECT symbol, iso_year, iso_week, offset_hours, n_days, n / n_days AS agreement FROM ranked WHERE k = 1)"""
register("clock_weekly_mode", q.query(_MODE, "weekly", ["symbol", "iso_year", "iso_week", "offset_hours", "n_days"], ["agreement"]))(lambda spark, d: rounded(clock.weekly_mode(clock.break_offsets(clock.daily_breaks(src.bars(spark, d, 1), 15, 150)))))

_WEEKS = [(2024, 1, 2.0), (2024, 2, 3.0), (2024, 4, -5.5)]
_WEEK_SQL = ", ".join(f"('ALL', {y}, {w}, CAST({o} AS DOUBLE))" for y, w, o in _WEEKS)


def _weekly(spark):
    return spark.createDataFrame([("ALL", *w) for w in _WEEKS], "symbol string, iso_year int, iso_week int, offset_hours double")


@register("weekly_offset_apply", f"""WITH {q.M1}, o(symbol, iso_year, iso_week, offset_hours) AS (VALUES {_WEEK_SQL})
SELECT m1.symbol, m1.ts_utc AS ts_server, m1.close, m1.ts_utc - CAST(offset_hours * 60 AS INTEGER) * INTERVAL '1 minute' AS ts_utc
FROM m1 LEFT JOIN o ON m1.symbol = o.symbol AND date_part('isoyear', m1.ts_utc) = o.iso_year AND date_part('week', m1.ts_utc) = o.iso_week""")
def weekly_offset_apply(spark, d):
    bars = src.bars(spark, d, 1).select("symbol", F.col("ts_utc").alias("ts_server"), "close")
    return clock.apply_offsets(bars, _weekly(spark)).select("symbol", "ts_server", "close", "ts_utc")


@register("weeks_anti_nearest", f"""WITH o(symbol, iso_year, iso_week, offset_hours) AS (VALUES {_WEEK_SQL}),
weeks AS (SELECT DISTINCT 'ALL' AS symbol, CAST(date_part('isoyear', ts) AS INTEGER) AS iso_year, CAST(date_part('week', ts) AS INTEGER) AS iso_week FROM events),
gap AS (SELECT w.*, o.offset_hours, row_number() OVER (PARTITION BY w.iso_year, w.iso_week ORDER BY abs((w.iso_year * 100 + w.iso_week) - (o.iso_year * 100 + o.iso_week)), o.iso_year * 100 + o.iso_week) AS k FROM weeks w ANTI JOIN o USING (iso_year, iso_week) CROSS JOIN o)
SELECT w.symbol, w.iso_year, w.iso_week, offset_hours, 'measured' AS source FROM weeks w JOIN o USING (iso_year, iso_week)
UNION ALL SELECT symbol, iso_year, iso_week, offset_hours, 'nearest' FROM gap WHERE k = 1""")
def weeks_anti_nearest(spark, d):
    t = src.tape(spark, d)
    weeks = t.select("symbol", cal.iso_year(F.col("ts_utc")).alias("iso_year"), cal.iso_week(F.col("ts_utc")).alias("iso_week")).distinct()
    return clock.fill_weeks(weeks, _weekly(spark))


register("research_window", f"""WITH {q.M1}, w AS (SELECT symbol, date_trunc('week', ts_utc) AS week, count(*) AS n_bars, min(ts_utc) AS first_bar FROM m1 GROUP BY ALL),
f AS (SELECT *, n_bars >= 0.8 * median(n_bars) OVER (PARTITION BY symbol) AS is_full FROM w)
SELECT symbol, CAST(week AS TIMESTAMP) AS week, n_bars, is_full, min(CASE WHEN is_full THEN first_bar END) OVER (PARTITION BY symbol) AS starts FROM f""")(lambda spark, d: quality.research_window(src.bars(spark, d, 1)))

register("quality_blocking", f"""WITH {q.M1}, s AS (SELECT *, epoch(ts_utc) - epoch({q.lag('ts_utc')}) AS step FROM m1),
c AS (SELECT symbol, count(*) AS n_bars, count(*) - count(DISTINCT ts_utc) AS duplicate_timestamps, count(*) FILTER (step < 0) AS non_monotonic,
  count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS invalid_ohlc, count(*) FILTER (least(open, high, low, close) <= 0) AS non_positive FROM s GROUP BY symbol)
SELECT *, duplicate_timestamps = 0 AND non_monotonic = 0 AND invalid_ohlc = 0 AND non_positive = 0 AS passed FROM c""")(lambda spark, d: quality.blocking(src.bars(spark, d, 1)))

register("price_anomalies", q.query(f"""{q.M5}, r AS (SELECT *, high - low AS range FROM m5),
u AS (SELECT *, {q.full('median', 'range', 240, -1, 60)} AS usual, abs(open - {q.lag('close')}) AS gap FROM r),
x AS (SELECT *, range > 3.0 * usual AS wide_range, gap > 8.0 * usual AS open_gap FROM u)""", "x", ["symbol", "ts_utc", "wide_range", "open_gap"], ["range", "gap", "usual"], "WHERE wide_range OR open_gap"))(
    lambda spark, d: rounded(quality.price_anomalies(src.bars(spark, d, 5), wide=3.0, jump=8.0)).select("symbol", "ts_utc", "wide_range", "open_gap", "range", "gap", "usual")
)


def _near(x: str, share: str, group: str = "symbol") -> str:
    return f"list_sort(list({x}) FILTER ({x} IS NOT NULL))[CAST(round_even({share} * (count({x}) - 1), 0) AS BIGINT) + 1]"


register("spread_nearest_quantiles", f"""WITH {q.M1}, s AS (SELECT symbol, {_near('spread_points', '0.5')} AS p50, {_near('spread_points', '0.9')} AS p90, {_near('spread_points', '0.99')} AS p99, count(spread_points) AS n FROM m1 GROUP BY symbol)
SELECT s.*, (SELECT count(*) FROM m1 WHERE spread_points <= 0) AS not_positive, (SELECT count(*) FROM m1 WHERE spread_points > 5 * s.p99) AS extreme FROM s""")(lambda spark, d: quality.spread_stats(src.bars(spark, d, 1)))

register("coverage", f"WITH {q.M1} SELECT symbol, round(avg(CAST(high = low AS DOUBLE)), 6) AS flat_share, round(count(*) / (date_diff('minute', min(ts_utc), max(ts_utc)) + 1), 6) AS coverage FROM m1 GROUP BY symbol")(lambda spark, d: rounded(quality.coverage(src.bars(spark, d, 1))))

register("atr_vol_ratio", q.query(q.V5, "v", ["symbol", "ts_utc"], ["atr_pts", "vol_ratio"]))(lambda spark, d: rounded(costs.volatility(src.bars(spark, d, 5)).select("symbol", "ts_utc", "atr_pts", "vol_ratio")))

_TERCILE = f"""{q.V5}, e AS (SELECT symbol AS es, {_near('vol_ratio', '(1.0::DOUBLE / 3)')} AS lo, {_near('vol_ratio', '(2.0::DOUBLE / 3)')} AS hi FROM v GROUP BY symbol),
vb AS (SELECT v.*, CASE WHEN vol_ratio IS NULL OR lo IS NULL THEN 'mid' WHEN vol_ratio < lo THEN 'low' WHEN vol_ratio < hi THEN 'mid' ELSE 'high' END AS vol_bucket FROM v LEFT JOIN e ON symbol = es)"""
register("tercile_bucket", f"WITH {_TERCILE} SELECT symbol, ts_utc, vol_bucket FROM vb")(lambda spark, d: costs.with_bucket(costs.volatility(src.bars(spark, d, 5))).select("symbol", "ts_utc", "vol_bucket"))

_HIST = f"""{q.M1},
t0 AS (SELECT *, CAST(round_even((ask - bid) / 0.01, 0) AS BIGINT) AS points FROM tape WHERE bid > 0 AND ask > 0),
t1 AS (SELECT *, date_diff('microsecond', ts_utc, lead(ts_utc) OVER (PARTITION BY symbol, CAST(ts_utc AS DATE) ORDER BY ts_utc, event_id)) / 1e6 AS held FROM t0 WHERE points > 0),
hist AS (SELECT symbol, time_bucket(INTERVAL '1 minute', ts_utc) AS ts_utc, points AS spread_points, sum(least(greatest(coalesce(held, 60.0), 0.001), 60.0)) AS seconds, count(*) AS ticks FROM t1 GROUP BY ALL)"""
register("tick_histogram", q.query(_HIST, "hist", ["symbol", "ts_utc", "spread_points", "ticks"], ["seconds"]))(lambda spark, d: rounded(costs.histogram(src.tape(spark, d)).select("symbol", "ts_utc", "spread_points", "ticks", "seconds")))

_MEASURED = f"""{_HIST}, measured AS (SELECT symbol, ts_utc, sum(spread_points * seconds) / sum(seconds) AS spread_mean, min(spread_points) AS spread_min, max(spread_points) AS spread_max, sum(seconds) AS seconds, CAST(sum(ticks) AS BIGINT) AS ticks FROM hist GROUP BY symbol, ts_utc)"""
register("measured_minutes", q.query(_MEASURED, "measured", ["symbol", "ts_utc", "spread_min", "spread_max", "ticks"], ["spread_mean", "seconds"]))(lambda spark, d: rounded(costs.measured_minutes(costs.histogram(src.tape(spark, d)))).select("symbol", "ts_utc", "spread_min", "spread_max", "ticks", "spread_mean", "seconds"))

_ROLL = f"{q.minute(q.NY)} >= 1005 AND {q.minute(q.NY)} < 1110"
#: Volatility buckets of five-minute bars, by names that no other twin uses.
_BUCKETS = f"""{q.bars(5, 'c5m')}, {q.atr('c5m', 'cv')}, ce AS (SELECT symbol AS es, {_near('vol_ratio', '(1.0::DOUBLE / 3)')} AS lo, {_near('vol_ratio', '(2.0::DOUBLE / 3)')} AS hi FROM cv GROUP BY symbol),
cvb AS (SELECT symbol AS bs, ts_utc AS bt, CASE WHEN vol_ratio IS NULL OR lo IS NULL THEN 'mid' WHEN vol_ratio < lo THEN 'low' WHEN vol_ratio < hi THEN 'mid' ELSE 'high' END AS bucket FROM cv LEFT JOIN ce ON symbol = es)"""
_KEYS = f"""{_BUCKETS}, keys0 AS (SELECT *, CASE WHEN spread_points > 0 THEN spread_points END AS lv FROM m1),
keys AS (SELECT symbol, ts_utc, open, high, low, close, CAST(date_part('hour', ts_utc) AS INTEGER) AS hour_utc, CAST(isodow(ts_utc) AS INTEGER) AS dow, {_ROLL} AS in_rollover_window, lv IS NULL AS level_imputed,
  coalesce(last_value(lv IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(lv IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_utc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level, coalesce(cvb.bucket, 'mid') AS vol_bucket FROM keys0 LEFT JOIN cvb ON cvb.bs = symbol AND cvb.bt = time_bucket(INTERVAL '5 minutes', ts_utc))"""
register("spread_bar_keys", f"WITH {q.M1}, {_KEYS} SELECT symbol, ts_utc, hour_utc, dow, in_rollover_window, level_imputed, level FROM keys")(lambda spark, d: costs.bar_keys(src.bars(spark, d, 1)).select("symbol", "ts_utc", "hour_utc", "dow", "in_rollover_window", "level_imputed", "level"))

_KEYED = f"{_HIST}, {_KEYS}, keyed AS (SELECT h.symbol, h.ts_utc, h.spread_points, h.seconds, hour_utc, dow, vol_bucket, round_even(h.spread_points / level, 4) AS ratio FROM hist h JOIN keys k ON h.symbol = k.symbol AND h.ts_utc = k.ts_utc)"


def _weighted(group: list[str], source: str, value: str) -> str:
    g = ", ".join(group)
    over = f"PARTITION BY {g}" if g else ""
    picks = ", ".join(f"min(CASE WHEN cf >= {s} - 1e-12 THEN {value} END) AS {n}" for n, s in costs.SHARES.items())
    return f"""SELECT {g + ', ' if g else ''}sum(wt) AS weight, sum({value} * wt) / sum(wt) AS mean, {picks} FROM (
  SELECT {g + ', ' if g else ''}{value}, wt, sum(wt) OVER ({over} ORDER BY {value}) / sum(wt) OVER ({over}) AS cf FROM (SELECT {g + ', ' if g else ''}{value}, sum(seconds) AS wt FROM {source} GROUP BY ALL)) {'GROUP BY ' + g if g else ''}"""


def histogram(spark, d):
    """The seconds that each spread was quoted, by minute, kept: the tape is windowed once."""
    return kept(spark, d, "histogram", lambda: costs.histogram(src.tape(spark, d)))


def _keyed(spark, d):
    """Quoted seconds, minute keys, and the histogram under the keys, all kept."""
    m1, hist = src.bars(spark, d, 1), histogram(spark, d)
    keys = kept(spark, d, "keys", lambda: costs.with_bar_bucket(costs.bar_keys(m1), src.aggregate(m1, 5)))
    return hist, keys, kept(spark, d, "keyed", lambda: costs.keyed_histogram(hist, keys))


@register("weighted_quantiles_hour", q.query(f"{_KEYED}, wq AS ({_weighted(['hour_utc'], 'keyed', 'spread_points')})", "wq", ["hour_utc", *(n for n in costs.SHARES)], ["weight", "mean"], places=4))
def weighted_quantiles_hour(spark, d):
    _, _, keyed = _keyed(spark, d)
    return rounded(quantiles.weighted(keyed, "spread_points", "seconds", costs.SHARES, ("hour_utc",)), 4).select("hour_utc", *costs.SHARES, "weight", "mean")


_LEVELS = ["SELECT 0 AS level, hour_utc, dow, vol_bucket, ratio, seconds FROM keyed", "SELECT 1, hour_utc, dow, 'all', ratio, seconds FROM keyed", "SELECT 2, hour_utc, -1, 'all', ratio, seconds FROM keyed", "SELECT 3, -1, -1, 'all', ratio, seconds FROM keyed"]
_CELLS = f"{_KEYED}, long AS ({' UNION ALL '.join(_LEVELS)}), cells AS (SELECT *, weight / 60 AS minutes FROM ({_weighted(['level', 'hour_utc', 'dow', 'vol_bucket'], 'long', 'ratio')}))"
_CELL = ["level", "hour_utc", "dow", "vol_bucket"]
register("spread_cells_rollup", q.query(_CELLS, "cells", _CELL, ["minutes", "mean", *costs.SHARES]))(lambda spark, d: rounded(costs.cells(_keyed(spark, d)[2])).select(*_CELL, "minutes", "mean", *costs.SHARES))

_LOOK = f"""{_CELLS}, good AS (SELECT * FROM cells WHERE minutes >= 60),
look AS (SELECT k.*, CASE WHEN c0.p50 IS NOT NULL THEN 0 WHEN c1.p50 IS NOT NULL THEN 1 WHEN c2.p50 IS NOT NULL THEN 2 WHEN c3.p50 IS NOT NULL THEN 3 END AS cell_level,
  {', '.join(f"CASE WHEN c0.p50 IS NOT NULL THEN c0.{p} WHEN c1.p50 IS NOT NULL THEN c1.{p} WHEN c2.p50 IS NOT NULL THEN c2.{p} ELSE c3.{p} END AS r_{p}" for p in costs.SHARES)}
FROM keys k LEFT JOIN good c0 ON c0.level = 0 AND c0.hour_utc = k.hour_utc AND c0.dow = k.dow AND c0.vol_bucket = k.vol_bucket LEFT JOIN good c1 ON c1.level = 1 AND c1.hour_utc = k.hour_utc AND c1.dow = k.dow
  LEFT JOIN good c2 ON c2.level = 2 AND c2.hour_utc = k.hour_utc LEFT JOIN good c3 ON c3.level = 3)"""


@register("spread_lookup_cascade", q.query(_LOOK, "look", ["symbol", "ts_utc", "cell_level"], [f"r_{p} AS {p}" for p in costs.SHARES]))
def spread_lookup_cascade(spark, d):
    _, keys, keyed = _keyed(spark, d)
    found = costs.lookup(keys.select("symbol", "ts_utc", "hour_utc", "dow", "vol_bucket"), staged(costs.cells(keyed), "cells"))
    return rounded(found.select("symbol", "ts_utc", F.col("level").alias("cell_level"), *costs.SHARES))


def _look(source: str, out: str, shares, k: str) -> str:
    """Quantiles of the finest good level of a cell table, for each minute key."""
    joins = " ".join(f"LEFT JOIN (SELECT * FROM {source} WHERE minutes >= 60) {k}{i} ON " + " AND ".join([f"{k}{i}.level = {i}", *(f"{k}{i}.{c} = ks.{c}" for c in keys)]) for i, keys in enumerate(costs.LEVELS))
    pick = lambda p: "CASE " + " ".join(f"WHEN {k}{i}.p50 IS NOT NULL THEN {k}{i}.{p}" for i in range(4)) + " END"
    return f"{out} AS (SELECT ks.symbol, ks.ts_utc, {', '.join(f'{pick(p)} AS {k}_{p}' for p in shares)} FROM keys ks {joins})"


#: Days of quotes that count as recent here; the table holds a month.
RECENT_DAYS = 10
_NOW = f"""nkeyed AS (SELECT * FROM keyed WHERE epoch(ts_utc) >= (SELECT epoch(max(ts_utc)) FROM hist) - {RECENT_DAYS} * 86400),
nlong AS ({' UNION ALL '.join(x.replace('FROM keyed', 'FROM nkeyed') for x in _LEVELS)}), ncells AS (SELECT *, weight / 60 AS minutes FROM ({_weighted(['level', 'hour_utc', 'dow', 'vol_bucket'], 'nlong', 'ratio')}))"""
_PRICED = f"""{_CELLS}, {_NOW}, {_look('cells', 'lka', costs.SHARES, 'a')}, {_look('ncells', 'lkn', ['p90'], 'n')},
mq AS (SELECT symbol AS ms, ts_utc AS mt, sum(spread_points * seconds) / sum(seconds) AS observed FROM hist GROUP BY symbol, ts_utc),
priced AS (SELECT keys.symbol, keys.ts_utc, level AS level_pts, in_rollover_window, least(observed, level * a_p25) AS spread_optimistic, coalesce(observed, level * a_p50) AS spread_base,
  greatest(observed, level * a_p90, level * n_p90, coalesce(observed, level * a_p50)) AS spread_pessimistic, CASE WHEN observed IS NOT NULL THEN 'measured' ELSE 'modeled' END AS spread_source
  FROM keys JOIN lka ON lka.symbol = keys.symbol AND lka.ts_utc = keys.ts_utc JOIN lkn ON lkn.symbol = keys.symbol AND lkn.ts_utc = keys.ts_utc LEFT JOIN mq ON keys.symbol = ms AND keys.ts_utc = mt)"""


def priced(spark, d):
    """Costs of all minutes, kept: measured where the tape has quotes, else by the cells; the pessimistic one at least the recent p90."""

    def build():
        hist, keys, keyed = _keyed(spark, d)
        recent = costs.cells(costs.current_window(keyed, RECENT_DAYS))
        return costs.price_bars(keys, costs.measured_minutes(hist), staged(costs.cells(keyed), "cells"), staged(recent, "cells"))

    return kept(spark, d, "costs", build)


_COST = ["spread_optimistic", "spread_base", "spread_pessimistic"]
register("price_bars_scenarios", q.query(_PRICED, "priced", ["symbol", "ts_utc", "level_pts", "spread_source", "in_rollover_window"], _COST))(lambda spark, d: rounded(priced(spark, d)).select("symbol", "ts_utc", "level_pts", "spread_source", "in_rollover_window", *_COST))
register("costs_to_m5", q.query(f"{_PRICED}, c5 AS (SELECT symbol, time_bucket(INTERVAL '5 minutes', ts_utc) AS ts_utc, {', '.join(f'arg_min({c}, ts_utc) AS {c}' for c in _COST)}, arg_min(spread_source, ts_utc) AS spread_source, bool_or(in_rollover_window) AS in_rollover_window FROM priced GROUP BY symbol, time_bucket(INTERVAL '5 minutes', ts_utc))", "c5", ["symbol", "ts_utc", "spread_source", "in_rollover_window"], _COST))(
    lambda spark, d: rounded(costs.to_m5(priced(spark, d))).select("symbol", "ts_utc", "spread_source", "in_rollover_window", *_COST)
)

register("abnormal_spread_full", q.query(f"""{q.M1}, {_KEYS}, u AS (SELECT *, coalesce(level / nullif(greatest({q.full('median', 'level', 1440, least=240)}, 0), 0), 1.0) AS level_ratio FROM keys),
p AS (SELECT symbol AS ps, hour_utc AS ph, {_near('level_ratio', '0.99')} AS p99 FROM u GROUP BY symbol, hour_utc), x AS (SELECT *, coalesce(level_ratio > p99, false) AS abnormal FROM u LEFT JOIN p ON symbol = ps AND hour_utc = ph)""", "x", ["symbol", "ts_utc", "abnormal"], ["level_ratio", "p99"]))(
    lambda spark, d: rounded(costs.flag_abnormal(costs.bar_keys(src.bars(spark, d, 1)).select("symbol", "ts_utc", "hour_utc", F.col("level").cast("double").alias("level")), 1440, 240).select("symbol", "ts_utc", "abnormal", "level_ratio", "p99"))
)


@register("current_window", f"WITH {_HIST} SELECT symbol, CAST(ts_utc AS DATE) AS day, count(*) AS n FROM hist WHERE epoch(ts_utc) >= (SELECT epoch(max(ts_utc)) FROM hist) - 10 * 86400 GROUP BY ALL")
def current_window(spark, d):
    return costs.current_window(costs.histogram(src.tape(spark, d)), 10).groupBy("symbol", F.to_date("ts_utc").alias("day")).agg(F.count("*").alias("n"))


_SLIPS = "VALUES ('optimistic', 0.0, 0.0, 1.0), ('base', 2.0, 0.01, 2.0), ('pessimistic', 5.0, 0.02, 3.0)"


@register("slippage_scenarios", q.query(f"{q.V5}, s(scenario, fixed, share, factor) AS ({_SLIPS}), x AS (SELECT symbol, ts_utc, scenario, CAST(fixed AS DOUBLE) + share * greatest(coalesce(atr_pts, 0), 0) AS market, 0.0::DOUBLE AS limit_order, (CAST(fixed AS DOUBLE) + share * greatest(coalesce(atr_pts, 0), 0)) * CASE WHEN {_ROLL} THEN factor ELSE 1 END AS stop FROM v CROSS JOIN s)", "x", ["symbol", "ts_utc", "scenario"], ["market", "limit_order", "stop"]))
def slippage_scenarios(spark, d):
    b = costs.average_range(src.bars(spark, d, 5))
    one = lambda s: F.struct(F.lit(s).alias("scenario"), *(costs.slippage(s, o, F.col("atr_pts"), cal.in_rollover(F.col("ts_utc"))).alias(n) for o, n in (("market", "market"), ("limit", "limit_order"), ("stop", "stop"))))
    return rounded(b.select("symbol", "ts_utc", F.explode(F.array(*map(one, costs.SLIPPAGE))).alias("s")).select("symbol", "ts_utc", "s.*"))


@register("swap_nights", """WITH t AS (SELECT o_orderkey, o_orderdate + (o_orderkey % 1440) * INTERVAL '1 minute' AS entry, o_orderdate + ((o_orderkey % 1440) + (o_custkey % 14400)) * INTERVAL '1 minute' AS leave FROM orders),
d AS (SELECT t.*, unnest(generate_series(CAST(entry AS DATE) - 2, CAST(leave AS DATE) + 2, INTERVAL 1 DAY)) AS day FROM t),
r AS (SELECT *, ((CAST(day AS TIMESTAMP) + INTERVAL '1020 minutes') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS roll FROM d)
SELECT o_orderkey, CAST(coalesce(sum(CASE WHEN isodow(day) >= 6 THEN 0 WHEN isodow(day) = 3 THEN 3 ELSE 1 END) FILTER (roll > entry AND roll <= leave), 0) AS INTEGER) AS nights FROM r GROUP BY o_orderkey""")
def swap_nights(spark, d):
    o = src.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    entry = cal.plus_minutes(F.col("at"), F.pmod("o_orderkey", F.lit(1440)).cast("int"))
    o = o.withColumn("entry", entry).withColumn("leave", cal.plus_minutes(F.col("entry"), F.pmod("o_custkey", F.lit(14400)).cast("int")))
    return o.select("o_orderkey", costs.swap_nights(F.col("entry"), F.col("leave")).cast("int").alias("nights"))


def _cells_of(source: str, value: str, p: str) -> str:
    levels = " UNION ALL ".join(f"SELECT {i} AS level, {'hour_utc' if 'hour_utc' in k else '-1'} AS hour_utc, {'dow' if 'dow' in k else '-1'} AS dow, {'vol_bucket' if 'vol_bucket' in k else chr(39) + 'all' + chr(39)} AS vol_bucket, {value}, seconds FROM {source}" for i, k in enumerate(costs.LEVELS))
    return f"{p}long AS ({levels}), {p}cells AS (SELECT *, weight / 60 AS minutes FROM ({_weighted(['level', 'hour_utc', 'dow', 'vol_bucket'], p + 'long', value)}))"


_HELD = f"""{_KEYED}, dy AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT DISTINCT symbol, CAST(ts_utc AS DATE) AS day FROM hist)),
cut AS (SELECT symbol AS cs, day AS cut FROM dy WHERE k = floor(n * (1 - 0.2))), early AS (SELECT keyed.* FROM keyed JOIN cut ON cs = symbol WHERE CAST(ts_utc AS DATE) < cut),
{_cells_of('early', 'ratio', 'vr')}, {_cells_of('early', 'spread_points', 'va')}, {_look('vrcells', 'lvr', ['p50', 'p90'], 'r')}, {_look('vacells', 'lva', ['p50', 'p90'], 'b')},
held AS (SELECT h.symbol, h.ts_utc, spread_mean, level * r_p50 AS ratio_p50, level * r_p90 AS ratio_p90, b_p50 * 1.0 AS abs_p50, b_p90 * 1.0 AS abs_p90
  FROM (SELECT hist.symbol, ts_utc, sum(spread_points * seconds) / sum(seconds) AS spread_mean FROM hist JOIN cut ON cs = symbol WHERE CAST(ts_utc AS DATE) >= cut GROUP BY hist.symbol, ts_utc) h
  JOIN keys k ON k.symbol = h.symbol AND k.ts_utc = h.ts_utc JOIN lvr ON lvr.symbol = h.symbol AND lvr.ts_utc = h.ts_utc JOIN lva ON lva.symbol = h.symbol AND lva.ts_utc = h.ts_utc)"""
_METRICS = " UNION ALL ".join(f"""SELECT symbol, '{m}' AS model, count(*) AS n, (avg({m}_p50) - avg(spread_mean)) / avg(spread_mean) AS bias, avg(abs({m}_p50 - spread_mean)) AS mae, avg(CAST(spread_mean <= {m}_p90 + 1e-9 AS DOUBLE)) AS coverage_p90
  FROM held WHERE {m}_p50 IS NOT NULL GROUP BY symbol""" for m in ("ratio", "abs"))  # fmt: skip


def _held(spark, d):
    hist, keys, _ = _keyed(spark, d)
    return costs.validate(hist, keys)


register("spread_validation", q.query(f"{_HELD}, vm AS ({_METRICS})", "vm", ["symbol", "model", "n", "abs(bias) <= 0.15 AND coverage_p90 >= 0.85 AS accepted"], ["bias", "mae", "coverage_p90"], places=4))(lambda spark, d: rounded(costs.validation_metrics(_held(spark, d)), 4))
register("spread_validation_weekly", q.query(f"{_HELD}, wk AS (SELECT symbol, CAST(date_trunc('week', ts_utc) AS TIMESTAMP) AS week, avg(spread_mean) AS measured, avg(ratio_p50) AS level_x_ratio, avg(abs_p50) AS abs_cells FROM held GROUP BY ALL)", "wk", ["symbol", "week"], ["measured", "level_x_ratio", "abs_cells"], places=4))(
    lambda spark, d: rounded(costs.weekly_errors(_held(spark, d)), 4)
)
register("spread_impossible_share", q.query(f"{_KEYED}, {_cells_of('keyed', 'spread_points', 'ia')}, {_look('iacells', 'lia', ['p50'], 'i')}, im AS (SELECT keys.symbol, count(*) AS n, avg(CAST(i_p50 < level AS DOUBLE)) AS share_below_level, median(i_p50 / {q.pos('level')}) AS median_p50_over_level FROM keys JOIN lia ON lia.symbol = keys.symbol AND lia.ts_utc = keys.ts_utc WHERE keys.ts_utc < TIMESTAMP '2024-01-16' GROUP BY keys.symbol)", "im", ["symbol", "n"], ["share_below_level", "median_p50_over_level"]))(
    lambda spark, d: rounded(costs.impossible_share(_keyed(spark, d)[1], "2024-01-16 00:00:00", staged(costs.cells(_keyed(spark, d)[2], "spread_points"), "cells")))
)


@register("heatmap_hour_dow", """SELECT CAST(isodow(ts) AS INTEGER) AS dow, """ + ", ".join(f"round(avg(value) FILTER (date_part('hour', ts) = {h}), 6) AS h{h}" for h in range(24)) + " FROM events GROUP BY 1")
def heatmap_hour_dow(spark, d):
    t = src.tape(spark, d).select("bid", cal.iso_weekday(F.col("ts_utc")).alias("dow"), F.hour("ts_utc").alias("hour"))
    grid = t.groupBy("dow").pivot("hour", list(range(24))).agg(F.round(F.avg("bid"), 6))
    return grid.select("dow", *(F.col(f"`{h}`").alias(f"h{h}") for h in range(24)))


@register("candles_page", f"WITH {q.M5}, p AS (SELECT symbol, ts_utc, open, high, low, close FROM m5 WHERE ts_utc < TIMESTAMP '2024-01-20 12:00:00' ORDER BY ts_utc DESC LIMIT 301) SELECT * FROM (SELECT *, count(*) OVER () > 300 AS has_more, row_number() OVER (ORDER BY ts_utc DESC) AS k FROM p) WHERE k <= 300")
def candles_page(spark, d):
    """The page of 300 bars before a cursor, and whether there are more."""
    page = src.bars(spark, d, 5).where(F.col("ts_utc") < F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")).select("symbol", "ts_utc", "open", "high", "low", "close").orderBy(F.desc("ts_utc")).limit(301)
    from pyspark.sql import Window

    w = Window.partitionBy("symbol")
    out = page.withColumns({"has_more": F.count("*").over(w) > 300, "k": F.row_number().over(w.orderBy(F.desc("ts_utc"))).cast("long")})
    return out.where("k <= 300")


@register("topk_gaps", f"WITH {_GAPS} SELECT after, minutes, category FROM c ORDER BY minutes DESC, after LIMIT 15")
def topk_gaps(spark, d):
    return quality.classify_gaps(src.bars(spark, d, 1)).orderBy(F.desc("minutes"), "after").limit(15).select("after", "minutes", "category")
