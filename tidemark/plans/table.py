"""The whole feature table: 163 causal columns of five-minute bars, from minute bars alone."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators.windows import PLACE
from tidemark.plans import features, quality, store, structure
from tidemark.sources import tape as src
from tidemark.sources.manifest import staged

KEY = ["symbol", "ts_utc"]


#: The features by group.
GROUPS: dict[str, list[str]] = {
    "anatomy": [
        "dir", "range_pts", "body_frac", "upper_wick_frac", "lower_wick_frac", "close_loc", "range_atr", "body_atr", "upper_wick_atr",
        "lower_wick_atr", "gap_atr", "ret_atr", "tick_volume", "volume_rel",
    ],
    "sequence": [
        "dir_lag1", "dir_lag2", "dirs_3", "body_atr_lag1", "close_loc_lag1", "range_atr_lag1", "streak", "up_count_5", "up_count_10", "ret3_atr",
        "ret5_atr", "ret10_atr", "ret20_atr", "inside_bar", "outside_bar", "inside_streak", "higher_high", "lower_low", "higher_low", "lower_high",
        "compression", "dist_high20_atr", "dist_low20_atr", "pos_in_range20", "bars_since_week_open",
    ],
    "volatility": [
        "atr_pts", "vol_ratio", "vol_regime", "rv20_bps",
    ],
    "session": [
        "session", "in_tokyo", "in_london", "in_new_york", "min_since_tokyo_open", "min_since_london_open", "min_since_ny_open", "min_to_rollover",
        "hour_utc", "dow",
    ],
    "daily": [
        "dist_day_open_atr", "day_range_atr", "pos_in_day_range", "dist_prev_high_atr", "dist_prev_low_atr", "dist_prev_close_atr", "pdh_sweep",
        "pdl_sweep", "pdh_sweep_depth_atr", "pdl_sweep_depth_atr", "pdh_sweeps_today", "pdl_sweeps_today", "pdh_accepted_before",
        "pdl_accepted_before",
    ],
    "m15": [
        "m15_dir", "m15_body_atr", "m15_close_loc", "m15_range_atr", "m15_ret4_atr", "m15_trend_atr", "m15_slope_atr", "m15_streak", "m15_atr_pts",
        "pos_in_m15_prev",
    ],
    "h1": [
        "h1_dir", "h1_body_atr", "h1_close_loc", "h1_range_atr", "h1_ret4_atr", "h1_trend_atr", "h1_slope_atr", "h1_streak", "h1_atr_pts",
        "pos_in_h1_prev",
    ],
    "structure": [
        "sw_hi_dist_atr", "sw_lo_dist_atr", "sw_hi_age", "sw_lo_age", "sw_trend", "rng_width_atr", "rng_pos", "sw_break_up", "sw_break_down",
        "bars_since_break_up", "bars_since_break_down", "retest_up", "retest_down", "failed_break_up", "failed_break_down", "sweep_high", "sweep_low",
        "sweep_depth_atr", "sr_above_dist_atr", "sr_above_touches", "sr_below_dist_atr", "sr_below_touches", "sr_above_high_dist_atr",
        "sr_below_low_dist_atr", "tl_up_dist_atr", "tl_up_slope_atr", "tl_up_touches", "tl_up_break", "tl_dn_dist_atr", "tl_dn_slope_atr",
        "tl_dn_touches", "tl_dn_break", "ch_up_pos", "ch_dn_pos", "ch_width_atr", "h1_sw_trend", "h1_sw_hi_dist_atr", "h1_sw_lo_dist_atr",
    ],
    "indicators": [
        "bb_pctb", "bb_width_atr", "bb_mid_dist_atr", "bb_close_above_upper", "bb_close_below_lower", "bb_high_above_upper", "bb_low_below_lower",
        "ema9_dist_atr", "ema21_dist_atr", "ema50_dist_atr", "ema200_dist_atr", "ema50_slope_atr", "ema200_slope_atr", "ema9_21_cross", "ema_stack",
        "rsi14", "macd_atr", "macd_signal_atr", "macd_hist_atr", "macd_cross", "stoch_k14", "stoch_d3", "adx14", "plus_di14", "minus_di14",
        "vwap_dist_atr", "obv_flow20",
    ],
    "spread": [
        "spread_pts", "spread_rel",
    ],
    "hygiene": [
        "hyg_rollover", "hyg_abnormal_spread", "hyg_week_first3", "hyg_week_last3", "hyg_weekend_gap", "hyg_spans_weekend_gap", "hyg_incomplete",
        "gap_before_min", "hyg_no_entry",
    ],
}
FEATURES = [c for columns in GROUPS.values() for c in columns]
#: What comes with them.
META = ["event_time", "available_at", "ts_server", "trading_day", "m15_close_utc", "h1_close_utc"]
WANTED = {*FEATURES, *META}


BASE = ["open", "high", "low", "close", "tick_volume", "m1_bars", "atr", "atr_pts", "vol_ratio", "event_time", "available_at"]
#: Groups that are made at the same time: independent jobs over the same bars.
AT_ONCE = 4


def whole(minute: DataFrame, clock_hours: float = 0.0) -> DataFrame:
    """KEY, the prices, META and FEATURES. ``clock_hours``: how far the server's clock is ahead of UTC.

    Each group reads the written bars, is written with its own columns and joined by the bar, so no plan is deeper than a
    group's own and a lost executor costs a group at most.
    """
    five = staged(features.with_atr(src.aggregate(minute, 5)).select(*KEY, *BASE, PLACE), "bars")
    hour = src.aggregate(minute, 60)
    groups = {
        "candles": lambda: features.sequence(features.anatomy(five)),
        "bands": lambda: features.obv(features.stochastic(features.bollinger(five))),
        "swings": lambda: structure.break_features(structure.swing_features(five)),
        "days": lambda: features.vwap(features.daily(five)),
        "volatility": lambda: features.volatility(five),
        "m15": lambda: features.higher(five, src.aggregate(minute, 15), 15, "m15"),
        "h1": lambda: features.higher(five, hour, 60, "h1"),
        "h1-swings": lambda: structure.h1_features(five, hour),
        "averages": lambda: features.averages(five),
        "levels": lambda: structure.level_features(five),
        "lines": lambda: structure.line_features(five),
        "spread": lambda: features.minute_spread(minute),
    }

    def make(item) -> DataFrame:
        name, group = item
        df = group()
        return staged(df.select(*KEY, *(c for c in df.columns if c in WANTED and c not in BASE)), name)

    with ThreadPoolExecutor(AT_ONCE) as pool:
        parts = list(pool.map(make, groups.items()))
    b = five
    for part in parts:
        b = b.join(part, KEY, "left")
    b = features.hygiene(features.session(b)).withColumn("ts_server", cal.plus_minutes(F.col("ts_utc"), int(60 * clock_hours)))
    return b.select(*KEY, "open", "high", "low", "close", "m1_bars", *META, *FEATURES)


def in_research_window(table: DataFrame, minute: DataFrame) -> DataFrame:
    """The table with in_research_window: from the first bar of the first full week. It looks at the whole history, so it is no feature."""
    starts = quality.research_window(minute).groupBy("symbol").agg(F.min("starts").alias("_starts"))
    return table.join(starts, "symbol", "left").withColumn("in_research_window", F.coalesce(F.col("event_time") >= F.col("_starts"), F.lit(False))).drop("_starts")


def cutoffs(start: datetime, end: datetime) -> list[datetime]:
    """When to cut histories for the self-check: Wednesdays at 14:37, amid bars of every length.

    The Wednesday on or before each fifth of the way, and the last one that is over.
    """
    days_back = lambda t: (t.weekday() - 2) % 7
    points = [start + (end - start) * k / 5 for k in range(1, 5)]
    found = [t - timedelta(days=days_back(t)) for t in points] + [end - timedelta(days=days_back(end) or 7)]
    return [t.replace(hour=14, minute=37, second=0, microsecond=0) for t in found]


def self_check(minute: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """check, column, mismatches: the recomputation at every cutoff, the perturbation after the last; all must be 0."""
    at = [t.strftime("%Y-%m-%d %H:%M:%S") for t in cutoffs(start, end)]
    table = staged(whole(minute), "features")
    found = [staged(store.differences(store.as_of(table, t), store.as_of(whole(store.known_minutes(minute, t)), t)), "check").select(F.lit("recompute").alias("check"), "column", "mismatches") for t in at]
    found.append(store.differences(store.as_of(table, at[-1]), store.as_of(whole(store.perturb_after(minute, at[-1])), at[-1])).select(F.lit("perturb").alias("check"), "column", "mismatches"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("check", "column").agg(F.sum("mismatches").alias("mismatches"))


class FeatureGateError(RuntimeError):
    """A feature looks ahead, so nothing was written."""


def build(minute: DataFrame, path: str, start: datetime, end: datetime) -> dict:
    """Write the table as a new version, but only if the self-check finds nothing."""
    from tidemark.sources import manifest

    bad = self_check(minute, start, end).where("mismatches > 0").limit(20).collect()
    if bad:
        raise FeatureGateError(", ".join(f"{r['check']}: {r['column']} ({r['mismatches']})" for r in bad))
    return manifest.write(in_research_window(whole(minute), minute), path)


def null_shares(table: DataFrame) -> DataFrame:
    """name, nulls, share: one row a column, in one pass over the table."""
    counts = table.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in table.columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("nulls")) for c in table.columns)))
    return counts.select("_n", rows.alias("r")).select("r.*", (F.col("r.nulls") / F.when(F.col("_n") > 0, F.col("_n"))).alias("share"))


def summary(table: DataFrame) -> DataFrame:
    """section, name, n, share: bars under each hygiene flag, of each session and of each volatility regime."""
    flags = [c for c in GROUPS["hygiene"] if c != "gap_before_min"]
    items = [F.struct(F.lit("hygiene").alias("section"), F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit(False)).alias("on")) for c in flags]
    items += [F.struct(F.lit(c).alias("section"), F.coalesce(F.col(c), F.lit("unknown")).alias("name"), F.lit(True).alias("on")) for c in ("session", "vol_regime")]
    n = table.groupBy("symbol").agg(F.count("*").alias("_all"))
    rows = table.select("symbol", F.explode(F.array(*items)).alias("i")).select("symbol", "i.*").groupBy("symbol", "section", "name").agg(F.count_if("on").alias("n"))
    return rows.join(n, "symbol").select("symbol", "section", "name", "n", (F.col("n") / F.col("_all")).alias("share"))
