"""The feature table: strictly causal columns of five-minute bars. Each group is a function from DataFrame to DataFrame.

Input bars: symbol, ts_utc, open, high, low, close, tick_volume, m1_bars; ``with_atr`` adds atr, atr_pts, vol_ratio,
event_time and available_at. Denominators that are not above zero give null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.scalar import positive, ratio, sign_of, truth
from tidemark.operators import scan
from tidemark.operators import windows as win
from tidemark.operators.asof import asof
from tidemark.operators.ewm import ewm, span, wilder
from tidemark.plans import costs
from tidemark.sources.manifest import staged
from tidemark.sources.tape import POINT

BAR_MINUTES = 5


def columns(*names: str) -> list[Column]:
    return [F.col(c) for c in names]


def atr(x: Column) -> Column:
    return x / positive(F.col("atr"))


def with_atr(bars: DataFrame, ratio_too: bool = True, **parameters) -> DataFrame:
    bars = win.placed(bars)
    out = costs.volatility(bars, **parameters) if ratio_too else costs.average_range(bars, **parameters)
    return out.withColumns({"event_time": F.col("ts_utc"), "available_at": cal.plus_minutes(F.col("ts_utc"), BAR_MINUTES)})


def anatomy(b: DataFrame, median_rows: int = 288, least: int = 48) -> DataFrame:
    return win.by_chunks(b, median_rows, lambda b: _anatomy(b, median_rows, least))


def _anatomy(b: DataFrame, median_rows: int, least: int) -> DataFrame:
    O, H, L, C = columns("open", "high", "low", "close")  # noqa: E741
    w = win.over()
    b = b.withColumns({
        "dir": sign_of(C - O), "range_pts": (H - L) / POINT, "body_frac": ratio(F.abs(C - O), H - L),
        "upper_wick_frac": ratio(H - F.greatest(O, C), H - L), "lower_wick_frac": ratio(F.least(O, C) - L, H - L), "close_loc": ratio(C - L, H - L),
        "range_atr": atr(H - L), "body_atr": atr(C - O), "upper_wick_atr": atr(H - F.greatest(O, C)), "lower_wick_atr": atr(F.least(O, C) - L),
        "gap_atr": atr(O - F.lag(C).over(w)), "ret_atr": atr(C - F.lag(C).over(w)),
    })
    volume = F.col("tick_volume").cast("double")
    return b.withColumn("volume_rel", ratio(volume, win.median(volume, w, median_rows, least=least)))


def sequence(b: DataFrame) -> DataFrame:
    """Needs anatomy. The runs go over all bars, the rest looks back on some."""
    b = win.placed(scan.run_length(b, "dir", "_run")).withColumn("_rn", F.col(win.PLACE))
    b = staged(win.by_chunks(b, 21, _sequence), "sequence")
    b = scan.run_length(b, "inside_bar", "_inside").withColumn("inside_streak", F.when(truth(F.col("inside_bar")), F.col("_inside")).otherwise(0).cast("int")).drop("_inside")
    b = scan.scan(b, {"_opened": (scan.MAX, F.when((F.col("_gap") > 1440) | (F.col("_rn") == 0), F.col("_rn")))})
    return b.withColumns({"bars_since_week_open": (F.col("_rn") - F.col("_opened")).cast("int"), "gap_before_min": F.col("_gap").cast("int")}).drop("_gap", "_rn", "_opened")


def _sequence(b: DataFrame) -> DataFrame:
    H, L, C = columns("high", "low", "close")
    w = win.over()
    code = lambda c: F.when(c > 0, "U").when(c < 0, "D").when(c == 0, "-")
    b = b.withColumns({
        "dir_lag1": F.lag("dir", 1).over(w), "dir_lag2": F.lag("dir", 2).over(w), "body_atr_lag1": F.lag("body_atr").over(w), "close_loc_lag1": F.lag("close_loc").over(w),
        "range_atr_lag1": F.lag("range_atr").over(w), "streak": (F.col("_run") * F.col("dir")).cast("int"),
        **{f"up_count_{n}": win.total((F.col("dir") == 1).cast("int"), w, n).cast("int") for n in (5, 10)},
        **{f"ret{n}_atr": atr(C - F.lag(C, n).over(w)) for n in (3, 5, 10, 20)},
        "inside_bar": (H <= F.lag(H).over(w)) & (L >= F.lag(L).over(w)), "outside_bar": (H > F.lag(H).over(w)) & (L < F.lag(L).over(w)),
        "higher_high": H > F.lag(H).over(w), "lower_low": L < F.lag(L).over(w), "higher_low": L > F.lag(L).over(w), "lower_high": H < F.lag(H).over(w),
        "compression": ratio(win.mean(H - L, w, 5), win.mean(H - L, w, 20)),
        "_top": win.highest(H, w, 20), "_bottom": win.lowest(L, w, 20),
        "_gap": F.coalesce(cal.minutes_between(F.lag("ts_utc").over(w), F.col("ts_utc")) - BAR_MINUTES, F.lit(0)),
    }).drop("_run")
    b = b.withColumn("dirs_3", F.concat(code(F.col("dir_lag2")), code(F.col("dir_lag1")), code(F.col("dir"))))
    b = b.withColumns({"dist_high20_atr": atr(F.col("_top") - C), "dist_low20_atr": atr(C - F.col("_bottom")), "pos_in_range20": ratio(C - F.col("_bottom"), F.col("_top") - F.col("_bottom"))})
    return b.drop("_top", "_bottom")


def regime_edges(b: DataFrame, value: str = "vol_ratio", look_back_days: int = 365, least: int = 2880, unit: str = "month") -> DataFrame:
    """symbol, period, low_edge, high_edge: nearest-rank thirds of the days before each period starts.

    Values are counted by day first; a day's counts go to the periods that look back on it.
    """
    periods = b.select("symbol", F.date_trunc(unit, "ts_utc").cast("timestamp_ntz").alias("period")).distinct()
    daily = b.where(F.col(value).isNotNull()).groupBy("symbol", F.to_date("ts_utc").alias("day"), value).agg(F.count("*").alias("_n"))
    day = F.col("day").cast("timestamp_ntz")
    reach = (day < F.col("period")) & (cal.seconds(day) >= cal.seconds(F.col("period")) - look_back_days * 86_400)
    seen = daily.join(periods, ["symbol"]).where(reach).groupBy("symbol", "period", value).agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy("symbol", "period")
    seen = seen.withColumn("_to", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    at = lambda q: F.min(F.when(F.col("_to") > F.bround(q * (F.col("_all") - 1), 0), F.col(value)))
    return seen.where(F.col("_all") >= least).groupBy("symbol", "period").agg(at(F.lit(1 / 3)).alias("low_edge"), at(F.lit(2 / 3)).alias("high_edge"))


def volatility(b: DataFrame, look_back_days: int = 365, least: int = 2880, unit: str = "month") -> DataFrame:
    C = F.col("close")
    edges = regime_edges(b, "vol_ratio", look_back_days, least, unit)

    def realised(b: DataFrame) -> DataFrame:
        w = win.over()
        b = b.withColumn("_log", F.when((C > 0) & (F.lag(C).over(w) > 0), F.log(C / F.lag(C).over(w))))
        return b.withColumn("rv20_bps", win.std(F.col("_log"), w, 20) * 1e4)

    b = win.by_chunks(b.withColumn("period", F.date_trunc(unit, "ts_utc").cast("timestamp_ntz")), 21, realised)
    b = b.join(edges, ["symbol", "period"], "left")
    return b.withColumn("vol_regime", costs.bucket(F.col("vol_ratio"), F.col("low_edge"), F.col("high_edge"), None)).drop("period", "_log", "low_edge", "high_edge")


def session(b: DataFrame) -> DataFrame:
    t = F.col("ts_utc")
    return b.withColumns({
        "session": cal.session_label(t), **{f"in_{k}": cal.in_hours(t, *v) for k, v in cal.SESSIONS.items()},
        "min_since_tokyo_open": cal.minutes_since(t, cal.TOKYO, 540), "min_since_london_open": cal.minutes_since(t, cal.LONDON, 480),
        "min_since_ny_open": cal.minutes_since(t, cal.NEW_YORK, 480), "min_to_rollover": cal.minutes_to_roll(t), "hour_utc": F.hour(t), "dow": cal.iso_weekday(t),
    })


def previous_day(b: DataFrame) -> DataFrame:
    """symbol, trading_day, prev_high, prev_low, prev_close: those of the trading day before."""
    days = b.groupBy("symbol", "trading_day").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "ts_utc").alias("c"))
    w = Window.partitionBy("symbol").orderBy("trading_day")
    return days.select("symbol", "trading_day", *(F.lag(c).over(w).alias(n) for c, n in (("h", "prev_high"), ("l", "prev_low"), ("c", "prev_close"))))


def daily(b: DataFrame) -> DataFrame:
    O, H, L, C = columns("open", "high", "low", "close")  # noqa: E741
    b = b.withColumn("trading_day", cal.trading_day(F.col("ts_utc")))
    b = b.join(previous_day(b), ["symbol", "trading_day"], "left")
    w = win.over(("symbol", "trading_day"))
    hi, lo = win.so_far(F.max, H, w), win.so_far(F.min, L, w)
    pdh, pdl = F.col("prev_high"), F.col("prev_low")
    b = b.withColumns({
        "dist_day_open_atr": atr(C - F.first(O).over(w.rowsBetween(Window.unboundedPreceding, 0))), "day_range_atr": atr(hi - lo), "pos_in_day_range": ratio(C - lo, hi - lo),
        "dist_prev_high_atr": atr(C - pdh), "dist_prev_low_atr": atr(C - pdl), "dist_prev_close_atr": atr(C - F.col("prev_close")),
        "pdh_sweep": truth((H > pdh) & (C < pdh)), "pdl_sweep": truth((L < pdl) & (C > pdl)),
        "pdh_accepted_before": truth(win.before(F.max, truth(C > pdh), w)), "pdl_accepted_before": truth(win.before(F.max, truth(C < pdl), w)),
    })
    return b.withColumns({
        "pdh_sweep_depth_atr": F.when(F.col("pdh_sweep"), atr(H - pdh)), "pdl_sweep_depth_atr": F.when(F.col("pdl_sweep"), atr(pdl - L)),
        "pdh_sweeps_today": win.so_far(F.sum, F.col("pdh_sweep").cast("int"), w).cast("int"), "pdl_sweeps_today": win.so_far(F.sum, F.col("pdl_sweep").cast("int"), w).cast("int"),
    })


def higher_bars(b: DataFrame, minutes: int, prefix: str) -> DataFrame:
    """Features of the longer bars themselves, on their own ATR, which takes in the closed bar; keyed by their close."""
    C, O = F.col("close"), F.col("open")  # noqa: E741
    b = scan.run_length(b.withColumn("_dir", sign_of(C - O)), "_dir", "_run")
    return win.by_chunks(b, 26, lambda b: _higher_bars(b, minutes, prefix))


def _higher_bars(b: DataFrame, minutes: int, prefix: str) -> DataFrame:
    O, H, L, C = columns("open", "high", "low", "close")  # noqa: E741
    w = win.over()
    b = b.withColumn("_tr", costs.true_range(w))
    b = b.withColumns({"_atr": win.mean(F.col("_tr"), w, 14), "_sma": win.mean(C, w, 20)})
    a = positive(F.col("_atr"))
    return b.select(
        "symbol", cal.plus_minutes(F.col("ts_utc"), minutes).alias(f"{prefix}_close_utc"), F.col("_dir").alias(f"{prefix}_dir"), ((C - O) / a).alias(f"{prefix}_body_atr"),
        ratio(C - L, H - L).alias(f"{prefix}_close_loc"), ((H - L) / a).alias(f"{prefix}_range_atr"), ((C - F.lag(C, 4).over(w)) / a).alias(f"{prefix}_ret4_atr"),
        ((C - F.col("_sma")) / a).alias(f"{prefix}_trend_atr"), ((F.col("_sma") - F.lag("_sma", 5).over(w)) / a).alias(f"{prefix}_slope_atr"),
        (F.col("_run") * F.col("_dir")).cast("int").alias(f"{prefix}_streak"), (F.col("_atr") / POINT).alias(f"{prefix}_atr_pts"), L.alias("_l"), H.alias("_h"), *(c for c in ("chunk", "warm_up") if c in b.columns),
    )


def higher(b: DataFrame, longer: DataFrame, minutes: int, prefix: str) -> DataFrame:
    """The last longer bar that is closed when the bar is."""
    C = F.col("close")
    right = higher_bars(longer, minutes, prefix)
    columns = [c for c in right.columns if c != "symbol"]
    out = asof(b, right, "available_at", f"{prefix}_close_utc", columns)
    return out.withColumn(f"pos_in_{prefix}_prev", ratio(C - F.col("_l"), F.col("_h") - F.col("_l"))).drop("_l", "_h")


def bollinger(b: DataFrame, n: int = 50, width: float = 2.1) -> DataFrame:
    return win.by_chunks(b, n, lambda b: _bollinger(b, n, width))


def _bollinger(b: DataFrame, n: int, width: float) -> DataFrame:
    H, L, C = columns("high", "low", "close")
    w = win.over()
    b = b.withColumns({"_mid": win.mean(C, w, n), "_band": width * win.std(C, w, n, sample=False)})
    up, lo = F.col("_mid") + F.col("_band"), F.col("_mid") - F.col("_band")
    return b.withColumns({
        "bb_pctb": ratio(C - lo, up - lo), "bb_width_atr": atr(up - lo), "bb_mid_dist_atr": atr(C - F.col("_mid")), "bb_close_above_upper": C > up,
        "bb_close_below_lower": C < lo, "bb_high_above_upper": H > up, "bb_low_below_lower": L < lo,
    }).drop("_mid", "_band")


def stochastic(b: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    return win.by_chunks(b, n + smooth, lambda b: _stochastic(b, n, smooth))


def _stochastic(b: DataFrame, n: int, smooth: int) -> DataFrame:
    H, L, C = columns("high", "low", "close")
    w = win.over()
    lo = win.lowest(L, w, n)
    b = b.withColumn("stoch_k14", 100 * ratio(C - lo, win.highest(H, w, n) - lo))
    return b.withColumn("stoch_d3", win.mean(F.col("stoch_k14"), w, smooth))


def vwap(b: DataFrame) -> DataFrame:
    H, L, C = columns("high", "low", "close")
    b = b if "trading_day" in b.columns else b.withColumn("trading_day", cal.trading_day(F.col("ts_utc")))
    w = win.over(("symbol", "trading_day"))
    v = F.col("tick_volume")
    return b.withColumn("vwap_dist_atr", atr(C - ratio(win.so_far(F.sum, (H + L + C) / 3 * v, w), win.so_far(F.sum, v, w))))


def obv(b: DataFrame, n: int = 20) -> DataFrame:
    """The flow over n bars needs no running total: it is the signed volume of those bars over their volume."""
    return win.by_chunks(b, n + 1, lambda b: _obv(b, n))


def _obv(b: DataFrame, n: int) -> DataFrame:
    C = F.col("close")
    w = win.over()
    v = F.col("tick_volume")
    b = b.withColumn("_signed", F.coalesce(F.signum(C - F.lag(C).over(w)), F.lit(0.0)) * v)
    known = F.count(F.lit(1)).over(win.rows(w, n + 1)) >= n + 1
    return b.withColumn("obv_flow20", F.when(known, ratio(F.sum("_signed").over(win.rows(w, n)), F.sum(v).over(win.rows(w, n))))).drop("_signed")


EMAS = (9, 21, 50, 200)


def averages(b: DataFrame) -> DataFrame:
    """Exponential averages and what hangs on them: distances, slopes, stack, RSI, MACD, ADX."""
    b = win.by_chunks(b, 1, _movements)
    first = {f"_e{n}": ("close", span(n), n) for n in (*EMAS, 12, 26)} | {f"_w{c}": (f"_{c}", wilder(14), 14) for c in ("gain", "loss", "tr", "pdm", "mdm")}
    b = ewm(b, first)
    b = b.withColumns({"_macd": F.col("_e12") - F.col("_e26"), "plus_di14": 100 * ratio(F.col("_wpdm"), F.col("_wtr")), "minus_di14": 100 * ratio(F.col("_wmdm"), F.col("_wtr"))})
    b = b.withColumn("_dx", 100 * ratio(F.abs(F.col("plus_di14") - F.col("minus_di14")), F.col("plus_di14") + F.col("minus_di14")))
    b = ewm(b, {"_signal": ("_macd", span(9), 9), "adx14": ("_dx", wilder(14), 14)})
    return win.by_chunks(b, 6, _average_columns)


def _movements(b: DataFrame) -> DataFrame:
    """What the recursive averages average."""
    H, L, C = columns("high", "low", "close")
    w = win.over()
    change = C - F.lag(C).over(w)
    up, down = H - F.lag(H).over(w), F.lag(L).over(w) - L
    return b.withColumns({
        "_gain": F.greatest(change, F.lit(0.0) * change), "_loss": F.greatest(-change, F.lit(0.0) * change), "_tr": costs.true_range(w),
        "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0), "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })


def _average_columns(b: DataFrame) -> DataFrame:
    C, w = F.col("close"), win.over()
    e = {n: F.col(f"_e{n}") for n in (*EMAS, 12, 26)}
    b = b.withColumns({"_hist": F.col("_macd") - F.col("_signal"), "_fast": e[9] - e[21]})
    gain, loss = F.col("_wgain"), F.col("_wloss")
    stack = reduce(lambda a, x: a & x, [e[a] > e[c] for a, c in zip(EMAS, EMAS[1:])]), reduce(lambda a, x: a & x, [e[a] < e[c] for a, c in zip(EMAS, EMAS[1:])])
    out = b.withColumns({
        **{f"ema{n}_dist_atr": atr(C - e[n]) for n in EMAS}, **{f"ema{n}_slope_atr": atr(e[n] - F.lag(e[n], 5).over(w)) for n in (50, 200)},
        "ema9_21_cross": win.crossing(F.col("_fast"), w), "ema_stack": F.when(e[200].isNull(), None).when(stack[0], 1).when(stack[1], -1).otherwise(0),
        "rsi14": F.when(gain.isNull() | loss.isNull(), None).when(loss == 0, F.when(gain == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + gain / positive(loss))),
        "macd_atr": atr(F.col("_macd")), "macd_signal_atr": atr(F.col("_signal")), "macd_hist_atr": atr(F.col("_hist")), "macd_cross": win.crossing(F.col("_hist"), w),
    })
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def minute_spread(minute: DataFrame, n: int = 7200, least: int = 720, hour_rows: int = 3600, hour_least: int = 600) -> DataFrame:
    """By five minutes: spread_pts, spread_rel (last minute's) and hyg_abnormal_spread (any minute's), all trailing."""
    from tidemark.operators import quantiles

    level = F.when(F.col("spread_points") > 0, F.col("spread_points")).cast("double")
    m = scan.filled(minute, {"_level": level})
    m = quantiles.rolling_median(m, "_level", "_usual", n, least)
    m = m.withColumns({"_known": F.col("_level") / positive(F.col("_usual")), "_hour": F.hour("ts_utc")})
    m = quantiles.rolling_lower(m, "_known", "_p99", hour_rows, hour_least, 0.99, ("symbol", "_hour"), lag=1)
    m = m.withColumns({"_rel": F.coalesce(F.col("_known"), F.lit(1.0)), "_odd": truth(F.col("_known") > F.col("_p99"))})
    return m.groupBy("symbol", cal.bucket(F.col("ts_utc"), 5).alias("bar")).agg(
        F.max_by("_level", "ts_utc").alias("spread_pts"), F.max_by("_rel", "ts_utc").alias("spread_rel"), F.bool_or("_odd").alias("hyg_abnormal_spread")
    ).withColumnRenamed("bar", "ts_utc")


def hygiene(b: DataFrame) -> DataFrame:
    """Needs sequence and the spread columns."""
    t = F.col("ts_utc")
    b = b.withColumns({
        "hyg_rollover": cal.in_rollover(t), "hyg_week_first3": F.col("bars_since_week_open") < 3, "hyg_week_last3": cal.late_friday(t), "hyg_weekend_gap": F.col("gap_before_min") > 1440,
        "hyg_spans_weekend_gap": F.col("bars_since_week_open") < 19, "hyg_incomplete": F.col("m1_bars") < 5,
    })
    return b.withColumn("hyg_no_entry", F.col("hyg_rollover") | truth(F.col("hyg_abnormal_spread")) | F.col("hyg_week_first3") | F.col("hyg_week_last3"))
