"""Market structure: swings, breaks, sweeps, levels, trendlines and channels, as windows over bars.

A swing of half-width k at row i is known k rows later and is used from then on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.scalar import positive, ratio, truth
from tidemark.operators import scan
from tidemark.operators import windows as win
from tidemark.operators import geometry as geo
from tidemark.operators.asof import asof
from tidemark.sources.manifest import staged

K_M5, K_H1 = 5, 3
#: A break is remembered so many bars, may be retested or fail within so many, within so many ATR.
SINCE, RETEST, FAIL, NEAR = 48, 24, 12, 0.25


def pivots(b: DataFrame, k: int = K_M5) -> DataFrame:
    """pivot_high, pivot_low: the price on rows above (below) the k rows before and not below (above) the k after, else null."""
    H, L = F.col("high"), F.col("low")

    def make(b: DataFrame) -> DataFrame:
        w = win.over()
        past, next_ = w.rowsBetween(-k, -1), w.rowsBetween(1, k)
        whole = F.count(F.lit(1)).over(w.rowsBetween(-k, k)) == 2 * k + 1
        return b.withColumns({
            "pivot_high": F.when(whole & (H > F.max(H).over(past)) & (H >= F.max(H).over(next_)), H),
            "pivot_low": F.when(whole & (L < F.min(L).over(past)) & (L <= F.min(L).over(next_)), L),
        })

    return win.by_chunks(b, k, make, look_ahead=k)


def numbered(b: DataFrame) -> DataFrame:
    """Bars with _row, from 1 in each symbol."""
    return win.placed(b).withColumn("_row", F.col(win.PLACE) + 1)


def swing_state(b: DataFrame, k: int = K_M5) -> DataFrame:
    """The last and the one before last confirmed swing of each kind: hi, hi_row, hi_prev and lo, lo_row, lo_prev.

    Swings are made by chunks and written; two scans carry them: one to the next swing, one to every bar.
    """
    kinds = (("high", "hi"), ("low", "lo"))

    def confirmed(b: DataFrame) -> DataFrame:
        b, w = pivots(b, k) if "pivot_high" not in b.columns else b, win.over()
        return b.withColumns({f"_{name}": F.lag(f"pivot_{kind}", k).over(w) for kind, name in kinds})

    b = staged(win.by_chunks(numbered(b), 2 * k, confirmed, look_ahead=k), "swings")
    b = b.withColumns({f"_new_{n}": F.when(F.col(f"_{n}").isNotNull(), F.struct(F.col(f"_{n}").alias("price"), (F.col("_row") - k).alias("row"))) for _, n in kinds})
    b = scan.scan(b, {f"_was_{n}": (scan.LAST, F.col(f"_new_{n}")) for _, n in kinds}, strict=True)
    both = {f"_both_{n}": F.when(F.col(f"_new_{n}").isNotNull(), F.struct(f"_new_{n}.price", f"_new_{n}.row", F.col(f"_was_{n}.price").alias("prev"))) for _, n in kinds}
    b = scan.filled(b, both)
    b = b.withColumns({c: x for _, n in kinds for c, x in ((n, F.col(f"_both_{n}.price")), (f"{n}_row", F.col(f"_both_{n}.row")), (f"{n}_prev", F.col(f"_both_{n}.prev")))})
    return b.drop(*(f"{c}_{n}" for _, n in kinds for c in ("", "_new", "_was", "_both")))


def swing_trend() -> Column:
    up, down = (F.col("hi") > F.col("hi_prev")) & (F.col("lo") > F.col("lo_prev")), (F.col("hi") < F.col("hi_prev")) & (F.col("lo") < F.col("lo_prev"))
    return F.when(F.col("hi_prev").isNull() | F.col("lo_prev").isNull(), None).when(up, 1).when(down, -1).otherwise(0)


def swing_features(b: DataFrame, k: int = K_M5) -> DataFrame:
    H, L, C = F.col("high"), F.col("low"), F.col("close")
    a = positive(F.col("atr"))
    b = swing_state(b, k)
    return b.withColumns({
        "sw_hi_dist_atr": (C - F.col("hi")) / a, "sw_lo_dist_atr": (C - F.col("lo")) / a, "sw_hi_age": F.col("_row") - F.col("hi_row"), "sw_lo_age": F.col("_row") - F.col("lo_row"),
        "sw_trend": swing_trend(), "rng_width_atr": (F.col("hi") - F.col("lo")) / a, "rng_pos": ratio(C - F.col("lo"), F.col("hi") - F.col("lo")),
        "sweep_high": truth((H > F.col("hi")) & (C < F.col("hi"))), "sweep_low": truth((L < F.col("lo")) & (C > F.col("lo"))),
    }).withColumn("sweep_depth_atr", F.when(F.col("sweep_high"), (H - F.col("hi")) / a).when(F.col("sweep_low"), (F.col("lo") - L) / a))


def break_features(b: DataFrame) -> DataFrame:
    """Needs swing_features. Breaks, how long ago, retests and failures, upwards and downwards."""
    H, L, C = F.col("high"), F.col("low"), F.col("close")
    a = positive(F.col("atr"))
    sides = (("up", F.col("hi"), 1), ("down", F.col("lo"), -1))

    def breaks(b: DataFrame) -> DataFrame:
        was = F.lag(C).over(win.over())
        return b.withColumns({f"_on_{n}": truth(C > lv if s > 0 else C < lv) & ~truth(was > lv if s > 0 else was < lv) for n, lv, s in sides})

    b = staged(win.by_chunks(b, 1, breaks), "breaks")
    at = {n: F.when(F.col(f"_on_{n}"), F.struct(F.col("_row").alias("row"), lv.alias("level"))) for n, lv, _ in sides}
    b = scan.filled(b, {f"_upto_{n}": x for n, x in at.items()})
    b = scan.scan(b, {f"_past_{n}": (scan.LAST, x) for n, x in at.items()}, strict=True)
    for name, _, s in sides:
        since, age, lv = F.col("_row") - F.col(f"_upto_{name}.row"), F.col("_row") - F.col(f"_past_{name}.row"), F.col(f"_past_{name}.level")
        touched = (L <= lv + NEAR * a) & (C > lv) if s > 0 else (H >= lv - NEAR * a) & (C < lv)
        failed = (age <= FAIL) & (C < lv if s > 0 else C > lv)
        b = b.withColumns({
            f"sw_break_{name}": F.col(f"_on_{name}"), f"bars_since_break_{name}": F.when(since <= SINCE, since), f"retest_{name}": truth((age <= RETEST) & touched),
            f"failed_break_{name}": win.first_true(failed, F.col(f"_past_{name}.row")),
        })
    return b.drop(*(f"_{c}_{n}" for c in ("on", "upto", "past") for n, _, _ in sides))


def higher_structure(longer: DataFrame, minutes: int = 60, k: int = K_H1) -> DataFrame:
    """Swing state of longer bars by the time they close."""
    b = swing_state(longer, k)
    return b.select("symbol", cal.plus_minutes(F.col("ts_utc"), minutes).alias("_known"), swing_trend().alias("h1_sw_trend"), F.col("hi").alias("_h1_hi"), F.col("lo").alias("_h1_lo"))


def h1_features(b: DataFrame, longer: DataFrame) -> DataFrame:
    C = F.col("close")
    a = positive(F.col("atr"))
    out = asof(b, higher_structure(longer), "available_at", "_known", ["h1_sw_trend", "_h1_hi", "_h1_lo"])
    return out.withColumns({"h1_sw_hi_dist_atr": (C - F.col("_h1_hi")) / a, "h1_sw_lo_dist_atr": (C - F.col("_h1_lo")) / a}).drop("_h1_hi", "_h1_lo")


def _marked(b: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Bars with row numbers, and their swings."""
    rows = numbered(b)
    return rows, geo.swing_rows(pivots(rows, k), k)


def level_features(b: DataFrame, k: int = K_M5) -> DataFrame:
    """Support and resistance: distances to the nearest levels and how often they were touched."""
    rows, swings = _marked(b, k)
    return geo.level_columns(geo.with_levels(rows, swings)).drop("_row")


def line_features(b: DataFrame, k: int = K_M5) -> DataFrame:
    """Trendlines through rising lows and falling highs, and the channels beside them."""
    out, swings = _marked(b, k)
    for rising in (True, False):
        out = geo.line_columns(out, swings, rising)
    return out.withColumn("ch_width_atr", F.coalesce("_width_up", "_width_dn")).drop("_row", "_width_up", "_width_dn")


def swings_table(b: DataFrame, k: int = K_M5) -> DataFrame:
    """symbol, ts_utc, kind, price, known_at of each swing: the overlay of a chart."""
    p = win.by_chunks(b, k, lambda b: pivots(b, k).withColumn("known_at", F.lead("ts_utc", k).over(win.over())), look_ahead=k)
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.col(f"pivot_{n}").alias("price")) for n in ("high", "low"))))
    return p.select("symbol", "ts_utc", "known_at", kinds.alias("s")).where("s.price is not null").select("symbol", "ts_utc", "s.kind", "s.price", "known_at")



def lines_table(b: DataFrame, k: int = K_M5) -> DataFrame:
    """symbol, kind, from_row, price, slope, touches, width, formed, ended, broken: a row a line that was ever active."""
    rows, swings = _marked(b, k)
    out = None
    for kind, rising in (("up", True), ("down", False)):
        on = geo.with_line(rows, swings, rising).where("_active")
        t = on.groupBy("symbol", F.lit(kind).alias("kind"), "_line").agg(F.min("ts_utc").alias("formed"), F.max("ts_utc").alias("ended"), F.max("_through").alias("broken"))
        out = t if out is None else out.unionByName(t)
    return out.select("symbol", "kind", F.col("_line.from").alias("from_row"), "_line.price", "_line.slope", "_line.touches", "_line.width", "formed", "ended", "broken")


def levels_now(b: DataFrame, k: int = K_M5) -> DataFrame:
    """symbol, price, touches, low, high: the levels at each symbol's last bar, with the band that a cluster spans."""
    rows, swings = _marked(b, k)
    last = geo.with_levels(rows, swings).groupBy("symbol").agg(F.max_by("levels", "_row").alias("levels"), F.max_by("atr", "_row").alias("atr"))
    half = geo.LEVEL_WIDTH * F.col("atr") / 2
    return last.select("symbol", "atr", F.explode("levels").alias("l")).select("symbol", "l.price", "l.touches", (F.col("price") - half).alias("low"), (F.col("price") + half).alias("high"))


def structure_events(b: DataFrame) -> DataFrame:
    """symbol, ts_utc, kind of breaks, first retests, failures and sweeps: what a chart marks. Needs break_features."""
    flags = {}
    b = scan.scan(b, {f"_break_{n}": (scan.SUM, F.col(f"sw_break_{n}").cast("int")) for n in ("up", "down")}, strict=True).na.fill(0, ["_break_up", "_break_down"])
    for n in ("up", "down"):
        flags |= {f"break_{n}": F.col(f"sw_break_{n}"), f"retest_{n}": win.first_true(F.col(f"retest_{n}"), F.col(f"_break_{n}")), f"failed_break_{n}": F.col(f"failed_break_{n}")}
    flags |= {k: F.col(k) for k in ("sweep_high", "sweep_low")}
    b = b.withColumns({f"_is_{k}": x for k, x in flags.items()})
    kinds = F.explode(F.filter(F.array(*(F.when(F.col(f"_is_{k}"), F.lit(k)) for k in flags)), lambda x: x.isNotNull()))
    return b.select("symbol", "ts_utc", kinds.alias("kind"))
