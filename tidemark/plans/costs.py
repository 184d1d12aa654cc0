"""The spread cost model: quoted seconds by spread, quantile cells with fallbacks, per-bar costs under three scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.scalar import positive
from tidemark.operators import quantiles
from tidemark.operators import scan
from tidemark.operators import windows as win
from tidemark.operators.joins import cascade
from tidemark.sources.tape import POINT

SHARES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
#: Quoted minutes that a cell needs to count.
LEAST_MINUTES = 60
#: Keys of the rollup where a level has none.
ANY_HOUR, ANY_DAY, ANY_BUCKET = -1, -1, "all"


def true_range(w) -> Column:
    was = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - was), F.abs(F.col("low") - was))


def average_range(bars: DataFrame, n: int = 14, point: float = POINT) -> DataFrame:
    """Bars with atr, the mean true range of the n bars before, and atr_pts."""

    def make(b: DataFrame) -> DataFrame:
        w = win.over()
        return b.withColumn("_tr", true_range(w)).withColumn("_mean", win.mean(F.col("_tr"), w, n)).withColumn("atr", F.lag("_mean").over(w))

    out = win.by_chunks(bars, n + 2, make)
    return out.withColumn("atr_pts", F.col("atr") / point).drop("_tr", "_mean")


def volatility(bars: DataFrame, n: int = 14, long: int = 5760, least: int = 1440, point: float = POINT) -> DataFrame:
    """average_range, and vol_ratio: atr_pts to its own long rolling median."""
    out = quantiles.rolling_median(average_range(bars, n, point), "atr_pts", "_usual", long, least)
    return out.withColumn("vol_ratio", F.col("atr_pts") / positive(F.col("_usual"))).drop("_usual")


def terciles(df: DataFrame, value: str) -> DataFrame:
    """symbol, low, high: the nearest-rank thirds."""
    return quantiles.nearest(df, value, {"low_edge": 1 / 3, "high_edge": 2 / 3}, ("symbol",)).drop("n")


def bucket(value: Column, low: Column, high: Column, unknown: str | None = "mid") -> Column:
    return F.when(value.isNull() | low.isNull(), F.lit(unknown)).when(value < low, "low").when(value < high, "mid").otherwise("high")


def with_bucket(df: DataFrame, value: str = "vol_ratio", into: str = "vol_bucket") -> DataFrame:
    edges = terciles(df, value)
    return df.join(edges, "symbol", "left").withColumn(into, bucket(F.col(value), F.col("low_edge"), F.col("high_edge"))).drop("low_edge", "high_edge")


def histogram(ticks: DataFrame, point: float = POINT, allow_zero: bool = False, longest: float = 60.0) -> DataFrame:
    """symbol, ts_utc (minute), spread_points, seconds, ticks: how long each spread was quoted.

    A quote lasts until the next one of its day, the last one the longest time. Quotes without a positive bid, or whose
    spread is not above zero, are left out after their durations are known.
    """
    day = Window.partitionBy("symbol", F.to_date("ts_utc")).orderBy("ts_utc", "event_id")
    micros = F.timestamp_diff("MICROSECOND", F.col("ts_utc"), F.lead("ts_utc").over(day)) / 1e6
    q = ticks.where((F.col("bid") > 0) & (F.col("ask") > 0)).withColumn("points", F.bround((F.col("ask") - F.col("bid")) / point, 0).cast("long"))
    q = q.where(F.col("points") >= 0 if allow_zero else F.col("points") > 0)
    q = q.withColumn("seconds", F.least(F.greatest(F.coalesce(micros, F.lit(longest)), F.lit(0.001)), F.lit(longest)))
    return q.groupBy("symbol", cal.bucket(F.col("ts_utc"), 1).alias("ts_utc"), F.col("points").alias("spread_points")).agg(F.sum("seconds").alias("seconds"), F.count("*").alias("ticks"))


def measured_minutes(hist: DataFrame) -> DataFrame:
    """Time-weighted mean, least and greatest spread of each minute."""
    return hist.groupBy("symbol", "ts_utc").agg(
        (F.sum(F.col("spread_points") * F.col("seconds")) / F.sum("seconds")).alias("spread_mean"), F.min("spread_points").alias("spread_min"),
        F.max("spread_points").alias("spread_max"), F.sum("seconds").alias("seconds"), F.sum("ticks").alias("ticks"),
    )


def bar_keys(minute: DataFrame) -> DataFrame:
    """Minute bars with hour_utc, dow, in_rollover_window and level: the spread if above zero, else the last such, else the next."""
    level = F.when(F.col("spread_points") > 0, F.col("spread_points"))
    out = minute.withColumns({"hour_utc": F.hour("ts_utc"), "dow": cal.iso_weekday(F.col("ts_utc")), "in_rollover_window": cal.in_rollover(F.col("ts_utc")), "level_imputed": level.isNull(), "_level": level})
    out = scan.filled(scan.filled(out, {"_last": F.col("_level")}), {"_next": F.col("_level")}, backward=True)
    return out.withColumn("level", F.coalesce("_last", "_next")).drop("_level", "_last", "_next")


def with_bar_bucket(keys: DataFrame, five: DataFrame, **parameters) -> DataFrame:
    """Minute keys with vol_bucket, that of the five-minute bar they are in; "mid" where it has none."""
    bars = with_bucket(volatility(five, **parameters)).select("symbol", F.col("ts_utc").alias("_bar"), "vol_bucket")
    out = keys.withColumn("_bar", cal.bucket(F.col("ts_utc"), 5)).join(bars, ["symbol", "_bar"], "left").drop("_bar")
    return out.withColumn("vol_bucket", F.coalesce("vol_bucket", F.lit("mid")))


def keyed_histogram(hist: DataFrame, keys: DataFrame) -> DataFrame:
    """The histogram with hour, day, bucket and the ratio to the level of its minute's bar (4 places); minutes without a bar are left out."""
    k = keys.select("symbol", "ts_utc", "hour_utc", "dow", "vol_bucket", "level")
    return hist.join(k, ["symbol", "ts_utc"]).withColumn("ratio", F.bround(F.col("spread_points") / F.col("level"), 4))


def own_ratio(hist: DataFrame) -> DataFrame:
    """The histogram with the ratio to the least spread of its own minute (3 places)."""
    least = F.min("spread_points").over(Window.partitionBy("symbol", "ts_utc"))
    return hist.withColumn("ratio", F.bround(F.col("spread_points") / least, 3))


LEVELS = (("hour_utc", "dow", "vol_bucket"), ("hour_utc", "dow"), ("hour_utc",), ())


def cells(keyed: DataFrame, value: str = "ratio") -> DataFrame:
    """Weighted quantiles on four levels of a rollup, in long form with sentinels for the keys that a level lacks.

    The rows are rolled up once, to seconds by level, keys and value; the quantiles of all levels are one more pass.
    """
    any_key = {"hour_utc": F.lit(ANY_HOUR), "dow": F.lit(ANY_DAY), "vol_bucket": F.lit(ANY_BUCKET)}
    sums = keyed.groupBy("hour_utc", "dow", "vol_bucket", value).agg(F.sum("seconds").alias("seconds"))
    long = sums.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(LEVELS) - 1))))
    for k, any_ in any_key.items():
        kept = F.col("level").isin([i for i, keys in enumerate(LEVELS) if k in keys])
        long = long.withColumn(k, F.when(kept, F.col(k)).otherwise(any_))
    out = quantiles.weighted(long, value, "seconds", SHARES, ("level", "hour_utc", "dow", "vol_bucket"))
    return out.withColumn("minutes", F.col("weight") / 60).drop("weight")


def lookup(rows: DataFrame, cell_table: DataFrame, least_minutes: float = LEAST_MINUTES) -> DataFrame:
    """Rows (hour_utc, dow, vol_bucket) with the quantiles of the finest cell that has enough minutes, and its level."""
    good = cell_table.where(F.col("minutes") >= least_minutes)
    levels = [(good.where(F.col("level") == i), list(keys)) for i, keys in enumerate(LEVELS)]
    return cascade(rows, levels, list(SHARES), "p50")


def price_bars(keys: DataFrame, measured: DataFrame, cell_table: DataFrame, recent: DataFrame, least_minutes: float = LEAST_MINUTES) -> DataFrame:
    """Costs of each minute bar: optimistic <= base <= pessimistic; measured where quotes exist, else level times ratio.

    The cells of the whole history and of the recent quotes are looked up in one cascade: a level's cells of both tables
    are one row, and each table's finest good level counts for itself.
    """
    cell = ["level", "hour_utc", "dow", "vol_bucket"]
    good = lambda t: t.where((F.col("minutes") >= least_minutes) & F.col("p50").isNotNull())
    both = good(cell_table).select(*cell, F.struct(*SHARES).alias("all")).join(good(recent).select(*cell, F.col("p90").alias("now")), cell, "full")
    out = keys.withColumnRenamed("level", "level_pts")
    for i, k in enumerate(LEVELS):
        found = both.where(F.col("level") == i).select(*k, F.col("all").alias(f"_all{i}"), F.col("now").alias(f"_now{i}"))
        out = out.join(found, list(k), "left") if k else out.join(found, F.lit(True), "left")
    whole = F.coalesce(*(F.col(f"_all{i}") for i in range(len(LEVELS))))
    now = F.col("level_pts") * F.coalesce(*(F.col(f"_now{i}") for i in range(len(LEVELS))))
    out = out.withColumn("_q", whole).join(measured.select("symbol", "ts_utc", F.col("spread_mean").alias("observed")), ["symbol", "ts_utc"], "left")
    q = {p: F.col("level_pts") * F.col(f"_q.{p}") for p in SHARES}
    base = F.coalesce(F.col("observed"), q["p50"])
    return out.select(
        "symbol", "ts_utc", "level_pts", F.least(F.col("observed"), q["p25"]).alias("spread_optimistic"), base.alias("spread_base"),
        F.greatest(F.col("observed"), q["p90"], now, base).alias("spread_pessimistic"), F.when(F.col("observed").isNotNull(), "measured").otherwise("modeled").alias("spread_source"), "in_rollover_window",
    )


def current_window(df: DataFrame, days: int = 60) -> DataFrame:
    """The rows of the last days before each symbol's last time."""
    last = df.groupBy("symbol").agg(F.max("ts_utc").alias("_last"))
    return df.join(last, "symbol").where(cal.seconds(F.col("ts_utc")) >= cal.seconds(F.col("_last")) - days * 86_400).drop("_last")


def flag_abnormal(minute_keys: DataFrame, n: int = 7200, least: int = 720) -> DataFrame:
    """Minute bars whose level over its rolling median exceeds the p99 of its UTC hour over the whole history."""
    out = quantiles.rolling_median(minute_keys, "level", "_usual", n, least)
    out = out.withColumn("level_ratio", F.coalesce(F.col("level") / positive(F.col("_usual")), F.lit(1.0))).drop("_usual")
    p99 = quantiles.nearest(out, "level_ratio", {"p99": 0.99}, ("symbol", "hour_utc")).drop("n")
    return out.join(p99, ["symbol", "hour_utc"], "left").withColumn("abnormal", F.coalesce(F.col("level_ratio") > F.col("p99"), F.lit(False)))


def to_m5(costs: DataFrame) -> DataFrame:
    """Costs of the first minute of each five; flags if any minute has them."""
    first = lambda c: F.min_by(c, "ts_utc").alias(c)
    return costs.groupBy("symbol", cal.bucket(F.col("ts_utc"), 5).alias("bar")).agg(
        *(first(c) for c in ("spread_optimistic", "spread_base", "spread_pessimistic", "spread_source")), F.bool_or("in_rollover_window").alias("in_rollover_window")
    ).withColumnRenamed("bar", "ts_utc")


#: Slippage of the three scenarios: points fixed, share of the ATR, factor for stops in the rollover window.
SLIPPAGE = {"optimistic": (0.0, 0.0, 1.0), "base": (2.0, 0.01, 2.0), "pessimistic": (5.0, 0.02, 3.0)}


def slippage(scenario: str, order: str, atr_pts: Column, in_window: Column) -> Column:
    """Points that an order slips: none for a limit, more for a stop in the rollover window."""
    fixed, share, factor = SLIPPAGE[scenario]
    if order == "limit":
        return F.lit(0.0)
    out = F.lit(fixed) + share * F.greatest(F.coalesce(atr_pts, F.lit(0.0)), F.lit(0.0))
    return F.when(F.coalesce(in_window, F.lit(False)), out * factor).otherwise(out) if order == "stop" else out


def commission(rate: float, scenario: str, confirmed: bool, floor: float = 7.0) -> float:
    return max(rate, floor) if scenario == "pessimistic" and not confirmed else rate


def swap_nights(entry: Column, exit_: Column, triple_weekday: int = 3) -> Column:
    """Rollovers at 17:00 New York in (entry, exit] on weekdays; the one on the triple weekday counts three times."""
    days = F.sequence(F.date_sub(F.to_date(cal.local(entry, cal.NEW_YORK)), 1), F.date_add(F.to_date(cal.local(exit_, cal.NEW_YORK)), 1))
    roll = lambda d: cal.to_utc(cal.plus_minutes(d.cast("timestamp_ntz"), cal.ROLL), cal.NEW_YORK)
    weight = lambda d: F.when(F.weekday(d) >= 5, 0).when(F.weekday(d) + 1 == triple_weekday, 3).otherwise(1)
    held = F.filter(days, lambda d: (roll(d) > entry) & (roll(d) <= exit_))
    return F.when(entry < exit_, F.aggregate(held, F.lit(0), lambda a, d: a + weight(d))).otherwise(0)


def validate(hist: DataFrame, keys: DataFrame, held_out: float = 0.2, least_minutes: float = LEAST_MINUTES) -> DataFrame:
    """Minutes of the last days of quotes with what two models say that were fitted on the days before.

    symbol, ts_utc, spread_mean; ratio_p50, ratio_p90: level times ratio; abs_p50, abs_p90: cells of plain spreads.
    """
    days = hist.select("symbol", F.to_date("ts_utc").alias("day")).distinct()
    w = Window.partitionBy("symbol")
    at = days.withColumns({"k": F.row_number().over(w.orderBy("day")) - 1, "n": F.count("*").over(w)})
    cut = at.where(F.col("k") == F.floor(F.col("n") * (1 - held_out))).select("symbol", F.col("day").alias("cut"))
    both = hist.join(cut, "symbol").withColumn("late", F.to_date("ts_utc") >= F.col("cut"))
    early = keyed_histogram(both.where("not late").drop("late", "cut"), keys)
    rows = measured_minutes(both.where("late").drop("late", "cut")).select("symbol", "ts_utc", "spread_mean").join(keys.withColumnRenamed("level", "level_pts"), ["symbol", "ts_utc"])
    rows = rows.select("symbol", "ts_utc", "hour_utc", "dow", "vol_bucket", "level_pts", "spread_mean")
    for name, value, scale in (("ratio", "ratio", F.col("level_pts")), ("abs", "spread_points", F.lit(1.0))):
        found = lookup(rows, cells(early, value), least_minutes)
        rows = found.select(*rows.columns, *((scale * F.col(p)).alias(f"{name}_{p}") for p in ("p50", "p90")))
    return rows


def validation_metrics(held: DataFrame) -> DataFrame:
    """By symbol and model: n, bias, mae, coverage of the p90, and whether it is accepted (bias within 0.15, coverage of 0.85)."""
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"{m}_p50").alias("p50"), F.col(f"{m}_p90").alias("p90")) for m in ("ratio", "abs"))))
    rows = held.select("symbol", "spread_mean", models.alias("m")).select("symbol", "spread_mean", "m.*").where("p50 is not null")
    out = rows.groupBy("symbol", "model").agg(
        F.count("*").alias("n"), ((F.avg("p50") - F.avg("spread_mean")) / F.avg("spread_mean")).alias("bias"), F.avg(F.abs(F.col("p50") - F.col("spread_mean"))).alias("mae"),
        F.avg((F.col("spread_mean") <= F.col("p90") + 1e-9).cast("double")).alias("coverage_p90"),
    )
    return out.withColumn("accepted", (F.abs(F.col("bias")) <= 0.15) & (F.col("coverage_p90") >= 0.85))


def weekly_errors(held: DataFrame) -> DataFrame:
    """Where a model breaks: the means of measured and modelled spreads by week."""
    return held.groupBy("symbol", F.date_trunc("week", "ts_utc").cast("timestamp_ntz").alias("week")).agg(*(F.avg(c).alias(n) for c, n in (("spread_mean", "measured"), ("ratio_p50", "level_x_ratio"), ("abs_p50", "abs_cells"))))


def impossible_share(keys: DataFrame, before: str, table: DataFrame, least_minutes: float = LEAST_MINUTES) -> DataFrame:
    """Could cells of plain spreads hold for minutes before a time? n, share below the quoted level, median of p50 over level."""
    rows = keys.where(F.col("ts_utc") < F.lit(before).cast("timestamp_ntz")).withColumnRenamed("level", "level_pts")
    rows = lookup(rows.select("symbol", "ts_utc", "hour_utc", "dow", "vol_bucket", "level_pts"), table, least_minutes)
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.avg((F.col("p50") < F.col("level_pts")).cast("double")).alias("share_below_level"), F.median(F.col("p50") / positive(F.col("level_pts"))).alias("median_p50_over_level"))
