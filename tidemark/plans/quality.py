"""Is a history fit for use: gaps, blocking faults, anomalies, spreads, the window with full weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import quantiles
from tidemark.operators import windows as win


def classify_gaps(bars: DataFrame) -> DataFrame:
    """symbol, after, minutes, category of each gap of a minute or more between bars."""
    w = win.over()
    gaps = bars.select("symbol", F.col("ts_utc").alias("after"), (cal.minutes_between(F.col("ts_utc"), F.lead("ts_utc").over(w)) - 1).alias("minutes")).where("minutes > 0")
    starts = cal.local(cal.plus_minutes(F.col("after"), 1), cal.NEW_YORK)
    at = cal.minute_of_day(starts)
    kind = (
        F.when((cal.iso_weekday(starts) >= 5) & (F.col("minutes") >= cal.DAY), "weekend")
        .when(at.between(1000, 1040) & F.col("minutes").between(30, 150), "daily_break")
        .when(F.col("minutes") >= 150, "closure").when(F.col("minutes") >= 30, "long_intraday").otherwise("short_intraday")
    )
    return gaps.withColumn("category", kind)


def gap_summary(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("category").agg(F.count("*").alias("n"), F.sum("minutes").alias("total"), F.max("minutes").alias("longest"), F.median("minutes").alias("median"))


def research_window(bars: DataFrame, share: float = 0.8) -> DataFrame:
    """Weeks (from Monday) with their bars and whether they are full; starts: the first bar of the first full week."""
    weeks = bars.groupBy("symbol", F.date_trunc("week", "ts_utc").cast("timestamp_ntz").alias("week")).agg(F.count("*").alias("n_bars"), F.min("ts_utc").alias("first_bar"))
    usual = weeks.groupBy("symbol").agg(F.median("n_bars").alias("usual"))
    weeks = weeks.join(usual, "symbol").withColumn("is_full", F.col("n_bars") >= share * F.col("usual"))
    starts = F.min(F.when(F.col("is_full"), F.col("first_bar"))).over(win.Window.partitionBy("symbol"))
    return weeks.withColumn("starts", starts).select("symbol", "week", "n_bars", "is_full", "starts")


def blocking(bars: DataFrame) -> DataFrame:
    """Faults that no history may have, one row a symbol; passed if all are 0."""
    w = win.over()
    b = bars.withColumn("step", cal.seconds(F.col("ts_utc")) - cal.seconds(F.lag("ts_utc").over(w)))
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    none = F.least("open", "high", "low", "close") <= 0
    out = b.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), (F.count("*") - F.count_distinct("ts_utc")).alias("duplicate_timestamps"), F.count_if(F.col("step") < 0).alias("non_monotonic"),
        F.count_if(bad).alias("invalid_ohlc"), F.count_if(none).alias("non_positive"),
    )
    return out.withColumn("passed", (F.col("duplicate_timestamps") == 0) & (F.col("non_monotonic") == 0) & (F.col("invalid_ohlc") == 0) & (F.col("non_positive") == 0))


def price_anomalies(bars: DataFrame, n: int = 240, least: int = 60, wide: float = 15.0, jump: float = 10.0) -> DataFrame:
    """Bars whose range or opening gap is many times the median range of the bars before."""
    w = win.over()
    b = bars.withColumn("range", F.col("high") - F.col("low"))
    b = b.withColumn("usual", win.median(F.col("range"), w, n, until=-1, least=least)).withColumn("gap", F.abs(F.col("open") - F.lag("close").over(w)))
    b = b.withColumns({"wide_range": F.col("range") > wide * F.col("usual"), "open_gap": F.col("gap") > jump * F.col("usual")})
    return b.where("wide_range or open_gap").select("symbol", "ts_utc", "range", "gap", "usual", "wide_range", "open_gap")


def spread_stats(bars: DataFrame) -> DataFrame:
    """Nearest-rank quantiles of the spread, and how many are not above zero or beyond five times the p99."""
    q = quantiles.nearest(bars, "spread_points", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, ("symbol",))
    odd = bars.join(q, "symbol").groupBy("symbol").agg(F.count_if(F.col("spread_points") <= 0).alias("not_positive"), F.count_if(F.col("spread_points") > 5 * F.col("p99")).alias("extreme"))
    return q.join(odd, "symbol")


def coverage(bars: DataFrame) -> DataFrame:
    """Share of flat bars and of minutes between the first and the last bar that have one."""
    span = cal.minutes_between(F.min("ts_utc"), F.max("ts_utc")) + 1
    return bars.groupBy("symbol").agg(F.avg((F.col("high") == F.col("low")).cast("double")).alias("flat_share"), (F.count("*") / span).alias("coverage"))
