"""The broker's clock, measured by the daily break that begins at 17:00 New York; and its weekly offsets applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import windows as win
from tidemark.operators.asof import nearest_key

#: A daily break lasts this many minutes.
SHORTEST, LONGEST = 30, 150
#: A week is measured by so many breaks that agree to such a share.
LEAST_DAYS, LEAST_AGREEMENT = 3, 0.6


def daily_breaks(bars: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """symbol, day, starts, minutes: the longest gap between bar opens of each weekday, among those of a break's length."""
    w = win.over()
    gaps = bars.select("symbol", cal.plus_minutes(F.col("ts_utc"), 1).alias("starts"), cal.minutes_between(F.col("ts_utc"), F.lead("ts_utc").over(w)).alias("minutes"))
    gaps = gaps.where(F.col("minutes").between(shortest, longest) & (cal.iso_weekday(F.col("starts")) <= 5)).withColumn("day", F.to_date("starts"))
    best = F.row_number().over(Window.partitionBy("symbol", "day").orderBy(F.desc("minutes"), "starts"))
    return gaps.withColumn("k", best).where("k = 1").select("symbol", "day", "starts", "minutes")


def break_offsets(breaks: DataFrame) -> DataFrame:
    """Breaks with their ISO week and the offset in hours, to the half hour, between broker and UTC."""
    noon_to_roll = cal.plus_minutes(F.col("day").cast("timestamp_ntz"), cal.ROLL)
    diff = cal.minutes_between(cal.to_utc(noon_to_roll, cal.NEW_YORK), F.col("starts"))
    wrapped = F.pmod(diff + 720, F.lit(cal.DAY)) - 720
    hours = F.bround(wrapped / 30, 0) / 2
    return breaks.select("symbol", "day", cal.iso_year(F.col("starts")).alias("iso_year"), cal.iso_week(F.col("starts")).alias("iso_week"), (hours + F.lit(0.0)).alias("offset_hours"))


def weekly_mode(offsets: DataFrame) -> DataFrame:
    """symbol, iso_year, iso_week, offset_hours (the commonest; of ties the least), n_days, agreement."""
    votes = offsets.groupBy("symbol", "iso_year", "iso_week", "offset_hours").agg(F.count("*").alias("n"))
    w = Window.partitionBy("symbol", "iso_year", "iso_week")
    votes = votes.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "offset_hours"))).withColumn("n_days", F.sum("n").over(w))
    return votes.where("k = 1").select("symbol", "iso_year", "iso_week", "offset_hours", "n_days", (F.col("n") / F.col("n_days")).alias("agreement"))


def infer_clock(bars: DataFrame, least_days: int = LEAST_DAYS, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """An offset for each week that has bars: measured where enough breaks agree, else that of the nearest such week."""
    weekly = weekly_mode(break_offsets(daily_breaks(bars)))
    measured = weekly.where((F.col("n_days") >= least_days) & (F.col("agreement") >= least_agreement))
    weeks = bars.select("symbol", cal.iso_year(F.col("ts_utc")).alias("iso_year"), cal.iso_week(F.col("ts_utc")).alias("iso_week")).distinct()
    return fill_weeks(weeks, measured)


def fill_weeks(weeks: DataFrame, measured: DataFrame) -> DataFrame:
    keys = ["symbol", "iso_year", "iso_week"]
    number = (F.col("iso_year") * 100 + F.col("iso_week")).cast("long")
    own = weeks.join(measured, keys).select(*keys, "offset_hours", F.lit("measured").alias("source"))
    missing = weeks.join(measured, keys, "left_anti").withColumn("week_key", number)
    near = nearest_key(missing, measured.withColumn("week_key", number), "week_key", ["offset_hours"], ("symbol",))
    return own.unionByName(near.select(*keys, "offset_hours", F.lit("nearest").alias("source")))


def apply_offsets(bars: DataFrame, weekly: DataFrame, server: str = "ts_server") -> DataFrame:
    """Bars with ts_utc from the broker's time; null where the week has no offset."""
    week = bars.withColumns({"iso_year": cal.iso_year(F.col(server)), "iso_week": cal.iso_week(F.col(server))})
    out = week.join(weekly.select("symbol", "iso_year", "iso_week", "offset_hours"), ["symbol", "iso_year", "iso_week"], "left")
    return out.withColumn("ts_utc", cal.plus_minutes(F.col(server), (-F.col("offset_hours") * 60).cast("int"))).drop("iso_year", "iso_week", "offset_hours")
