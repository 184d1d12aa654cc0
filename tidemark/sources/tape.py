"""Quotes and bars. ``tape`` adapts the events table: its value is the bid, the number in its props the spread in points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import calendar as cal
from tidemark.sources.datasets import kept

POINT = 0.01
BAR = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts_utc", T.TimestampNTZType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")), T.StructField("tick_volume", T.LongType()), T.StructField("spread_points", T.IntegerType())])
TICK = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts_utc", T.TimestampNTZType()), T.StructField("event_id", T.LongType()), T.StructField("bid", T.DoubleType()), T.StructField("ask", T.DoubleType()), T.StructField("spread_points", T.IntegerType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame, by_type: bool = False) -> DataFrame:
    """Ticks of one symbol ALL, or of one symbol for each type of event."""
    symbol = F.col("event_type") if by_type else F.lit("ALL")
    spread = F.get_json_object("props", "$.k").cast("int")
    return events.select(symbol.alias("symbol"), F.col("ts").alias("ts_utc"), "event_id", F.col("value").alias("bid"), (F.col("value") + spread * POINT).alias("ask"), spread.alias("spread_points"))


def tape(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"), by_type)


def minute_bars(ticks: DataFrame) -> DataFrame:
    """Bars of one minute; order inside of a bar is that of time, then of the event's number."""
    at = F.struct("ts_utc", "event_id")
    return ticks.groupBy("symbol", cal.bucket(F.col("ts_utc"), 1).alias("bar")).agg(
        F.min_by("bid", at).alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"), F.max_by("bid", at).alias("close"),
        F.count("*").alias("tick_volume"), F.max_by("spread_points", at).alias("spread_points"),
    ).withColumnRenamed("bar", "ts_utc")


def aggregate(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars of one minute to longer ones: left-closed buckets labelled by their start."""
    return bars.groupBy("symbol", cal.bucket(F.col("ts_utc"), minutes).alias("bar")).agg(
        F.min_by("open", "ts_utc").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts_utc").alias("close"),
        F.sum("tick_volume").alias("tick_volume"), F.min("spread_points").alias("spread_points_min"), F.max("spread_points").alias("spread_points_max"),
        F.count("*").alias("m1_bars"),
    ).withColumnRenamed("bar", "ts_utc")


def bars(spark: SparkSession, sf_dir: str, minutes: int, by_type: bool = False) -> DataFrame:
    """Bars of the events; those of one minute are kept, longer ones made of them."""
    one = kept(spark, sf_dir, "minute-bars-by-type" if by_type else "minute-bars", lambda: minute_bars(tape(spark, sf_dir, by_type)))
    return one if minutes == 1 else aggregate(one, minutes)


def truncated(minute: DataFrame, cutoff: str, minutes: int) -> DataFrame:
    """What was known at the cutoff: longer bars made of minutes that had closed, and themselves closed."""
    stop = F.lit(cutoff).cast("timestamp_ntz")
    longer = aggregate(minute.where(cal.plus_minutes(F.col("ts_utc"), 1) <= stop), minutes)
    return longer.where(cal.plus_minutes(F.col("ts_utc"), minutes) <= stop)
