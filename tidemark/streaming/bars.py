"""Bars of a tick stream: a bar is emitted once the watermark has passed its end, so never while it forms."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def closed_bars(ticks: DataFrame, minutes: int = 5, late: str = "1 minute") -> DataFrame:
    """symbol, ts_utc, open, high, low, close, tick_volume; ticks later than ``late`` behind the newest are left out."""
    at = F.struct("ts_utc", "event_id")
    timed = ticks.withColumn("event_ts", F.col("ts_utc").cast("timestamp")).withWatermark("event_ts", late)
    bars = timed.groupBy("symbol", F.window("event_ts", f"{minutes} minutes").alias("w")).agg(
        F.min_by("bid", at).alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"), F.max_by("bid", at).alias("close"), F.count("*").alias("tick_volume")
    )
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts_utc"), "open", "high", "low", "close", "tick_volume")


def sessions(ticks: DataFrame, gap: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """Runs of ticks without a gap: symbol, starts, ends, ticks."""
    timed = ticks.withColumn("event_ts", F.col("ts_utc").cast("timestamp")).withWatermark("event_ts", late)
    s = timed.groupBy("symbol", F.session_window("event_ts", gap).alias("w")).agg(F.count("*").alias("ticks"))
    return s.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("starts"), F.col("w.end").cast("timestamp_ntz").alias("ends"), "ticks")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything that is there to parquet, with a checkpoint, and stop."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session; what they were comes back afterwards."""
    was = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)


def state_in_rocksdb(spark: SparkSession):
    """The state store that processors with state of their own need."""
    return _settings(spark, {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})


def merged_before_shuffle(spark: SparkSession):
    """Sessions are merged within each input task first, so the one task of a symbol gets sessions and not all ticks; an
    input task orders its ticks, so its split is bounded."""
    return _settings(spark, {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true", "spark.sql.files.maxPartitionBytes": "32m"})
