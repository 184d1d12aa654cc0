"""Exact quantiles under the definitions that the models need: nearest rank (by selection), lower, weighted, rolling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import windows as win
from tidemark.operators.selection import nearest  # noqa: F401


def weighted(df: DataFrame, value: str, weight: str, shares: dict[str, float], keys=()) -> DataFrame:
    """One row a key: the first value whose cumulative share of the weight reaches each share; and total and mean."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*(keys or [F.lit(1)]))
    sums = sums.withColumn("_share", F.sum("_w").over(w.orderBy(value)) / F.sum("_w").over(w))
    picks = [F.min(F.when(F.col("_share") >= q - 1e-12, F.col(value))).alias(name) for name, q in shares.items()]
    return sums.groupBy(*keys).agg(F.sum("_w").alias("weight"), (F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("mean"), *picks)


def _rolling(df: DataFrame, value: str, into: str, n: int, lag: int, keys, time: str, order, of) -> DataFrame:
    """``of`` a pandas rolling window of the last n rows, by chunks that carry the rows before them."""
    cut = win.in_chunks(df, n + lag, max(win.CHUNK, 2 * n), keys, time, order)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.DoubleType())])
    columns = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        pdf[into] = of(pdf[value].astype("float64")).shift(lag)
        return pdf.loc[~pdf["warm_up"], [*columns, into]]

    return cut.groupBy(*keys, "chunk").applyInPandas(run, schema)


def rolling_median(df: DataFrame, value: str, into: str, n: int, least: int, keys=win.KEYS, time: str = "ts_utc", order=("ts_utc",), lag: int = 0) -> DataFrame:
    """Median of the last n rows (``lag`` rows ago), null under ``least`` values: long windows."""
    return _rolling(df, value, into, n, lag, keys, time, order, lambda x: x.rolling(n, min_periods=least).median())


def rolling_lower(df: DataFrame, value: str, into: str, n: int, least: int, q: float, keys=win.KEYS, time: str = "ts_utc", order=("ts_utc",), lag: int = 0) -> DataFrame:
    """The value of rank floor(q * (count - 1)) of the last n rows (``lag`` rows ago), null under ``least`` values."""
    return _rolling(df, value, into, n, lag, keys, time, order, lambda x: x.rolling(n, min_periods=least).quantile(q, interpolation="lower"))
