"""Recursive averages by chunks.

y[t] = (1 - a) y[t-1] + a x[t] is a chain of affine maps, and the chain of a chunk is one such map. So each chunk
reduces to a pair of numbers, the pairs of a key are chained in order, and a second pass starts every chunk from the
value that the chain hands it. No task holds more than a chunk, yet the result is the recursion over the whole series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import windows as win


#: Values that one matrix product takes through the recursion.
BLOCK = 128


def _run(x: np.ndarray, a: float, start: float) -> np.ndarray:
    """The recursion over values without nulls; start nan: the first value starts it.

    A block's averages are its values times a triangle of weights, plus what is left of the average before it.
    """
    if not len(x):
        return np.empty(0)
    if start != start:
        return np.r_[x[0], _run(x[1:], a, float(x[0]))]
    power = (1 - a) ** np.arange(BLOCK + 1)
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]
    weights = np.where(lag >= 0, a * power[np.abs(lag)], 0.0)
    own = np.pad(x, (0, -len(x) % BLOCK)).reshape(-1, BLOCK) @ weights.T
    y = start
    for k in range(len(own)):
        own[k] += power[1:] * y
        y = own[k, -1]
    return own.ravel()[: len(x)]


def ewm(df: DataFrame, averages: dict[str, tuple[str, float, int]], keys=win.KEYS, time: str = "ts_utc", order=("ts_utc",), chunk: int = win.CHUNK) -> DataFrame:
    """``df`` with each average: name -> (column, smoothing, least). Null until ``least`` values; null values are passed over."""
    names = list(averages)
    cut = win.placed(df, keys, time, order).withColumn("_chunk", F.floor(F.col(win.PLACE) / chunk)).select(*(F.col(f"`{c}`") for c in df.columns), "_chunk")
    key_fields = [f for f in df.schema.fields if f.name in keys]
    ends = T.StructType([*key_fields, T.StructField("_chunk", T.LongType()), *(T.StructField(f"_{p}_{n}", T.DoubleType()) for n in names for p in ("m", "b", "f", "c"))])

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each average: factor and offset of the chunk's map, its value if the chunk starts the series, its count."""
        pdf = pdf.sort_values(list(order), kind="stable")
        row = {k: pdf[k].iloc[0] for k in (*keys, "_chunk")}
        for n in names:
            column, a, _ = averages[n]
            x = pdf[column].astype("float64").dropna().to_numpy()
            row |= {f"_m_{n}": (1 - a) ** len(x), f"_b_{n}": _run(x, a, 0.0)[-1] if len(x) else 0.0, f"_f_{n}": _run(x, a, np.nan)[-1] if len(x) else np.nan, f"_c_{n}": float(len(x))}
        return pd.DataFrame([row])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row a chunk: what it starts from."""
        pdf = pdf.sort_values("_chunk")
        for n in names:
            y, seen, starts, counts = np.nan, 0.0, [], []
            for m, b, f, c in zip(pdf[f"_m_{n}"], pdf[f"_b_{n}"], pdf[f"_f_{n}"], pdf[f"_c_{n}"]):
                starts.append(y)
                counts.append(seen)
                y = f if y != y else m * y + b
                seen += c
            pdf[f"_f_{n}"], pdf[f"_c_{n}"] = starts, counts
        return pdf

    starts = cut.groupBy(*keys, "_chunk").applyInPandas(reduce, ends).groupBy(*keys).applyInPandas(chain, ends)
    starts = starts.select(*keys, "_chunk", *(f"_{p}_{n}" for n in names for p in ("f", "c")))
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    columns = df.columns

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        for n in names:
            column, a, least = averages[n]
            x = pdf[column].astype("float64")
            known = x.notna().to_numpy()
            out = np.full(len(x), np.nan)
            y = _run(x.to_numpy()[known], a, pdf[f"_f_{n}"].iloc[0] if pd.notna(pdf[f"_f_{n}"].iloc[0]) else np.nan)
            out[known] = np.where(np.arange(1, len(y) + 1) + pdf[f"_c_{n}"].iloc[0] >= least, y, np.nan)
            pdf[n] = out
        return pdf[[*columns, *names]]

    return cut.join(starts, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(apply, schema)


def span(n: int) -> float:
    return 2 / (n + 1)


def wilder(n: int) -> float:
    return 1 / n
