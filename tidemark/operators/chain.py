"""Chains of pointers: which rows one meets who starts at the first and always goes on where the row points to.

Pointers only lead forward, so a chunk of rows can be left without knowing where it was entered: every row gets the first
row beyond its chunk that it leads to. Over these few rows pointers are doubled, which takes a number of joins that grows
with the logarithm of the chunks, and finds where the chain enters each chunk; then the chunks mark their own rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.manifest import staged

CHUNK = 8_192


def _exits(place: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Where each row of a sorted chunk leads to beyond it (-1: nowhere): jumps are doubled until all are out."""
    at = np.searchsorted(place, to)
    own = (to >= 0) & (at < len(place))
    own[own] &= place[at[own]] == to[own]
    step = np.where(own, at, np.arange(len(place)))
    while (step[step] != step).any():
        step = step[step]
    return to[step]


def reached(links: DataFrame, keys: tuple[str, ...], chunk: int = CHUNK) -> DataFrame:
    """(keys, place) of the chain from each key's least place. links: keys, place, next (null: the end; else beyond place)."""
    links = links.withColumn("chunk", F.floor(F.col("place") / chunk))
    fields = [f for f in links.schema.fields if f.name in keys]

    def leave(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("place")
        out = p[[*keys, "place"]].copy()
        out["next"] = _exits(p["place"].to_numpy(), p["next"].fillna(-1).astype("int64").to_numpy())
        return out

    long = T.LongType()
    exits = links.groupBy(*keys, "chunk").applyInPandas(leave, T.StructType([*fields, T.StructField("place", long), T.StructField("next", long)]))
    exits = staged(exits.where("next >= 0"), "exits")
    starts = links.groupBy(*keys).agg(F.min("place").alias("place"))
    entries = staged(starts, "entries")
    # only rows that some chunk leads to, and the first ones, can be where a chunk is entered
    doors = exits.select(*keys, F.col("next").alias("place")).distinct().unionByName(starts).distinct()
    jumps = staged(exits.join(doors, [*keys, "place"]), "jumps")
    before = -1
    while not jumps.isEmpty():
        entries = staged(entries.unionByName(entries.join(jumps, [*keys, "place"]).select(*keys, F.col("next").alias("place"))).distinct(), "entries")
        now = entries.count()
        if now == before:
            break
        before = now
        further = jumps.select(*keys, F.col("place").alias("next"), F.col("next").alias("_far"))
        jumps = staged(jumps.join(further, [*keys, "next"]).select(*keys, "place", F.col("_far").alias("next")), "jumps")
    entered = entries.select(*keys, F.floor(F.col("place") / chunk).alias("chunk"), F.col("place").alias("entry"))

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("place")
        place, to = p["place"].to_numpy(), p["next"].fillna(-1).astype("int64").to_numpy()
        at, met = int(np.searchsorted(place, p["entry"].iloc[0])), []
        while at < len(place):
            met.append(at)
            if to[at] < 0:
                break
            at = int(np.searchsorted(place, to[at]))
        return p.iloc[met][[*keys, "place"]]

    return links.join(entered, [*keys, "chunk"]).groupBy(*keys, "chunk").applyInPandas(walk, T.StructType([*fields, T.StructField("place", long)]))
