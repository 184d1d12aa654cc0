"""Values of given ranks by distributed selection: counts by bins that narrow until one value is left.

A pass counts, for every rank still sought, the rows of its interval in ``BINS`` bins of equal width, with the least and
greatest value of each bin, and goes on with the bin that holds the rank, tightened to these two. The interval's least
value is in its first bin and the greatest in its last, so every pass narrows it, and a bin of a single value ends it.
No rows are ordered; a pass brings at most BINS rows for each key and rank to one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.manifest import staged

BINS = 1_024
#: Up to so many sought values go to the rows; more are joined by key.
SENT = 200_000


def nth(df: DataFrame, value: str, ranks: dict[str, Column], keys=()) -> DataFrame:
    """One row a key with, for each name, the value of a rank from 0 in ascending order (NaN last), and n, the values that
    are not null. ``ranks`` are columns of n; a rank outside of 0 .. n - 1 gives null."""
    by = list(keys) or ["__all"]
    x = df.where(F.col(value).isNotNull()).select(*(F.col(k) for k in keys), *([] if keys else [F.lit(1).alias("__all")]), F.col(value).cast("double").alias("__x"))
    far, nan = F.abs("__x") == float("inf"), F.isnan("__x")
    plain = F.when(~far & ~nan, F.col("__x"))
    spans = x.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(plain).alias("__lo"), F.max(plain).alias("__hi"), F.count_if(far & (F.col("__x") < 0)).alias("__least"), F.count_if(far & (F.col("__x") > 0)).alias("__most"), F.count(plain).alias("__plain")
    )
    spans = staged(spans, "ranks")
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items())))
    sought = spans.select("*", each.alias("__r")).select("*", "__r.name", "__r.rank").drop("__r")
    own = F.col("rank") - F.col("__least")
    edge = F.when(own < 0, float("-inf")).when(own >= F.col("__plain") + F.col("__most"), float("nan")).when(own >= F.col("__plain"), float("inf"))
    valid = (F.col("rank") >= 0) & (F.col("rank") < F.col("n"))
    done = sought.where(valid).select(*by, "name", edge.alias("value")).where("value is not null")
    open_ = staged(sought.where(valid & edge.isNull()).select(*by, "name", own.alias("rank"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi")), "ranks")
    rows = x.where(~far & ~nan)
    while True:
        found = open_.where("lo = hi").select(*by, "name", F.col("lo").alias("value"))
        done, open_ = done.unionByName(found), open_.where("lo < hi")
        left = open_.limit(SENT + 1).count()
        if not left:
            break
        open_ = staged(_narrowed(rows, F.broadcast(open_) if left <= SENT else open_, by), "ranks")
    kind = df.schema[value].dataType
    wide = done.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).cast(kind).alias(name) for name in ranks))
    out = spans.select(*by, "n").join(wide, by, "left").select(*keys, *ranks, "n")
    return out if keys else _one_row(df.sparkSession, out)


def _narrowed(rows: DataFrame, sought: DataFrame, by: list[str]) -> DataFrame:
    inside = rows.join(sought, by).where((F.col("__x") >= F.col("lo")) & (F.col("__x") <= F.col("hi")))
    # halves before differences, so that the width of an interval does not overflow
    at = F.least(F.floor((F.col("__x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))
    bins = inside.groupBy(*by, "name", "rank", at.alias("bin")).agg(F.count("*").alias("c"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    to = F.sum("c").over(Window.partitionBy(*by, "name").orderBy("bin"))
    hit = bins.withColumn("to", to).where((F.col("rank") < F.col("to")) & (F.col("rank") >= F.col("to") - F.col("c")))
    return hit.select(*by, "name", (F.col("rank") - F.col("to") + F.col("c")).alias("rank"), "lo", "hi")


def _one_row(spark, out: DataFrame) -> DataFrame:
    """Without keys there is one row even of an empty table."""
    return spark.range(1).select(F.lit(1).alias("__all")).join(out.withColumn("__all", F.lit(1)), "__all", "left").drop("__all")


def nearest(df: DataFrame, value: str, shares: dict[str, float], keys=()) -> DataFrame:
    """One row a key: for each name the value whose rank is nearest to share * (n - 1), half to even, and n."""
    return nth(df, value, {name: F.bround(F.lit(q) * (F.col("n") - 1), 0) for name, q in shares.items()}, keys)


def linear(df: DataFrame, value: str, shares: dict[str, float], keys=()) -> DataFrame:
    """One row a key: quantiles between the two nearest ranks, in proportion; and n."""
    at = {name: F.lit(q) * (F.col("n") - 1) for name, q in shares.items()}
    ranks = {f"{name}__{side}": f(x) for name, x in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    both = nth(df, value, ranks, keys)
    mixed = {name: F.col(f"{name}__lo") + (F.col(f"{name}__hi") - F.col(f"{name}__lo")) * (x - F.floor(x)) for name, x in at.items()}
    return both.select(*keys, *(x.alias(name) for name, x in mixed.items()), "n")
