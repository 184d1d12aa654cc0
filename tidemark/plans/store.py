"""Reading features as of a time, and proof that they never look ahead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal


class LookAheadError(LookupError):
    """The row exists but was not known yet."""


def as_of(features: DataFrame, when: str) -> DataFrame:
    return features.where(F.col("available_at") <= F.lit(when).cast("timestamp_ntz"))


def latest(features: DataFrame, when: str) -> DataFrame:
    """The last row of each symbol that was known."""
    known = as_of(features, when)
    return known.groupBy("symbol").agg(F.max_by(F.struct(*known.columns), "available_at").alias("r")).select("r.*")


def bar(features: DataFrame, symbol: str, event_time: str, when: str):
    """One row; LookAheadError if it was not known at ``when``, KeyError if there is none."""
    row = features.where((F.col("symbol") == symbol) & (F.col("event_time") == F.lit(event_time).cast("timestamp_ntz"))).withColumn("_known", F.col("available_at") <= F.lit(when).cast("timestamp_ntz")).first()
    if row is None:
        raise KeyError(event_time)
    if not row["_known"]:
        raise LookAheadError(event_time)
    return row


def availability_audit(features: DataFrame, minutes: int = 5) -> DataFrame:
    """Counts that must all be 0."""
    return features.agg(
        F.count("*").alias("rows"), F.count_if(F.col("available_at").isNull()).alias("unknown"), F.count_if(F.col("available_at") < cal.plus_minutes(F.col("event_time"), minutes)).alias("too_early"),
        (F.count("*") - F.count_distinct("symbol", "event_time")).alias("duplicates"),
        F.count_if(F.col("h1_close_utc") > F.col("available_at")).alias("forming_h1") if "h1_close_utc" in features.columns else F.lit(0).cast("long").alias("forming_h1"),
    )


def differences(a: DataFrame, b: DataFrame, on=("symbol", "ts_utc"), relative: float = 1e-9) -> DataFrame:
    """column, mismatches: nulls equal one another, floats to a relative 1e-9; rows of one side only count under 'rows'."""
    kinds = dict(a.dtypes)
    columns = [c for c in a.columns if c not in on and c in b.columns]
    both = a.select(*on, F.lit(1).alias("_a"), *(F.col(c).alias(f"a_{c}") for c in columns)).join(b.select(*on, F.lit(1).alias("_b"), *(F.col(c).alias(f"b_{c}") for c in columns)), list(on), "full")
    pair = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def differ(c: str):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        same = x.eqNullSafe(y)
        if kinds[c] in ("double", "float"):
            same = same | F.coalesce(F.abs(x - y) <= relative * F.greatest(F.lit(1.0), F.abs(x), F.abs(y)), F.lit(False))
        return F.count_if(pair & ~same)

    counts = both.agg(F.count_if(~pair).alias("rows"), *(differ(c).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("mismatches")) for c in ("rows", *columns)))).alias("d")).select("d.*")


def known_minutes(minute: DataFrame, when: str) -> DataFrame:
    """The minute bars that had closed at a time."""
    return minute.where(cal.plus_minutes(F.col("ts_utc"), 1) <= F.lit(when).cast("timestamp_ntz"))


def recompute_check(minute: DataFrame, make: Callable[[DataFrame], DataFrame], cutoffs: list[str]) -> DataFrame:
    """Build the features from histories cut at each time; what was known must be as in the full build."""
    whole, out = make(minute), None
    for t in cutoffs:
        part = as_of(make(known_minutes(minute, t)), t)
        d = differences(as_of(whole, t), part).withColumn("cutoff", F.lit(t).cast("timestamp_ntz"))
        out = d if out is None else out.unionByName(d)
    return out


def perturb_after(minute: DataFrame, when: str, factor: float = 1.05) -> DataFrame:
    """The history with other prices and volumes after a time."""
    late = F.col("ts_utc") >= F.lit(when).cast("timestamp_ntz")
    return minute.withColumns({**{c: F.when(late, F.col(c) * factor).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}, "tick_volume": F.when(late, F.col("tick_volume") + 7).otherwise(F.col("tick_volume")), "spread_points": F.when(late, F.col("spread_points") + 40).otherwise(F.col("spread_points"))})


def perturb_check(minute: DataFrame, make: Callable[[DataFrame], DataFrame], when: str) -> DataFrame:
    return differences(as_of(make(minute), when), as_of(make(perturb_after(minute, when)), when))
