"""As-of joins: one sorted pass over the union of both sides, keyed by day; no pair of rows is ever listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import KEYS


def asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, columns: list[str], keys=KEYS, direction: str = "backward", strict: bool = False) -> DataFrame:
    """``left`` with ``columns`` of the last right row at or before (forward: first at or after) each left row.

    strict leaves out right rows of the same time. A left row without such a right row, or without a time, gets nulls. Of right rows of
    the same time any one may count, so times should be unique by key. Times are timestamps or dates, or anything else
    that has an order: then a key is one sorted pass.

    Timestamps are passed by days: the last right row of a day is put before the first row of each day up to the next
    that has any, so a task holds a day of a key; beyond the right side's last day its last row counts. That is one row
    a key and day, and one a key, beside the rows themselves.
    """
    if right.schema[right_on].dataType.typeName() not in ("timestamp", "timestamp_ntz"):
        return _one_pass(left, right, left_on, right_on, columns, keys, direction, strict)
    forward = direction == "forward"
    kind, there = _struct(right, columns), F.struct(*columns)
    day, turn = F.to_date("_t"), (lambda c: F.desc(c)) if forward else F.col
    near = 1 if strict else 0
    mine = left.select(*keys, F.col(left_on).alias("_t"), F.to_date(left_on).alias("_day"), F.lit(1 - near).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(kind).alias("_right"))
    known = right.where(F.col(right_on).isNotNull()).select(*keys, F.col(right_on).alias("_t"), there.alias("_right")).withColumn("_day", day)
    other = known.select(*keys, "_t", "_day", F.lit(near).alias("_side"), F.lit(None).cast(_struct(left, left.columns)).alias("_left"), "_right")
    edge = (F.min_by if forward else F.max_by)("_right", "_t").alias("_right")
    days = known.groupBy(*keys, "_day").agg(edge)
    next_ = F.lead("_day").over(Window.partitionBy(*keys).orderBy(turn("_day")))
    step = F.date_sub if forward else F.date_add
    gap = F.sequence(step("_day", 1), "_next", F.expr(f"INTERVAL {-1 if forward else 1} DAY"))
    opening = days.withColumn("_next", next_).where("_next is not null").select(*keys, F.explode(gap).alias("_day"), "_right")
    opening = opening.select(*keys, F.lit(None).cast(left.schema[left_on].dataType).alias("_t"), "_day", F.lit(-1).alias("_side"), F.lit(None).cast(_struct(left, left.columns)).alias("_left"), "_right")
    order = (F.col("_side") >= 0, turn("_t"), "_side")
    found = F.last("_right", ignorenulls=True).over(Window.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    passed = mine.unionByName(other).unionByName(opening).withColumn("_found", found).where(F.col("_left").isNotNull())
    end = days.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg((F.min_by if forward else F.max_by)("_right", "_day").alias("_end"), (F.min if forward else F.max)("_day").alias("_end_day"))
    passed = passed.join(end, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    beyond = F.col("_day") < F.col("_end_day") if forward else F.col("_day") > F.col("_end_day")
    pick = F.when(beyond, F.col("_end")).otherwise(F.col("_found"))
    return passed.withColumn("_pick", pick).select("_left.*", *(F.col(f"_pick.{c}").alias(c) for c in columns))


def _one_pass(left: DataFrame, right: DataFrame, left_on: str, right_on: str, columns: list[str], keys, direction: str, strict: bool) -> DataFrame:
    """The same for keys without days: one sorted pass a key."""
    forward = direction == "forward"
    near = 0 if strict == forward else 1  # the side that comes first among equal times
    mine = left.select(*keys, F.col(left_on).alias("_t"), F.lit(1 - near).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(_struct(right, columns)).alias("_right"))
    other = right.select(*keys, F.col(right_on).alias("_t"), F.lit(near).alias("_side"), F.lit(None).cast(_struct(left, left.columns)).alias("_left"), F.struct(*columns).alias("_right"))
    both = mine.unionByName(other)
    # forward is backward in descending order: a frame that reaches forward would be read anew for each row
    order = (F.desc("_t"), F.desc("_side")) if forward else ("_t", "_side")
    found = F.last("_right", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_found", F.when(F.col("_t").isNotNull(), found))
    return both.where(F.col("_left").isNotNull()).select("_left.*", *(F.col(f"_found.{c}").alias(c) for c in columns))


def _struct(df: DataFrame, columns: list[str]):
    from pyspark.sql import types as T

    by = {f.name: f.dataType for f in df.schema.fields}
    return T.StructType([T.StructField(c, by[c]) for c in columns])


def nearest_key(left: DataFrame, right: DataFrame, key: str, columns: list[str], keys=()) -> DataFrame:
    """``left`` with ``columns`` of the right row whose key is nearest; of two as near the lower. Both sides once each way."""
    k = F.col(key)
    right = right.withColumn("_k", k)
    keyed_l, keyed_r = left.withColumn("_all", F.lit(1)), right.withColumn("_all", F.lit(1))
    by = keys or ("_all",)
    down = asof(keyed_l, keyed_r.select(*by, key, F.struct("_k", *columns).alias("_down")), key, key, ["_down"], by)
    both = asof(down, keyed_r.select(*by, key, F.struct("_k", *columns).alias("_up")), key, key, ["_up"], by, direction="forward")
    up = F.col("_down").isNull() | (F.col("_up._k") - k < k - F.col("_down._k"))
    pick = F.when(up & F.col("_up").isNotNull(), F.col("_up")).otherwise(F.col("_down"))
    return both.withColumn("_pick", pick).select(*left.columns, *(F.col(f"_pick.{c}").alias(c) for c in columns))
