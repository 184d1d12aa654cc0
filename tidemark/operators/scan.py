"""Prefix scans over bar order by chunks of a day: no task holds more than a day of a key, nor one row a day of a key.

What a row needs of all rows before it is a state that can be put together from parts: a sum, a greatest value, the last
known one. Such a state is made for every chunk (reduce), carried from chunk to chunk over one row each (chain), and
joined to what a window within the chunk has found (combine). The result is that of one window over the whole key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import KEYS, over

_PAST = (Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class State:
    """over: the aggregate as a window, within a chunk and along the chain; reduce: of a whole chunk (value, place); combine: carry, own."""

    over: Callable[[Column], Column]
    reduce: Callable[[Column, Column], Column]
    combine: Callable[[Column, Column], Column]


def _added(carry: Column, own: Column) -> Column:
    return F.coalesce(carry + own, carry, own)


SUM = State(F.sum, lambda x, _: F.sum(x), _added)
MAX = State(F.max, lambda x, _: F.max(x), F.greatest)
MIN = State(F.min, lambda x, _: F.min(x), F.least)
#: The last (first) value that is not null.
LAST = State(lambda x: F.last(x, ignorenulls=True), lambda x, at: F.max_by(x, F.when(x.isNotNull(), at)), lambda carry, own: F.coalesce(own, carry))
FIRST = State(lambda x: F.first(x, ignorenulls=True), lambda x, at: F.min_by(x, F.when(x.isNotNull(), at)), F.coalesce)


def scan(df: DataFrame, into: dict[str, tuple[State, Column]], keys=KEYS, time: str = "ts_utc", order=None, strict: bool = False, falling: bool = False) -> DataFrame:
    """``df`` with each named state of a column over the rows up to each row, in the order of ``order`` (default: time).

    strict: over the rows before each row. falling: in descending order, so over the rows from each row on. The columns
    should be cheap to make, or ``df`` written: chunks are reduced in a branch of their own. A null time is a chunk that
    comes first (falling: last).
    """
    order = order or (time,)
    turn = (lambda c: F.col(c).desc()) if falling else F.col
    # for the reduction of a chunk the last place in falling order is the least
    d = df.withColumn("__chunk", F.to_date(time)).withColumns({f"__x_{n}": x for n, (_, x) in into.items()})
    reduce = {n: (FIRST.reduce if s is LAST else LAST.reduce if s is FIRST else s.reduce) if falling else s.reduce for n, (s, _) in into.items()}
    states = d.groupBy(*keys, "__chunk").agg(*(reduce[n](F.col(f"__x_{n}"), F.struct(*order)).alias(f"__s_{n}") for n in into))
    chain = Window.partitionBy(*keys).orderBy(turn("__chunk")).rowsBetween(*_PAST)
    states = states.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__chunk").alias("__k_chunk"), *(s.over(F.col(f"__s_{n}")).over(chain).alias(f"__c_{n}") for n, (s, _) in into.items()))
    own = Window.partitionBy(*keys, "__chunk").orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    d = d.withColumns({f"__o_{n}": s.over(F.col(f"__x_{n}")).over(own) for n, (s, _) in into.items()})
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__chunk").eqNullSafe(F.col("__k_chunk"))]
    d = d.join(states, on, "left")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in into]
    return d.select(*kept, *(s.combine(F.col(f"__c_{n}"), F.col(f"__o_{n}")).alias(n) for n, (s, _) in into.items()))


def filled(df: DataFrame, columns: dict[str, Column], backward: bool = False, **where) -> DataFrame:
    """The last known value of each column up to each row, or the next one from it on."""
    return scan(df, {n: (LAST, x) for n, x in columns.items()}, falling=backward, **where)


def run_length(df: DataFrame, value: str, into: str, keys=KEYS, time: str = "ts_utc", order=None) -> DataFrame:
    """Length so far of the run of equal values that a row is in; nulls equal one another.

    A chunk's state is its first and last value, whether they are one run, and the length of its last run; a run goes on
    over a border where the values on both sides are equal.
    """
    order = order or (time,)
    w = over((*keys, "__chunk"), order)
    d = df.withColumn("__chunk", F.to_date(time))
    new = F.lag(F.lit(1)).over(w).isNull() | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    d = d.withColumn("__rn", F.row_number().over(w)).withColumn("__from", F.when(new, F.col("__rn")))
    d = d.withColumn("__from", F.max("__from").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.col("__rn")
    chunks = d.groupBy(*keys, "__chunk").agg(F.min_by(F.struct(value), at).alias("__first"), F.max_by(F.struct(value), at).alias("__last"), F.max("__from").alias("__head"), F.count("*").alias("__n"))
    chain = over(keys, ("__chunk",))
    joins = (F.col("__head") == 1) & F.coalesce(F.col("__first").eqNullSafe(F.lag("__last").over(chain)), F.lit(False)) & F.lag("__n").over(chain).isNotNull()
    chunks = chunks.withColumn("__joins", joins).withColumn("__run", F.sum(F.when(F.col("__joins"), 0).otherwise(1)).over(chain))
    tail = F.sum(F.when(F.col("__joins"), F.col("__n")).otherwise(F.col("__n") - F.col("__head") + 1)).over(over((*keys, "__run"), ("__chunk",)).rowsBetween(Window.unboundedPreceding, 0))
    chunks = chunks.withColumn("__tail", tail)
    chunks = chunks.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__chunk").alias("__k_chunk"), F.lag("__last").over(chain).alias("__was"), F.lag("__tail").over(chain).alias("__carry"))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__chunk").eqNullSafe(F.col("__k_chunk"))]
    goes_on = (F.col("__from") == 1) & F.col("__carry").isNotNull() & F.struct(value).eqNullSafe(F.col("__was"))
    length = F.col("__rn") - F.col("__from") + 1 + F.when(goes_on, F.col("__carry")).otherwise(0)
    return d.join(chunks, on, "left").select(*(F.col(f"`{c}`") for c in df.columns if c != into), length.cast("int").alias(into))


def drawdown(df: DataFrame, value: str, keys, time: str, order, sums: str = "cum", falls: str = "dd") -> DataFrame:
    """The running sum of a column and its fall from the greatest sum so far, the start of 0 included.

    A chunk's state is its sum and its greatest running sum; the chain turns the latter into a level by the sums before.
    """
    own = over((*keys, "__chunk"), order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__chunk", F.to_date(time)).withColumn("__own", F.sum(value).over(own)).withColumn("__top", F.max("__own").over(own))
    chunks = d.groupBy(*keys, "__chunk").agg(F.sum(value).alias("__sum"), F.max("__own").alias("__best"))
    past = over(keys, ("__chunk",)).rowsBetween(*_PAST)
    chunks = chunks.withColumn("__before", F.coalesce(F.sum("__sum").over(past), F.lit(0.0)))
    chunks = chunks.withColumn("__peak", F.greatest(F.max(F.col("__before") + F.col("__best")).over(past), F.lit(0.0)))
    chunks = chunks.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__chunk").alias("__k_chunk"), "__before", "__peak")
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__chunk").eqNullSafe(F.col("__k_chunk"))]
    cum = F.col("__before") + F.col("__own")
    fall = F.greatest("__peak", F.col("__before") + F.col("__top"), F.lit(0.0)) - cum
    return d.join(chunks, on).select(*(F.col(f"`{c}`") for c in df.columns if c not in (sums, falls)), cum.alias(sums), fall.alias(falls))
