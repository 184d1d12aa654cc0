"""Windows over bar order.

Every window is keyed: by symbol, or by symbol and chunk. ``in_chunks`` cuts a long series into chunks of rows that
carry the rows before (and after) them as warm-up, so that any operator with a bounded look-back runs in partitions of
bounded size with the same result; ``by_chunks`` does that for a whole group of columns. What depends on all rows before
is a scan (``operators.scan``).
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol",)
CHUNK = 8_192
PLACE = "__place"


#: What windows are keyed by where no keys are named.
_default: ContextVar[tuple[str, ...]] = ContextVar("keys", default=KEYS)


def over(keys=None, order=("ts_utc",)) -> WindowSpec:
    keys = keys or _default.get()
    return Window.partitionBy(*keys).orderBy(*order)


def rows(w: WindowSpec, n: int, until: int = 0) -> WindowSpec:
    """The n rows that end at the current one (or ``until`` rows from it)."""
    return w.rowsBetween(until - n + 1, until)


def full(f, x: Column, w: WindowSpec, n: int, until: int = 0, least: int | None = None) -> Column:
    """An aggregate over the last n rows; null where fewer than ``least`` (all n) of them hold a value."""
    frame = rows(w, n, until)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), f(x).over(frame))


def mean(x, w, n, **k):
    return full(F.avg, x, w, n, **k)


def std(x, w, n, sample: bool = True, **k):
    return full(F.stddev_samp if sample else F.stddev_pop, x, w, n, **k)


def highest(x, w, n, **k):
    return full(F.max, x, w, n, **k)


def lowest(x, w, n, **k):
    return full(F.min, x, w, n, **k)


def total(x, w, n, **k):
    return full(F.sum, x, w, n, **k)


def median(x, w, n, **k):
    """Exact, by sorting each frame: for short windows. Long ones: ``quantiles.rolling_median``."""
    return full(lambda c: F.percentile(c, F.lit(0.5)), x, w, n, **k)


def so_far(f, x: Column, w: WindowSpec) -> Column:
    return f(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def before(f, x: Column, w: WindowSpec) -> Column:
    """Over the rows strictly before."""
    return f(x).over(w.rowsBetween(Window.unboundedPreceding, -1))


def fill_forward(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def fill_backward(x: Column, keys=KEYS, order=("ts_utc",)) -> Column:
    """The next known value: the last one in descending order, since a frame that reaches forward is read anew for each row."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def crossing(a: Column, w: WindowSpec) -> Column:
    """1 where a rises above zero, -1 where it falls below, else 0; unknown values cross nothing."""
    was = F.lag(a).over(w)
    return F.when((a > 0) & (was <= 0), 1).when((a < 0) & (was >= 0), -1).otherwise(0)


def first_true(flag: Column, group: Column, keys=KEYS, order=("ts_utc",)) -> Column:
    """True on the first row of each group on which the flag holds."""
    w = Window.partitionBy(*keys, group).orderBy(*order)
    flag = F.coalesce(flag, F.lit(False))
    return flag & (F.coalesce(F.sum(flag.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0)


def row_index(df: DataFrame, into: str = "row", keys=KEYS, time: str = "ts_utc", order=("ts_utc",)) -> DataFrame:
    """Row number from 0 in each key's order, counted by days: no task sees more than a day of one key."""
    df = df.withColumn("_day", F.to_date(time))
    counts = df.groupBy(*keys, "_day").agg(F.count("*").alias("_n"))
    past = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_day").alias("_on"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_past"))
    own = F.row_number().over(over((*keys, "_day"), order)) - 1
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_day").eqNullSafe(F.col("_on"))]
    out = df.withColumn("_own", own).join(counts, on)
    return out.withColumn(into, (F.col("_own") + F.col("_past")).cast("long")).drop("_day", "_own", "_past", "_on", *(f"_{k}" for k in keys))


def placed(df: DataFrame, keys=KEYS, time: str = "ts_utc", order=("ts_utc",)) -> DataFrame:
    """``df`` with PLACE, the row number from 0 in each key's order. A series of symbols that has it keeps it: it is
    written with bars that many groups of columns read, and holds while no row is taken out."""
    return df if PLACE in df.columns and tuple(keys) == KEYS else row_index(df, PLACE, keys, time, order)


def in_chunks(df: DataFrame, look_back: int, size: int = CHUNK, keys=KEYS, time: str = "ts_utc", order=("ts_utc",), look_ahead: int = 0) -> DataFrame:
    """Rows with ``chunk`` and ``warm_up``; the rows that a chunk looks back (ahead) on are in it again as warm-up."""
    size = max(size, look_back, look_ahead)
    columns = df.columns
    df = placed(df, keys, time, order)
    chunk, at = F.floor(F.col(PLACE) / size), F.pmod(F.col(PLACE), F.lit(size))
    copy = lambda c, warm: F.struct(c.alias("chunk"), F.lit(warm).alias("warm_up"))
    copies = [copy(chunk, False), F.when(at >= size - look_back, copy(chunk + 1, True)), F.when((at < look_ahead) & (chunk > 0), copy(chunk - 1, True))]
    each = F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull()))
    return df.withColumn("_c", each).select(*(F.col(f"`{c}`") for c in columns), "_c.chunk", "_c.warm_up")


def without_warm_up(df: DataFrame) -> DataFrame:
    return df.where(~F.col("warm_up")).drop("chunk", "warm_up")


def by_chunks(df: DataFrame, look_back: int, make: Callable[[DataFrame], DataFrame], look_ahead: int = 0, size: int = CHUNK, keys=KEYS) -> DataFrame:
    """``make`` of ``df`` by chunks, for columns that need no more than ``look_back`` rows before and ``look_ahead`` after.

    Windows that ``make`` takes from ``over()`` without keys are then keyed by chunk. Within another by_chunks it is
    ``make`` itself: the outer one looks far enough.
    """
    if _default.get() != KEYS:
        return make(df)
    cut = in_chunks(df, look_back, size, keys, look_ahead=look_ahead)
    token = _default.set((*keys, "chunk"))
    try:
        return without_warm_up(make(cut))
    finally:
        _default.reset(token)
