from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.operators import windows as win
from tidemark.operators.asof import _one_pass, asof

START = datetime(2024, 1, 1)


def rows(n=400, every=97):
    """Two symbols, several bars a day, whole days without a bar, nulls and repeats."""
    out = []
    for i in range(n):
        t = START + timedelta(minutes=every * i + (i // 50) * 3000)
        x = None if i % 7 == 3 or 100 <= i < 160 else float((i * 37) % 11 - 5)
        out.append(("AB"[i % 2] if i < 300 else "A", t, x, (i // 9) % 3 if i % 13 else None))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(rows(), "symbol string, ts_utc timestamp_ntz, x double, v int").cache()


def pairs(df, *columns):
    return sorted(((r.symbol, r.ts_utc, *(r[c] for c in columns)) for r in df.collect()), key=str)


WHOLE = {
    "sum": (scan.SUM, F.sum), "max": (scan.MAX, F.max), "min": (scan.MIN, F.min),
    "last": (scan.LAST, lambda c: F.last(c, ignorenulls=True)), "first": (scan.FIRST, lambda c: F.first(c, ignorenulls=True)),
}


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("falling", [False, True])
def test_scans_are_whole_windows(bars, strict, falling):
    got = scan.scan(bars, {f"s_{n}": (s, F.col("x")) for n, (s, _) in WHOLE.items()}, strict=strict, falling=falling)
    order = F.desc("ts_utc") if falling else F.col("ts_utc")
    w = Window.partitionBy("symbol").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    want = bars.withColumns({f"s_{n}": f(F.col("x")).over(w) for n, (_, f) in WHOLE.items()})
    names = [f"s_{n}" for n in WHOLE]
    assert pairs(got, *names) == pairs(want, *names)
    assert set(got.columns) == {*bars.columns, *names}


@pytest.mark.parametrize("days", [1, 400])
def test_run_lengths(spark, days):
    values = [None if i % 31 < 4 else (i // 17) % 3 for i in range(300)]
    frame = spark.createDataFrame([("S", START + timedelta(hours=i * days), v) for i, v in enumerate(values)], "symbol string, ts_utc timestamp_ntz, v int")
    want, length = [], 0
    for i, v in enumerate(values):
        length = length + 1 if i and v == values[i - 1] else 1
        want.append(length)
    assert [r.run for r in scan.run_length(frame, "v", "run").orderBy("ts_utc").collect()] == want


def test_drawdown(bars):
    got = scan.drawdown(bars.where("x is not null"), "x", ("symbol",), "ts_utc", ("ts_utc",))
    level = {}
    for s, t, *_, cum, dd in sorted(pairs(got, "x", "cum", "dd")):
        now, top = level.get(s, (0.0, 0.0))
        now += next(r[2] for r in rows() if r[:2] == (s, t))
        top = max(top, now)
        level[s] = now, top
        assert (cum, dd) == (now, top - now)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_by_days_is_one_pass(spark, bars, direction, strict):
    known = [("A", START + timedelta(minutes=m), m) for m in (5, 97 * 4, 97 * 40, 97 * 41 + 1, 60_000)] + [("B", START + timedelta(days=9), 1), ("C", START, 2)]
    right = spark.createDataFrame(known, "symbol string, u timestamp_ntz, v2 int")
    left = bars.unionByName(spark.createDataFrame([("C", None, 1.0, 1), ("D", START, 1.0, 1), ("A", datetime(1999, 1, 1), 0.0, 0), ("A", datetime(2031, 1, 1), 0.0, 0)], bars.schema))
    args = (left, right, "ts_utc", "u", ["v2"], ("symbol",), direction, strict)
    assert pairs(asof(*args), "v2") == pairs(_one_pass(*args), "v2")


def test_chunks_with_rows_on_both_sides(bars):
    def make(b):
        w = win.over()
        return b.withColumns({"a": F.sum("x").over(w.rowsBetween(-5, 3)), "n": F.count(F.lit(1)).over(w.rowsBetween(-5, 3))})

    got = win.by_chunks(bars, 5, make, look_ahead=3, size=16)
    assert got.columns == [*bars.columns, "a", "n"]
    assert pairs(got, "a", "n") == pairs(make(bars), "a", "n")


def test_no_window_over_a_whole_symbol(spark):
    """On a long history of one symbol, the only windows keyed by symbol alone are those over one row a day."""
    n = 200_000
    long = spark.range(n, numPartitions=4).select(F.lit("S").alias("symbol"), F.expr("timestamp_ntz'2000-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id)").alias("ts_utc"), F.when(F.col("id") % 5000 == 7, F.col("id")).alias("x"))
    got = scan.filled(long, {"last": F.col("x")})
    at = F.floor((F.timestamp_diff("MINUTE", F.lit("2000-01-01").cast("timestamp_ntz"), "ts_utc") - 7) / 5000) * 5000 + 7
    assert got.where(~F.col("last").eqNullSafe(F.when(at > 0, at))).count() == 0
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) >= 2 and all("_chunk" in line for line in windows)
