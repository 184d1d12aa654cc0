"""The market queries against their twins, and small cases worked out by hand."""

from __future__ import annotations

import math
import os
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from tidemark.operators.asof import asof
from tidemark.operators.ewm import ewm
from tidemark.plans import metrics, research, store
from tidemark.sources import manifest
from tidemark.sources import tape as src

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
TWINS = [
    "ohlc_m5", "ohlc_by_symbol_h1", "bars_verify_full_outer", "gap_classify", "clock_weekly_mode", "tick_histogram", "spread_lookup_cascade", "swap_nights",
    "feat_anatomy", "feat_sequence", "feat_htf_h1", "feat_ema_stack", "swing_state", "breaks_retests", "signals_compile", "triple_barrier", "breakdown_sets",
    "bh_fdr", "walk_forward_folds", "latest_per_key", "set_difference", "overlay_events", "preregistration", "stream_sessions", "walk_forward_fixed",
]


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def sorted_rows(table):
    names = sorted(table.column_names)
    rows = zip(*(map(plain, table[c].to_pylist()) for c in names))
    return names, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@needs_tables
@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, duck, name):
    mine = sorted_rows(registry.queries()[name](spark, SF).toArrow())
    assert mine == sorted_rows(duck.execute(registry.oracle_sql()[name]).to_arrow_table())


@needs_tables
def test_no_feature_looks_ahead(spark):
    rows = registry.queries()["leakage_recompute"](spark, SF).collect()
    assert rows and not [r for r in rows if r["mismatches"]]


def at(minute: int) -> datetime:
    return datetime(2025, 3, 3, 8) + timedelta(minutes=minute)


def test_minute_bars_take_the_first_and_last_tick(spark):
    rows = [(3, "A", at(0) + timedelta(seconds=9), 5.0, 7), (1, "A", at(0), 2.0, 1), (2, "A", at(0), 9.0, 2), (4, "A", at(1), 1.0, 3)]
    ticks = spark.createDataFrame(rows, "event_id long, symbol string, ts_utc timestamp_ntz, bid double, spread_points int")
    first, second = src.minute_bars(ticks).orderBy("ts_utc").collect()
    assert (first["open"], first["high"], first["low"], first["close"], first["tick_volume"], first["spread_points"]) == (2.0, 9.0, 2.0, 5.0, 3, 7)
    assert second["open"] == second["close"] == 1.0


def test_asof_backward_forward_and_strict(spark):
    left = spark.createDataFrame([("A", at(0)), ("A", at(2)), ("B", at(2))], "symbol string, t timestamp_ntz")
    right = spark.createDataFrame([("A", at(1), 1), ("A", at(2), 2), ("A", at(4), 4)], "symbol string, u timestamp_ntz, v int")
    seen = lambda **k: [r["v"] for r in asof(left, right, "t", "u", ["v"], **k).orderBy("symbol", "t").collect()]
    assert seen() == [None, 2, None]
    assert seen(strict=True) == [None, 1, None]
    assert seen(direction="forward") == [1, 2, None]
    assert seen(direction="forward", strict=True) == [1, 4, None]


@pytest.mark.parametrize("chunk", [3, 1000])
def test_recursive_average_is_the_same_in_any_chunks(spark, chunk):
    values = [None, 1.0, 4.0, None, 2.0, 8.0, 5.0, 7.0, 3.0, None, 6.0]
    rows = [("A", at(i), v) for i, v in enumerate(values)] + [("B", at(0), 9.0)]
    df = spark.createDataFrame(rows, "symbol string, ts_utc timestamp_ntz, x double")
    out = ewm(df, {"y": ("x", 0.5, 2)}, chunk=chunk).where("symbol = 'A'").orderBy("ts_utc").collect()
    want, state, seen = [], None, 0
    for v in values:
        if v is not None:
            state, seen = v if state is None else 0.5 * state + 0.5 * v, seen + 1
        want.append(state if v is not None and seen >= 2 else None)
    got = [None if r["y"] is None or math.isnan(r["y"]) else r["y"] for r in out]
    assert got == want


def test_false_discoveries(spark):
    df = spark.createDataFrame([(0.001,), (0.02,), (0.03,), (0.5,)], "p_value double")
    rows = research.false_discoveries(df).orderBy("p_value").collect()
    assert rows[0]["q_value"] == pytest.approx(0.004)
    assert [r["rejected"] for r in rows] == [True, True, True, False]


def test_drawdown_counts_the_start(spark):
    rows = [("A", "base", at(i), at(i), r) for i, r in enumerate([-1.0, 2.0, -0.5, -0.5, 3.0])]
    df = spark.createDataFrame(rows, "symbol string, scenario string, decision_time timestamp_ntz, exit_time timestamp_ntz, r_net double")
    assert [r["dd_r"] for r in metrics.with_drawdown(df).orderBy("exit_time").collect()] == [1.0, 0.0, 0.5, 1.0, 0.0]


def test_as_of_hides_what_was_not_known(spark):
    df = spark.createDataFrame([("A", at(0), at(5)), ("A", at(5), at(10))], "symbol string, event_time timestamp_ntz, available_at timestamp_ntz")
    assert store.as_of(df, "2025-03-03 08:07:00").count() == 1
    with pytest.raises(store.LookAheadError):
        store.bar(df, "A", "2025-03-03 08:05:00", "2025-03-03 08:07:00")
    with pytest.raises(KeyError):
        store.bar(df, "A", "2025-03-03 09:00:00", "2025-03-03 10:00:00")


def test_versions_are_written_once_and_verified(spark, tmp_path):
    path = f"file://{tmp_path}/v1"
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    doc = manifest.write(df, path)
    assert doc["rows"] == 10 and manifest.read(spark, path, verify=True).count() == 10
    with pytest.raises(Exception, match="(?i)exists"):
        manifest.write(df, path)
    df.limit(3).write.mode("overwrite").parquet(f"{path}/data")
    with pytest.raises(ValueError):
        manifest.read(spark, path, verify=True)


@needs_tables
def test_recursive_averages_on_five_minute_bars(spark):
    from tidemark.plans import queries_features as qf

    bars = sorted(qf.m5(spark, SF).collect(), key=lambda r: (r.symbol, r.ts_utc))
    got = {}
    for name in ("feat_ema_stack_m5", "feat_rsi_adx_m5", "feat_macd_m5"):
        rows = registry.queries()[name](spark, SF).collect()
        assert len(rows) == len(bars)
        for r in rows:
            got.setdefault((r.symbol, r.ts_utc), {}).update(r.asDict())

    def fold(xs, alpha, least):
        """The recursion over the known values; null until there are enough of them."""
        acc, seen, out = None, 0, []
        for x in xs:
            if x is not None:
                acc, seen = x if acc is None else (1 - alpha) * acc + alpha * x, seen + 1
            out.append(acc if seen >= least else None)
        return out

    def over(f, *columns):
        return [None if None in xs else f(*xs) for xs in zip(*columns)]

    checked = 0
    for symbol in sorted({r.symbol for r in bars}):
        b = [r for r in bars if r.symbol == symbol]
        c, before = [r.close for r in b], [None, *b[:-1]]
        ema = {n: fold(c, 2 / (n + 1), n) for n in (9, 12, 21, 26, 50, 200)}
        macd = over(lambda x, y: x - y, ema[12], ema[26])
        signal = fold(macd, 2 / 10, 9)
        wild = lambda xs: fold(xs, 1 / 14, 14)
        gain, loss = (wild([p and max(s * (r.close - p.close), 0.0) for p, r in zip(before, b)]) for s in (1, -1))
        rsi = over(lambda g, x: (100.0 if g else 50.0) if x == 0 else 100 - 100 / (1 + g / x), gain, loss)
        up, down = ([0.0 if p is None else x for p, x in zip(before, xs)] for xs in ([p and r.high - p.high for p, r in zip(before, b)], [p and p.low - r.low for p, r in zip(before, b)]))
        tr = wild([r.high - r.low if p is None else max(r.high - r.low, abs(r.high - p.close), abs(r.low - p.close)) for p, r in zip(before, b)])
        plus, minus = (over(lambda m, t: 100 * m / t if t > 0 else None, wild([x if x > y and x > 0 else 0.0 for x, y in zip(*pair)]), tr) for pair in ((up, down), (down, up)))
        adx = wild(over(lambda x, y: 100 * abs(x - y) / (x + y) if x + y > 0 else None, plus, minus))
        want = {"rsi14": rsi, "plus_di14": plus, "minus_di14": minus, "adx14": adx}
        scaled = {f"ema{n}_dist_atr": over(lambda x, y: x - y, c, ema[n]) for n in (9, 21, 50, 200)} | {"macd_atr": macd, "macd_signal_atr": signal}
        for i, r in enumerate(b):
            row = got[r.symbol, r.ts_utc]
            for name, x in [(k, v[i]) for k, v in want.items()] + [(k, v[i] / r.atr if v[i] is not None and r.atr else None) for k, v in scaled.items()]:
                assert row[name] is None if x is None else row[name] == pytest.approx(x, abs=2e-6), (name, r)
                checked += x is not None
    assert checked > len(bars)
