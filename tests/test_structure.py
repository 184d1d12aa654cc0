"""Levels, lines and channels against plain loops; the whole feature table against its groups."""

from __future__ import annotations

import math
import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import geometry as geo
from tidemark.plans import queries_features as qf
from tidemark.plans import structure, table
from tidemark.sources import tape as src

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
K = 3


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(3)
    close = 100 + np.cumsum(rng.normal(0, 1, 700)).round(2)
    high, low = close + rng.exponential(0.5, 700).round(2), close - rng.exponential(0.5, 700).round(2)
    atr = np.where(rng.random(700) < 0.02, 0.0, 1.4 + 0.2 * np.sin(np.arange(700) / 50))
    return [(high[i].item(), low[i].item(), close[i].item(), atr[i].item()) for i in range(700)]


@pytest.fixture(scope="module")
def bars(spark, walk):
    rows = [("A", datetime(2025, 3, 3, 8) + timedelta(minutes=5 * i), *r) for i, r in enumerate(walk)]
    return spark.createDataFrame(rows, "symbol string, ts_utc timestamp_ntz, high double, low double, close double, atr double")


def pivots(values, up):
    s = 1 if up else -1
    x = [s * v for v in values]
    return [i for i in range(K, len(x) - K) if x[i] > max(x[i - K : i]) and x[i] >= max(x[i + 1 : i + K + 1])]


def same(got, want):
    return got is None and want is None if None in (got, want) else math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-9)


def test_levels_against_loops(spark, bars, walk):
    got = structure.level_features(bars, K).orderBy("ts_utc").collect()
    swings = sorted([(i, 0, walk[i][0]) for i in pivots([r[0] for r in walk], True)] + [(i, 1, walk[i][1]) for i in pivots([r[1] for r in walk], False)])
    levels = None
    for t, (high, low, close, atr) in enumerate(walk):
        if any(i + K == t for i, _, _ in swings):
            near = sorted(p for i, _, p in [s for s in swings if s[0] + K <= t][-geo.LEVEL_SWINGS :] if i >= t - geo.LEVEL_ROWS)
            levels, group = [], []
            for p in near if atr > 0 else []:
                if group and p > group[0] + geo.LEVEL_WIDTH * atr:
                    levels.append(group)
                    group = []
                group = [*group, p]
            levels = [(sum(g) / len(g), len(g)) for g in [*levels, group] if len(g) >= geo.LEVEL_TOUCHES]
        up = next((x for x in levels or [] if x[0] > close), None)
        down = next((x for x in reversed(levels or []) if x[0] <= close), None)
        per = lambda x: x / atr if atr > 0 else None  # noqa: B023, E731
        want = (up and per(up[0] - close), up and up[1], down and per(close - down[0]), down and down[1], up and per(up[0] - high), down and per(low - down[0]))
        assert all(same(got[t][c], w) for c, w in zip(geo.LEVEL_COLUMNS, want)), t
    assert sum(r["sr_above_touches"] is not None for r in got) > 100


@pytest.mark.parametrize("rising", [True, False])
def test_lines_against_loops(spark, bars, walk, rising):
    got = structure.line_features(bars, K).orderBy("ts_utc").collect()
    name, s = ("up", 1) if rising else ("dn", -1)
    own, far = ([r[1] for r in walk], [r[0] for r in walk]) if rising else ([r[0] for r in walk], [r[1] for r in walk])
    mine, others = pivots(own, not rising), pivots(far, rising)
    seen = 0
    for t, (_, _, close, atr) in enumerate(walk):
        known = [i for i in mine if i + K <= t]
        want = dict.fromkeys(("dist", "slope", "touches", "pos"))
        broke = False
        if len(known) >= 2:
            one, two = known[-2:]
            slope, formed = (own[two] - own[one]) / (two - one), two + K
            height = lambda i: own[one] + slope * (i - one)  # noqa: B023, E731
            through = [i for i in range(formed, t + 1) if s * (walk[i][2] - height(i)) < 0]
            base = walk[formed][3]
            if s * slope > 0 and two - one <= geo.LINE_SPAN and t - two <= geo.LINE_AGE and base > 0 and (not through or through[0] > formed) and (not through or through[0] == t):
                broke = bool(through)
                touches = sum(abs(own[i] - height(i)) <= geo.LINE_WIDTH * base for i in known[-geo.LINE_SWINGS - 1 :] if i >= one - geo.LINE_SPAN)
                width = max((s * (far[i] - height(i)) for i in others if one <= i and i + K <= formed), default=0)
                inside = s * (close - height(t)) / width if width > 0 else None
                want = {"dist": (close - height(t)) / atr if atr > 0 else None, "slope": slope * 12 / atr if atr > 0 else None, "touches": touches, "pos": inside if inside is None or rising else 1 - inside}
                seen += 1
        r = got[t]
        assert same(r[f"tl_{name}_dist_atr"], want["dist"]) and same(r[f"tl_{name}_slope_atr"], want["slope"]) and same(r[f"tl_{name}_touches"], want["touches"]) and same(r[f"ch_{name}_pos"], want["pos"]), t
        assert r[f"tl_{name}_break"] == broke
    assert seen > 50


def test_overlays_are_what_the_columns_say(spark, bars):
    b = structure.line_features(bars, K).orderBy("ts_utc").collect()
    lines = structure.lines_table(bars, K).collect()
    for kind, name in (("up", "up"), ("down", "dn")):
        mine = [r for r in lines if r["kind"] == kind]
        assert sum(sum(x["formed"] <= r["ts_utc"] <= x["ended"] for x in mine) for r in b) == sum(r[f"tl_{name}_touches"] is not None for r in b) > 50
        assert sum(x["broken"] for x in mine) == sum(r[f"tl_{name}_break"] for r in b)
    last = structure.level_features(bars, K).orderBy(F.desc("ts_utc")).first()
    prices = sorted(r["price"] for r in structure.levels_now(bars, K).collect())
    above = [p for p in prices if p > last["close"]]
    assert prices and ((last["sr_above_dist_atr"] is None) if not above else same(last["sr_above_dist_atr"], (above[0] - last["close"]) / last["atr"]))


def test_clusters(spark):
    rows = spark.createDataFrame([([13.1, 10.0, 11.0, 10.2, 13.0, 10.3],), ([],)], "p array<double>")
    got = [r["c"] for r in rows.select(geo.clusters(F.col("p"), F.lit(0.35)).alias("c")).collect()]
    assert [x["touches"] for x in got[0]] == [3, 1, 2] and got[1] == []
    assert got[0][0]["price"] == pytest.approx(30.5 / 3)


@needs_tables
def test_whole_table_has_what_the_groups_have(spark):
    assert len(table.FEATURES) == len(set(table.FEATURES)) == 163
    whole = table.whole(src.bars(spark, SF, 1))
    wide = {(r["symbol"], r["ts_utc"]): r for r in whole.collect()}
    for query in ("feat_anatomy", "feat_sequence", "feat_session", "feat_daily_sweeps", "feat_htf_m15", "feat_htf_h1", "feat_bollinger", "feat_stoch", "feat_vwap", "feat_obv", "swing_state", "sweeps", "breaks_retests", "h1_structure", "feat_rsi_adx_m5", "feat_macd_m5", "sr_levels", "channels"):
        rows = qf.QUERIES[query](spark, SF).collect()
        assert len(rows) == len(wide)
        for r in rows:
            other = wide[r["symbol"], r["ts_utc"]]
            for c in set(r.asDict()) & set(table.FEATURES):
                x, y = r[c], other[c]
                assert x == y or (isinstance(x, float) and y is not None and abs(x - y) < 2e-5), (query, c, x, y)


def test_cutoffs_are_wednesdays_amid_a_bar():
    start, end = datetime(2024, 1, 1), datetime(2024, 3, 7, 3)
    got = table.cutoffs(start, end)
    assert len(got) == 5 and all(t.weekday() == 2 and (t.hour, t.minute) == (14, 37) for t in got)
    assert got[-1].date().isoformat() == "2024-03-06" and got == sorted(got)
    assert table.cutoffs(start, datetime(2024, 3, 6, 9))[-1].date().isoformat() == "2024-02-28"  # today's is not over


@needs_tables
def test_a_leak_closes_the_gate(spark, monkeypatch, tmp_path):
    from pyspark.sql import Window

    from tidemark.plans import features

    def leaky(minute):
        b = features.with_atr(src.aggregate(minute, 5), False)
        return b.withColumn("next_close", F.lead("close").over(Window.partitionBy("symbol").orderBy("ts_utc")))

    monkeypatch.setattr(table, "whole", leaky)
    minute = src.bars(spark, SF, 1)
    with pytest.raises(table.FeatureGateError, match="next_close"):
        table.build(minute, f"file://{tmp_path}/v1", datetime(2024, 1, 1), datetime(2024, 1, 28))
    assert not os.path.exists(f"{tmp_path}/v1")
