"""Trades against a plain simulator, and the parts of research that no query covers."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import behaviours, costs, research, simulate, strategy
from tidemark.sources import tape as src
from tidemark.streaming import bars as stream

T0 = datetime(2025, 3, 12, 10)


def at(minute):
    return T0 + timedelta(minutes=minute)


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(5)
    mid = 100 + np.cumsum(rng.normal(0, 0.05, 1200)).round(3)
    path = []
    for i, m in enumerate(mid.tolist()):
        if rng.random() < 0.02:
            continue
        wide = rng.exponential(0.04, 2).round(3).tolist()
        path.append((at(i), m, m + wide[0], m - wide[1], round(m + rng.normal(0, 0.01), 3), *(float(x) for x in (1, 2, 4 + i % 3)), i % 97 < 10, i % 2 == 0))
    signals = [(at(5 * k), 1 if rng.random() < 0.5 else -1, float(rng.uniform(10, 25))) for k in range(0, 235, 2)]
    p = spark.createDataFrame([("A", *r) for r in path], "symbol string, ts_utc timestamp_ntz, open double, high double, low double, close double, spread_optimistic double, spread_base double, spread_pessimistic double, in_rollover_window boolean, measured boolean")
    s = spark.createDataFrame([("A", t, t - timedelta(minutes=5), side, a) for t, side, a in signals], "symbol string, decision_time timestamp_ntz, event_time timestamp_ntz, side int, atr_pts double")
    return path, signals, p, s


def by_hand(path, signals, rule, scenario):
    """One signal after the other, one minute after the other."""
    pt, col = 0.01, {"optimistic": 5, "base": 6, "pessimistic": 7}[scenario]
    slip_of = lambda atr, order, window: 0.0 if order == "limit" else (lambda f, sh, k: (f + sh * atr) * (k if order == "stop" and window else 1))(*costs.SLIPPAGE[scenario])
    out = []
    for decided, side, atr in signals:
        later = [r for r in path if r[0] >= decided]
        if not later or (later[0][0] - decided).total_seconds() > 300:
            continue
        first = later[0]
        slip = slip_of(atr, "market", False)
        entry = first[1] + (first[col] + slip) * pt if side > 0 else first[1] - slip * pt
        risk = rule.stop_atr * atr * pt
        stop, target = entry - side * risk, entry + side * rule.target_atr * atr * pt
        end = decided + timedelta(minutes=5 * rule.time_exit_bars)
        found = None
        for r in later:
            if r[0] >= end:
                break
            ask = 0 if side > 0 else r[col] * pt
            o, h, lo = r[1] + ask, r[2] + ask, r[3] + ask
            worse, better = (lo <= stop, h >= target) if side > 0 else (h >= stop, lo <= target)
            if r is not first and (o >= target if side > 0 else o <= target):
                found = (r, target, "target", "limit")
            elif r is not first and (o <= stop if side > 0 else o >= stop):
                found = (r, o, "stop_gap", "stop")
            elif worse:
                found = (r, stop, "stop", "stop")
            elif better:
                found = (r, target, "target", "limit")
            if found:
                break
            if rule.trail_atr is not None and (r[0].minute + 1) % 5 == 0:
                move = rule.trail_atr * atr * pt
                stop = max(stop, r[4] - move) if side > 0 else min(stop, r[4] + ask + move)
        if not found:
            rest = [r for r in later if r[0] >= end]
            r = rest[0] if rest else path[-1]
            price = (r[1] if rest else r[4]) + (0 if side > 0 else r[col] * pt)
            found = (r, price, "time" if rest else "end_of_data", "market")
        r, price, why, order = found
        price -= side * slip_of(atr, order, r[8]) * pt
        out.append((decided, side, why, r[0], (price - entry) * side / risk))
    return out


@pytest.mark.parametrize("trail", [None, 0.8])
@pytest.mark.parametrize("hours", [simulate.ROUND_HOURS, 1])
def test_trades_against_a_plain_simulator(spark, market, monkeypatch, trail, hours):
    monkeypatch.setattr(simulate, "ROUND_HOURS", hours)
    path, signals, p, s = market
    rule = simulate.Exit(stop_atr=1.0, target_atr=2.0, time_exit_bars=30, trail_atr=trail)
    trades = simulate.label(s, p, rule)
    rows = trades.collect()
    for scenario in simulate.SCENARIOS:
        want = by_hand(path, signals, rule, scenario)
        got = sorted((r["decision_time"], r["side"], r["exit_reason"], r["exit_time"], r["r_net"]) for r in rows if r["scenario"] == scenario)
        assert [g[:4] for g in got] == [w[:4] for w in sorted(want)]
        assert [g[4] for g in got] == pytest.approx([w[4] for w in sorted(want)], abs=1e-9)
    if trail is None:
        return
    taken = simulate.one_at_a_time(trades).where("scenario = 'base'").orderBy("decision_time").collect()
    free, equity, k = None, 10_000.0, 0
    risks = {r["decision_time"]: r["risk_pts"] * 0.01 for r in rows if r["scenario"] == "base"}
    for decided, _, _, left, r_net in sorted(by_hand(path, signals, rule, "base")):
        if free is not None and decided <= free:
            continue
        free = left
        lots = round(min(200.0, max(0.01, math.floor(equity / 100 / (risks[decided] * 100) / 0.01 + 1e-9) * 0.01)), 8)
        equity += max(r_net * risks[decided] * 100 * lots, -equity)
        assert (taken[k]["decision_time"], taken[k]["lots"]) == (decided, pytest.approx(lots))
        assert taken[k]["equity_usd"] == pytest.approx(equity, rel=1e-9)
        k += 1
    assert k == len(taken) > 10


def test_variants_are_what_single_runs_are(spark, market):
    _, _, p, s = market
    grid = research.grid({"stop_atr": [0.75, 1.5], "target_atr": [1.0, 2.0]})
    rule = simulate.Exit(stop_atr=F.col("stop_atr"), target_atr=F.col("target_atr"), time_exit_bars=24)
    got = {}
    for r in simulate.label(s, p, rule, variants=grid).collect():
        got.setdefault(int(r["variant"]), []).append((r["scenario"], r["decision_time"], r["exit_time"], round(r["r_net"], 9)))
    for i in (0, 3):
        one = simulate.label(s, p, simulate.Exit(time_exit_bars=24, **grid[i]))
        assert sorted(got[i]) == sorted((r["scenario"], r["decision_time"], r["exit_time"], round(r["r_net"], 9)) for r in one.collect())


def test_walk_forward_takes_the_best_of_the_training_span(spark):
    rng = np.random.default_rng(1)
    rows = [(v, datetime(2024, 1, 1) + timedelta(hours=int(h)), float(rng.normal(0.1 * int(v), 1))) for v in "012" for h in range(0, 480, 3)]
    trades = spark.createDataFrame(rows, "variant string, decision_time timestamp_ntz, r_net double")
    day = lambda d: datetime(2024, 1, d)
    folds = [(0, day(1), day(9), day(13)), (1, day(5), day(13), day(17)), (2, day(25), day(27), day(28))]
    got = {r["fold"]: r for r in research.walk_forward(trades, spark.createDataFrame(folds, "fold int, train_start timestamp_ntz, test_start timestamp_ntz, test_end timestamp_ntz")).collect()}
    assert set(got) == {0, 1}
    for k, a, b, c in folds[:2]:
        mean = {v: np.mean([r for x, t, r in rows if x == v and a <= t < b]) for v in "012"}
        best = max(mean, key=mean.get)
        test = [r for x, t, r in rows if x == best and b <= t < c]
        assert (got[k]["variant"], got[k]["test_n"]) == (best, len(test)) and got[k]["test_expectancy_r"] == pytest.approx(np.mean(test))


def test_bootstrap_and_drawdown(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0.2, 1, 400)
    rows = [("A", "base", datetime(2024, 1, 1) + timedelta(hours=i), float(x)) for i, x in enumerate(r)]
    t = spark.createDataFrame(rows, "symbol string, scenario string, decision_time timestamp_ntz, r_net double")
    b = research.bootstrap(t).first()
    half = 1.96 * r.std() / 20
    assert b["low"] == pytest.approx(r.mean() - half, abs=0.04) and b["high"] == pytest.approx(r.mean() + half, abs=0.04) and b["p_mean_le_0"] < 0.01
    few = research.bootstrap(t.limit(5)).first()
    assert few["n"] == 5 and few["low"] is None
    d = research.shuffled_drawdown(t).first()
    falls = []
    for _ in range(500):
        c = np.cumsum(rng.permutation(r))
        falls.append((np.maximum(np.maximum.accumulate(c), 0) - c).max())
    assert d["p50"] == pytest.approx(np.percentile(falls, 50), rel=0.1) and d["p95"] == pytest.approx(np.percentile(falls, 95), rel=0.15) and d["p50"] < d["p95"] < d["p99"]


def test_meta_filter_learns_from_the_past_only(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=1500)
    rows = [("A", datetime(2024, 1, 1) + timedelta(hours=i), float(v), float(rng.normal(0.8 * v, 0.5))) for i, v in enumerate(x)]
    t = spark.createDataFrame(rows, "symbol string, decision_time timestamp_ntz, x double, r_net double")
    scored = research.meta_filter(t, ["x"]).toPandas()
    assert set(scored["fold"]) == {1, 2, 3, 4} and len(scored) == pytest.approx(1200, abs=30)
    assert scored.loc[scored["probability"] > 0.6, "r_net"].mean() > 0.4 > -0.4 > scored.loc[scored["probability"] < 0.4, "r_net"].mean()
    choice = research.choose_threshold(spark.createDataFrame(scored)).collect()
    best = [r for r in choice if r["best"]]
    assert len(best) == 1 and best[0]["expectancy_r"] == max(r["expectancy_r"] for r in choice if r["enough"])


def test_behaviours_and_registers(spark):
    library = behaviours.library()
    assert len(library) == 18 and len({behaviours.definition_hash(b) for b in library}) == 18
    assert library[12]["conditions"][0] == {"feature": "tl_up_dist_atr", "op": "between", "value": [0.0, 0.3]}
    columns = sorted({c["feature"] for b in library for c in b["conditions"]})
    bar = {c: None for c in columns} | {"ret5_atr": 2.0, "close_loc": 0.8, "dir": 1, "retest_up": True}
    kinds = ", ".join(f"{c} {'boolean' if c.startswith(('retest', 'failed', 'sweep')) or c.endswith('_break') else 'double'}" for c in columns)
    row = tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in (bar[c] for c in columns))
    df = spark.createDataFrame([("A", at(5), at(0), 10.0, False, *row), ("A", at(10), at(5), 10.0, True, *row)], f"symbol string, available_at timestamp_ntz, event_time timestamp_ntz, atr_pts double, hyg_no_entry boolean, {kinds}")
    got = {(r["variant"], r["side"], r["decision_time"]) for r in behaviours.events(df, library).collect()}
    assert got == {("momentum_cont_long", 1, at(5)), ("breakout_retest_long", 1, at(5))}
    schema = "name string, hash string, proposed_at timestamp_ntz"
    none = spark.createDataFrame([], "name string, hash string, version int, registered_at timestamp_ntz")
    first = behaviours.registered(none, spark.createDataFrame([("a", "h1", at(0)), ("a", "h1", at(1)), ("b", "h1", at(2))], schema))
    again = behaviours.registered(first, spark.createDataFrame([("a", "h2", at(3)), ("a", "h1", at(4))], schema))
    assert {tuple(r) for r in again.collect()} == {("a", "h1", 1, at(0)), ("b", "h1", 1, at(2)), ("a", "h2", 2, at(3))}


def test_screen_finds_the_planted_edge(spark):
    rng = np.random.default_rng(9)
    rows = [(f"v{k}", datetime(2024, 1, 1) + timedelta(hours=i), "target" if x > 0 else "stop", float(x)) for k in range(8) for i, x in enumerate(rng.normal(0.6 if k == 3 else 0.0, 1, 120))]
    t = spark.createDataFrame(rows, "variant string, decision_time timestamp_ntz, exit_reason string, r_net double").withColumns({"r_before_costs": F.col("r_net"), "ambiguous": F.lit(False)})
    got = research.screen(t).collect()
    assert len(got) == 8 and [r["variant"] for r in got if r["discovery"]] == ["v3"]


def test_documents():
    known = {"dir": "int", "close_loc": "double", "session": "string"}
    spec = {"name": "x", "rules": [{"side": "long", "conditions": [{"feature": "close_loc", "op": ">", "value": 0.7}]}], "exit": {"stop_atr": 1.0}}
    assert strategy.validate(spec, known) == []
    bad = {"rules": [{"side": "up", "conditions": [{"feature": "nope", "op": ">", "value": 1}, {"feature": "session", "op": ">", "value": "asian"}, {"feature": "dir", "op": "between", "value": [2, 1]}, {"feature": "dir", "op": "in", "value": []}]}], "exit": {}}
    assert len(strategy.validate(bad, known)) == 6
    other = strategy.with_parameters(spec, {"rules.0.conditions.0.value": 0.8, "exit.stop_atr": 2.0})
    assert strategy.get_path(other, "rules.0.conditions.0.value") == 0.8 and strategy.get_path(spec, "exit.stop_atr") == 1.0
    assert strategy.spec_hash(spec) == strategy.spec_hash(spec | {"name": "y", "notes": "z"}) != strategy.spec_hash(other)
    with pytest.raises((KeyError, IndexError)):
        strategy.with_parameters(spec, {"rules.1.side": "short"})
    draft = strategy.draft_conditions({"a": True, "b": 3, "c": 0.95, "d": 2.0, "e": None}, {"a": "bool", "b": "count", "c": "frac", "d": "atr", "e": "atr"})
    assert [d["value"] for d in draft] == [True, 3, [0.8, 1.0], [1.4, 2.6]]


def test_checklist_and_sharpe():
    good = {"expectancy_r": 0.2, "n": 2000, "profit_factor": 1.4, "max_dd_r": 8.0, "max_dd_pct": 0.1}
    both = {"stability_year": 0.8, "stability_session": 0.9, "ambiguity_rate": 0.01, "deflated_excess": 0.02}
    out = research.checklist(good, good, both, None, 0, True)
    assert len(out["items"]) == 15 and out["verdict"] == "pending" and out["ready_to_unseal"]
    assert research.checklist(good, good | {"n": 100}, both, None, 0, True)["verdict"] == "rejected"
    assert research.checklist(good, good, both, {"expectancy_r": 0.15}, 1, True)["verdict"] == "candidate"
    assert research.checklist(good, good, both, {"expectancy_r": 0.05}, 1, True)["verdict"] == "rejected"
    assert research.expected_max_sharpe(1, 0.1) == 0.0 and research.expected_max_sharpe(100, 0.01) == pytest.approx(0.253, abs=0.01)
    d = research.deflated_sharpe(0.1, 500, 0.0, 3.0, 20, [0.0, 0.05, 0.1])
    assert d["excess"] == pytest.approx(0.1 - d["expected_max"]) and 0 < d["probability"] < 1


def test_stream_is_the_batch_as_it_was_known(spark, tmp_path):
    """Ticks in two files: after each, the stream holds the bars that the batch over the same ticks knows to be closed."""
    rng = np.random.default_rng(6)
    ticks = [("A", T0 + timedelta(seconds=int(s)), i, float(rng.normal(100, 1)), 1.0) for i, s in enumerate(np.sort(rng.integers(0, 7200, 600)))]
    schema = "symbol string, ts_utc timestamp_ntz, event_id long, bid double, ask double"
    for part, rows in (("a", ticks[:300]), ("b", ticks[300:])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream.run_to_table(stream.closed_bars(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
        seen = [t for t in ticks[: 300 if part == "a" else 600]]
        limit = seen[-1][1] - timedelta(minutes=1)
        got = {r["ts_utc"]: (r["open"], r["high"], r["low"], r["close"], r["tick_volume"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        want = {}
        for _, t, _, bid, _ in seen:
            start = t - timedelta(minutes=t.minute % 5, seconds=t.second)
            if start + timedelta(minutes=5) <= limit:
                want.setdefault(start, []).append(bid)
        assert got == {t: (v[0], max(v), min(v), v[-1], len(v)) for t, v in want.items()}


def test_own_ratio_commission_and_truncation(spark):
    h = spark.createDataFrame([("A", at(0), 10, 5.0), ("A", at(0), 15, 1.0), ("A", at(1), 7, 1.0)], "symbol string, ts_utc timestamp_ntz, spread_points long, seconds double")
    assert sorted(r["ratio"] for r in costs.own_ratio(h).collect()) == [1.0, 1.0, 1.5]
    assert costs.commission(3.0, "pessimistic", False) == 7.0 and costs.commission(3.0, "pessimistic", True) == 3.0 == costs.commission(3.0, "base", False)
    minute = spark.createDataFrame([("A", at(i), 1.0, 2.0, 0.5, 1.5, 1, 3) for i in range(12)], src.BAR)
    assert [r["m1_bars"] for r in src.truncated(minute, "2025-03-12 10:11:30", 5).orderBy("ts_utc").collect()] == [5, 5]
    assert src.truncated(minute, "2025-03-12 10:04:59", 5).count() == 0
