"""The search against running each hypothesis by itself."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import metrics, search, simulate, strategy
from tidemark.sources.ledger import Ledger

T0 = datetime(2025, 3, 10, 6)
SPACE = {
    "name": "demo", "family": "demo", "min_trades": 5, "top_k": 2, "population": 5, "max_trials": 9, "method": "evolutionary", "seed": 3,
    "blocks": [
        {"label": "strong close", "side": "long", "conditions": [{"feature": "x", "op": ">", "value": 0.3}, {"feature": "y", "op": "not_in", "value": [1, 2]}]},
        {"label": "weak close", "side": "short", "conditions": [{"feature": "x", "op": "between", "value": [-2.0, 0.1]}]},
    ],
    "sessions": [None, ["london"]], "vol_regimes": [None, ["low", "mid"]], "htf_align": [False, True], "stop_atr": [1.5], "target_atr": [1.0, 2.0, 3.0], "time_exit_bars": [12],
}


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(11)
    n = 640
    mid = (100 + np.cumsum(rng.normal(0.02, 0.05, 5 * n))).round(3)
    minutes = [("S", T0 + timedelta(minutes=i), m, round(m + 0.04, 3), round(m - 0.04, 3), m, 1.0, 2.0, 4.0, False, True) for i, m in enumerate(mid.tolist())]
    path = spark.createDataFrame(minutes, "symbol string, ts_utc timestamp_ntz, open double, high double, low double, close double, spread_optimistic double, spread_base double, spread_pessimistic double, in_rollover_window boolean, measured boolean")
    bars = []
    for k in range(n):
        t = T0 + timedelta(minutes=5 * k)
        bars.append(("S", t, t + timedelta(minutes=5), None if k % 50 == 9 else 12.0, k % 31 == 0, None if k % 17 == 0 else float(rng.normal()), int(rng.integers(0, 5)), "london" if 8 <= t.hour < 16 else "off", ["low", "mid", "high", None][k // 40 % 4], int(rng.integers(-1, 2))))
    features = spark.createDataFrame(bars, "symbol string, event_time timestamp_ntz, available_at timestamp_ntz, atr_pts double, hyg_no_entry boolean, x double, y int, session string, vol_regime string, h1_sw_trend int")
    m = search.market(features, path, path)
    cut = [(T0 + timedelta(minutes=5 * k)).strftime("%Y-%m-%d %H:%M:%S") for k in (420, 600)]
    return search.Market(m.features, m.path, {"A": (None, cut[0]), "B": tuple(cut)})


def alone(m, spec, tier):
    """One hypothesis the ordinary way: signals, trades, one position at a time, summary."""
    start, stop = m.tiers[tier]
    e = spec["exit"]
    rule = simulate.Exit(stop_atr=e["stop_atr"], target_atr=e["target_atr"], time_exit_bars=e["time_exit_bars"], flat_before_weekend=True)
    trades = simulate.label(strategy.signals(m.features, spec), m.path, rule, start=start, stop=stop).where(f"scenario = '{search.SCENARIO}'")
    return metrics.summary(simulate.taken(trades, ("symbol",)), ("symbol",)).first()


def test_search_equals_single_runs_and_resumes(spark, market, tmp_path):
    space = search.whole(SPACE)
    broken = Ledger(spark, f"file://{tmp_path}/a")
    search.run(space, market, broken, "s", most_generations=1)
    first = {r.spec_hash for r in broken.read("results", search.RESULTS).collect()}
    assert len(first) == 5 and broken.read("hypotheses", search.HYPOTHESES).count() > 5  # the next ones are registered, not run
    plain = lambda board: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in board]
    board = search.run(space, market, broken, "s").collect()
    again = search.run(space, market, Ledger(spark, f"file://{tmp_path}/b"), "s").collect()
    assert plain(board) == plain(again) and 5 < len(board) <= 9 and len({r.spec_hash for r in board}) == len(board)
    assert [r.rank for r in board] == list(range(1, len(board) + 1)) and {r.generation for r in board} >= {0, 1}
    genes = {r.spec_hash: tuple(r.gene) for r in broken.read("hypotheses", search.HYPOTHESES).collect()}
    for r in (board[0], board[1], board[-1]):
        want = alone(market, search.spec_of(space, genes[r.spec_hash]), "A")
        assert r.n == (want.n if want else 0)
        if want:
            assert (r.expectancy_r, r.max_dd_r) == pytest.approx((want.expectancy_r, want.max_dd_r), abs=1e-9)
    best = next(r for r in board if r.b_n is not None)
    want = alone(market, search.spec_of(space, genes[best.spec_hash]), "B")
    assert (best.b_n, best.b_expectancy_r) == (want.n, pytest.approx(want.expectancy_r, abs=1e-9))
    assert {r.status for r in board} <= {"rejected", "not_selected", "candidate"}


def test_bitmaps_fire_where_signals_do(spark, market):
    space = search.whole(SPACE)
    genes = {f"g{i}": g for i, g in enumerate([(0, 0, 0, 0, 0, 0, 0), (0, 1, 1, 1, 0, 0, 0), (1, 1, 0, 1, 0, 0, 0), (1, 0, 1, 0, 0, 0, 0)])}
    maps = search.bitmaps(market.features, search.predicates(space))
    demands = spark.createDataFrame([(h, n) for h, g in genes.items() for n in search.demanded(space, g)], "hyp string, name string")
    got = search.fired(maps, demands).collect()
    at = {r["__place"]: r.event_time for r in market.features.collect()}
    for h, g in genes.items():
        want = {r.event_time for r in strategy.signals(market.features, search.spec_of(space, g)).collect()}
        assert {at[r.place] for r in got if r.hyp == h} == want and want


def test_bitmaps_over_many_buckets(spark):
    n = 70_000
    features = spark.range(n).selectExpr("'S' as symbol", "id as __place", "id % 7 < 6 as a", "id % 5 > 0 as b")
    maps = search.bitmaps(features, {"a": F.col("a"), "b": F.col("b")})
    got = search.fired(maps, spark.createDataFrame([("h", "a"), ("h", "b"), ("one", "a")], "hyp string, name string")).groupBy("hyp").agg(F.count("*").alias("n"), F.sum("place").alias("s")).collect()
    want = {"h": [i for i in range(n) if i % 7 < 6 and i % 5 > 0], "one": [i for i in range(n) if i % 7 < 6]}
    assert {r.hyp: (r.n, r.s) for r in got} == {h: (len(v), sum(v)) for h, v in want.items()}


def test_genes():
    space = search.whole(SPACE | {"method": "grid", "max_trials": 1000})
    assert len(search.first_genes(space)) == 48 and len(search.first_genes(space | {"max_trials": 10})) == 10
    kids = search.children(space, [(0,) * 7, (1, 1, 1, 1, 0, 1, 0)], 1, set(), 20)
    assert len(kids) == len(set(kids)) == 20 and kids == search.children(space, [(0,) * 7, (1, 1, 1, 1, 0, 1, 0)], 1, set(), 20)
