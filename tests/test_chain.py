import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import chain
from tidemark.plans import simulate


def walked(links):
    at, met = min(links), []
    while at is not None:
        met.append(at)
        at = links[at]
    return met


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
def test_chains_of_any_chunks(spark, chunk):
    rng = random.Random(chunk)
    runs = {}
    for k, far in (("short", 3), ("long", 60), ("mixed", 400)):
        n = 300
        runs[k] = {i: (j if (j := i + 1 + rng.randrange(far)) < n else None) for i in range(n)}
    runs["one"] = {5: None}
    runs["gap"] = {3: 900, 4: 900, 900: None}
    rows = [(k, i, j) for k, links in runs.items() for i, j in links.items()]
    rng.shuffle(rows)
    got = chain.reached(spark.createDataFrame(rows, "k string, place long, next long"), ("k",), chunk).collect()
    for k, links in runs.items():
        assert sorted(r.place for r in got if r.k == k) == walked(links)


def test_one_position_at_a_time(spark, monkeypatch):
    """Overlaps, an exit at the very time of a decision, two sides of one time, several runs and small chunks."""
    monkeypatch.setattr(chain, "CHUNK", 16)
    rng = random.Random(9)
    t0 = datetime(2024, 1, 1)
    rows = []
    for scenario in ("base", "pessimistic"):
        for i in range(200):
            decided = t0 + timedelta(minutes=5 * rng.randrange(3000))
            rows.append(("S", scenario, decided, rng.choice([-1, 1]), decided + timedelta(minutes=5 * rng.choice([0, 1, 2, 30, 500])), rng.gauss(0, 1), 100.0))
    rows = list({r[:4]: r for r in rows}.values())
    schema = "symbol string, scenario string, decision_time timestamp_ntz, side int, exit_time timestamp_ntz, r_net double, risk_pts double"
    trades = spark.createDataFrame(rows, schema)
    want = []
    for scenario in ("base", "pessimistic"):
        free, equity = None, 10_000.0
        for r in sorted(r for r in rows if r[1] == scenario):
            if free is None or r[2] > free:
                free = r[4]
                lots = round(min(200.0, max(0.01, int(equity / 100 / 100.0 / 0.01 + 1e-9) * 0.01)), 8)
                equity += max(r[5] * 100.0 * lots, -equity)
                want.append((*r[1:4], round(equity, 6)))
    got = simulate.one_at_a_time(trades)
    assert got.columns == [*trades.columns, "lots", "pnl_usd", "equity_usd"]
    assert sorted((r.scenario, r.decision_time, r.side, round(r.equity_usd, 6)) for r in got.collect()) == sorted(want)
