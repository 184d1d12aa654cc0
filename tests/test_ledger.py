from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ledger as lg


@pytest.fixture
def ledger(spark, tmp_path):
    return lg.Ledger(spark, f"file://{tmp_path}/ledger")


def test_concurrent_unseals_grant_one(spark, ledger):
    ask = lambda i: lg.unseal(lg.Ledger(spark, ledger.path), "sweeps", f"h{i}", f"user{i}")
    with ThreadPoolExecutor(6) as pool:
        granted = list(pool.map(ask, range(6)))
    assert sum(granted) == 1
    assert ledger.read("unsealed", lg.UNSEALED).count() == 1 and ledger.version() == 1
    assert lg.unseal(ledger, "momentum", "h", "user") and not lg.unseal(ledger, "sweeps", "h9", "user")


def test_concurrent_appends_lose_nothing(spark, ledger):
    def add(i):
        lg.record_trials(lg.Ledger(spark, ledger.path), spark.createDataFrame([("f", f"h{i % 3}", "A", float(i), i)] * 2, lg.TRIALS))

    with ThreadPoolExecutor(5) as pool:
        list(pool.map(add, range(10)))
    assert ledger.version() == 10 and sorted(e["folder"] for e in ledger.entries()) == sorted({e["folder"] for e in ledger.entries()})
    for v in (0, 3, 10):
        assert ledger.read("trials", lg.TRIALS, v).count() == 2 * v
    row = lg.family_trials(ledger).first()
    assert (row.trials, row.distinct_trials) == (20, 3) and row.var_sharpe == pytest.approx(8.684210526)


def test_half_an_append_is_not_there(spark, ledger, monkeypatch):
    rows = spark.createDataFrame([("f", "h", "A", 1.0, 1)], lg.TRIALS)
    lg.record_trials(ledger, rows)

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(lg.Ledger, "_create", dies)
        with pytest.raises(OSError):
            lg.record_trials(ledger, rows)
    assert ledger.read("trials", lg.TRIALS).count() == 1
    lg.record_trials(ledger, rows)
    assert ledger.read("trials", lg.TRIALS).count() == 2 and ledger.version() == 2


def test_a_split_is_frozen_once(ledger):
    first = (datetime(2024, 1, 1), datetime(2024, 6, 1))
    assert lg.frozen_split(ledger, *first) == first
    assert lg.frozen_split(ledger, datetime(2025, 1, 1), datetime(2025, 6, 1)) == first


def test_an_append_that_was_overtaken_looks_again(spark, ledger, monkeypatch):
    """The condition is asked of the version that the append will follow, not of the one first seen."""
    rows = spark.createDataFrame([("f", "h", "A", 1.0, 1)], lg.TRIALS)
    seen = []

    def given(version):
        seen.append(version)
        if len(seen) == 1:
            lg.record_trials(lg.Ledger(spark, ledger.path), rows)
        return True

    assert ledger.append("trials", rows.withColumn("n", F.lit(7).cast("long")), given) == 2
    assert seen == [0, 1] and ledger.read("trials", lg.TRIALS).count() == 2
