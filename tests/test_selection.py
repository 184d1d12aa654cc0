import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection

INF = float("inf")


def _many(kind, n, rng):
    make = {
        "normal": lambda: rng.gauss(0, 1), "few": lambda: float(rng.randint(0, 3)), "one": lambda: 2.5,
        "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300), "far": lambda: rng.choice([-INF, INF, math.nan, 1.0, -1e308, 1e308]),
    }[kind]
    return [make() for _ in range(n)]


KINDS = ("normal", "few", "one", "wide", "far")


def ordered(xs):
    return sorted((x for x in xs if not math.isnan(x))) + [x for x in xs if math.isnan(x)]


def test_ranks_by_key(spark):
    data = {k: _many(k, 400, random.Random(k)) for k in KINDS}
    rows = [(k, x) for k, xs in data.items() for x in xs] + [("none", None), ("normal", None)]
    frame = spark.createDataFrame(rows, "k string, x double").repartition(5)
    ranks = {"first": F.lit(0), "mid": F.floor(F.col("n") / 2), "last": F.col("n") - 1, "out": F.col("n")}
    got = {r.k: r for r in selection.nth(frame, "x", ranks, ("k",)).collect()}
    assert set(got) == set(KINDS)
    for k, xs in data.items():
        want = ordered(xs)
        assert got[k].n == 400 and got[k].out is None
        for name, i in (("first", 0), ("mid", 200), ("last", 399)):
            assert got[k][name] == want[i] or (math.isnan(got[k][name]) and math.isnan(want[i]))


@pytest.mark.parametrize("bins", [2, 7])
def test_few_bins_take_more_passes(spark, monkeypatch, bins):
    monkeypatch.setattr(selection, "BINS", bins)
    xs = _many("normal", 60, random.Random(1))
    got = selection.nearest(spark.createDataFrame([(x,) for x in xs], "x double"), "x", {"lo": 0.01, "p": 0.3, "hi": 0.99}).first()
    assert (got.lo, got.p, got.hi) == tuple(sorted(xs)[round(q * 59)] for q in (0.01, 0.3, 0.99)) and got.n == 60


def test_whole_numbers_linear_and_nothing(spark):
    frame = spark.createDataFrame([(i * i,) for i in range(21)], "x int")
    got = selection.nearest(frame, "x", {"p": 0.5})
    assert got.schema["p"].dataType.typeName() == "integer" and got.first() == (100, 21)
    q = selection.linear(frame, "x", {"a": 0.13, "b": 0.5, "c": 1.0}).first()
    assert (q.a, q.b, q.c) == pytest.approx(tuple(np.quantile([i * i for i in range(21)], [0.13, 0.5, 1.0])))
    assert tuple(selection.nearest(frame.where("x < 0"), "x", {"p": 0.5}).first()) == (None, None)
    assert selection.nearest(frame.where("x < 0"), "x", {"p": 0.5}, ("x",)).count() == 0


def test_a_pass_orders_no_rows(spark):
    frame = spark.range(50_000).select(F.rand(3).alias("x"), F.lit("S").alias("k"))
    sought = spark.createDataFrame([("S", "p", 25_000, 0.0, 1.0)], "k string, name string, rank long, lo double, hi double")
    bins = selection._narrowed(frame.withColumnRenamed("x", "__x"), F.broadcast(sought), ["k"])
    plan = bins._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.split("HashAggregate")[-1] and bins.count() == 1
