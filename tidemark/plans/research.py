"""Honest judgement of rules: studies, resampling, false discoveries, folds, grids, checklist."""

from __future__ import annotations

import itertools
import math
from datetime import datetime, timedelta
from statistics import NormalDist, variance

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import quantiles
from tidemark.operators.asof import asof
from tidemark.plans import metrics
from tidemark.sources.manifest import staged
from tidemark.sources.tape import POINT

#: Fixed value: the Euler-Mascheroni constant.
EULER_GAMMA = 0.5772156649015329
DRAWS, PERMUTATIONS, SEED = 2_000, 1_000, 20_240_101
FORWARD_BARS = (3, 6, 12, 24)


# studies


def triple_barrier(trades: DataFrame) -> DataFrame:
    """1 for the target, -1 for the stop, 0 for anything else."""
    reason = F.col("exit_reason")
    return trades.withColumn("label", F.when(reason == "target", 1).when(reason.startswith("stop"), -1).otherwise(0))


def study_stats(labelled: DataFrame, keys=("symbol", "scenario")) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    label = F.col("label")
    return labelled.groupBy(*keys).agg(
        F.count("*").alias("n"), share(label == 1).alias("target_rate"), share(label == -1).alias("stop_rate"), share(label == 0).alias("time_rate"),
        F.avg("r_net").alias("mean_r_net"), F.median("r_net").alias("median_r_net"), F.stddev_samp("r_net").alias("std_r_net"), F.avg("r_before_costs").alias("mean_r_gross"),
        share(F.col("r_net") > 0).alias("win_rate_net"), share(F.col("ambiguous")).alias("ambiguity_rate"),
    )


def forward_returns(signals: DataFrame, path: DataFrame, bars: tuple[int, ...] = FORWARD_BARS) -> DataFrame:
    """n_bars, n, mean_atr, hit_rate: the move from the entry's open, on the side's terms and in ATR."""
    opens = path.select("symbol", F.col("ts_utc").alias("_t"), F.col("open").alias("_open"))
    s = signals.withColumn("_sid", F.monotonically_increasing_id())
    s = asof(s, opens.withColumnRenamed("_t", "_t0").withColumnRenamed("_open", "_open0"), "decision_time", "_t0", ["_open0"], direction="forward").where("_open0 is not null")
    s = s.withColumn("n_bars", F.explode(F.array(*map(F.lit, bars)))).withColumn("_later", cal.plus_minutes(F.col("decision_time"), F.col("n_bars") * 5))
    s = asof(s, opens, "_later", "_t", ["_open"], direction="forward").where("_open is not null and atr_pts > 0")
    move = F.col("side") * (F.col("_open") - F.col("_open0")) / (F.col("atr_pts") * POINT)
    return s.groupBy("symbol", "n_bars").agg(F.count("*").alias("n"), F.avg(move).alias("mean_atr"), F.avg((move > 0).cast("double")).alias("hit_rate"))


def baseline(features: DataFrame, most: int = 30_000) -> DataFrame:
    """Every so many-th eligible bar, at most ``most`` or so a symbol, as signals of both sides."""
    ok = features.where(~F.coalesce(F.col("hyg_no_entry"), F.lit(True)) & (F.col("atr_pts") > 0))
    w = Window.partitionBy("symbol")
    k = ok.withColumns({"_k": F.row_number().over(w.orderBy("event_time")) - 1, "_n": F.count("*").over(w)})
    k = k.where(F.pmod(F.col("_k"), F.greatest(F.expr(f"_n div {most}"), F.lit(1))) == 0)
    return k.select("symbol", F.col("available_at").alias("decision_time"), "event_time", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"), "atr_pts")


def distribution(df: DataFrame, value: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Counts by bin of equal width between the nearest-rank q01 and q99; values beyond are in the outer bins."""
    x = df.select(F.col(value).cast("double").alias("x"), (F.coalesce(F.col(by).cast("string"), F.lit("unknown")) if by else F.lit("all")).alias("group")).where("x is not null and not isnan(x)")
    q = quantiles.nearest(x, "x", {"lo": 0.01, "hi": 0.99}).select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    rows = x.crossJoin(F.broadcast(q))  # one row
    inside = F.least(F.greatest("x", "lo"), F.col("hi"))
    at = F.least(F.floor((inside - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return rows.groupBy("group", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def category_shares(df: DataFrame, value: str, by: str, top: int = 12) -> DataFrame:
    """Shares of the commonest categories within each group."""
    x = df.select(F.coalesce(F.col(value).cast("string"), F.lit("none")).alias("category"), F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias("group"))
    counts = x.groupBy("group", "category").agg(F.count("*").alias("n"))
    best = counts.groupBy("category").agg(F.sum("n").alias("_all")).orderBy(F.desc("_all"), "category").limit(top)
    whole = Window.partitionBy("group")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(whole)).join(F.broadcast(best.select("category")), "category").select("group", "category", "n", "share")


def previous_day_sweeps(bars: DataFrame, level: str, least_depth: float = 0.0, most_depth: float | None = 1.5, first_only: bool = True, no_acceptance: bool = True, sessions: list[str] | None = None, least_bars: int = 120) -> DataFrame:
    """Bars that reach beyond the previous day's high (pdh) or low (pdl) and close back, as signals. Needs daily and session."""
    days = bars.groupBy("symbol", "trading_day").agg(F.count("*").alias("_bars"))
    before = F.lag("_bars").over(Window.partitionBy("symbol").orderBy("trading_day"))
    b = bars.join(days.select("symbol", "trading_day", before.alias("prev_day_bars")), ["symbol", "trading_day"])
    ok = F.col(f"{level}_sweep") & (F.col("atr_pts") > 0) & (F.col("prev_day_bars") >= least_bars) & (F.col(f"{level}_sweep_depth_atr") >= least_depth)
    if most_depth is not None:
        ok &= F.col(f"{level}_sweep_depth_atr") <= most_depth
    if no_acceptance:
        ok &= ~F.col(f"{level}_accepted_before")
    if first_only:
        ok &= F.col(f"{level}_sweeps_today") == 1
    if sessions:
        ok &= F.col("session").isin(sessions)
    price, side = ("prev_high", -1) if level == "pdh" else ("prev_low", 1)
    return b.where(F.coalesce(ok, F.lit(False))).select("symbol", F.col("available_at").alias("decision_time"), "event_time", F.lit(side).alias("side"), "atr_pts", F.col(price).alias("level"), F.col(f"{level}_sweep_depth_atr").alias("depth_atr"), "trading_day", "session")


# resampling


def bootstrap(trades: DataFrame, keys=("symbol", "scenario"), draws: int = DRAWS, seed: int = SEED, order: str = "decision_time") -> DataFrame:
    """Stationary bootstrap of the mean: low, high, p_mean_le_0. Blocks of n^(1/3) trades on average; nulls under 10 trades.

    The draws of a key are dealt to tasks, each with a seed of its own, so a key's returns (one number a trade) are what
    a task holds.
    """
    per = 100
    parts = trades.select(*keys, order, "r_net", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // per) - 1))).alias("part"))
    schema = ", ".join([*(f"{k} string" for k in keys), "n long", "m double"])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        r = p.sort_values(order, kind="stable")["r_net"].to_numpy()
        n = len(r)
        head = {k: p[k].iloc[0] for k in keys}
        if n < 10:
            return pd.DataFrame([head | {"n": n, "m": None}])
        rng = np.random.default_rng([seed, int(p["part"].iloc[0])])
        stay = rng.random((per, n)) >= 1 / max(1.0, n ** (1 / 3))
        stay[:, 0] = False
        begin = np.where(stay, 0, np.arange(n))
        begin = np.maximum.accumulate(begin, axis=1)
        jump = np.take_along_axis(rng.integers(n, size=(per, n)), begin, axis=1)
        means = r[(jump + np.arange(n) - begin) % n].mean(axis=1)
        return pd.DataFrame({**{k: [v] * per for k, v in head.items()}, "n": n, "m": means})

    sums = parts.groupBy(*keys, "part").applyInPandas(run, schema)
    return sums.groupBy(*keys).agg(F.max("n").alias("n"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg((F.col("m") <= 0).cast("double")).alias("p_mean_le_0"))


def shuffled_drawdown(trades: DataFrame, keys=("symbol", "scenario"), sims: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """p50, p95, p99 of the greatest fall of the running sum over random orders of the trades."""
    per = 100
    parts = trades.select(*keys, "decision_time", "r_net", F.explode(F.sequence(F.lit(0), F.lit(-(-sims // per) - 1))).alias("part"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        r = p.sort_values("decision_time", kind="stable")["r_net"].to_numpy()
        rng = np.random.default_rng([seed, int(p["part"].iloc[0])])
        sums = np.cumsum(rng.permuted(np.broadcast_to(r, (per, len(r))), axis=1), axis=1)
        falls = np.maximum(np.maximum.accumulate(sums, axis=1), 0) - sums
        return pd.DataFrame({**{k: [p[k].iloc[0]] * per for k in keys}, "dd": falls.max(axis=1)})

    dds = parts.groupBy(*keys, "part").applyInPandas(run, ", ".join([*(f"{k} string" for k in keys), "dd double"]))
    return dds.groupBy(*keys).agg(*(F.percentile("dd", F.lit(q)).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))


def cost_stress(trades: DataFrame, extra: tuple[int, ...] = (0, 10, 20, 50, 100, 150, 200, 300), keys=("symbol", "scenario")) -> DataFrame:
    """Expectancy with so many more points of spread on every trade, and the points at which it is nil."""
    s = trades.groupBy(*keys).agg(F.avg("r_net").alias("m"), F.avg(1 / F.col("risk_pts")).alias("inv"))
    s = s.withColumn("extra_points", F.explode(F.array(*map(F.lit, extra))))
    return s.select(*keys, "extra_points", (F.col("m") - F.col("extra_points") * F.col("inv")).alias("expectancy_r"), (F.col("m") / F.when(F.col("inv") > 0, F.col("inv"))).alias("breakeven_points"))


def false_discoveries(tests: DataFrame, p: str = "p_value", q: float = 0.1, keys=()) -> DataFrame:
    """Benjamini-Hochberg: q_value and whether it is at most q."""
    w = Window.partitionBy(*(keys or [F.lit(1)]))
    order = w.orderBy(F.col(p), *([c for c in tests.columns if c not in (p, *keys)][:1]))
    t = tests.withColumns({"_k": F.row_number().over(order), "_m": F.count(F.lit(1)).over(w)}).withColumn("_a", F.col(p) * F.col("_m") / F.col("_k"))
    t = t.withColumn("q_value", F.least(F.min("_a").over(w.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)))
    return t.withColumn("rejected", F.col("q_value") <= q).drop("_k", "_m", "_a")


def expected_max_sharpe(trials: int, var: float) -> float:
    """What the best of so many variants without skill is expected to reach."""
    if trials <= 1 or var <= 0:
        return 0.0
    z = NormalDist().inv_cdf
    return math.sqrt(var) * ((1 - EULER_GAMMA) * z(1 - 1 / trials) + EULER_GAMMA * z(1 - 1 / (trials * math.e)))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, trials: int, others: list[float]) -> dict:
    finite = [s for s in others if s is not None and math.isfinite(s)]
    var = variance(finite) if len(finite) >= 2 else (1 + 0.5 * sharpe * sharpe) / max(n - 1, 1)
    bar = expected_max_sharpe(trials, var)
    spread = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    prob = NormalDist().cdf((sharpe - bar) * math.sqrt((n - 1) / spread)) if n >= 2 and spread > 0 else None
    return {"sharpe": sharpe, "expected_max": bar, "excess": sharpe - bar, "probability": prob}


# tiers, folds, grids


def tiers(minute: DataFrame, first: float = 0.6, second: float = 0.8) -> DataFrame:
    """symbol, b_start, c_start: the midnights after these shares of each history. A is before, C after."""
    span = minute.groupBy("symbol").agg(F.min("ts_utc").alias("_a"), F.max("ts_utc").alias("_z"))
    seconds = cal.seconds(F.col("_z")) - cal.seconds(F.col("_a"))
    at = lambda q: F.date_add(F.to_date(F.timestamp_add("SECOND", F.floor(seconds * q), F.col("_a"))), 1).cast("timestamp_ntz")
    return span.select("symbol", at(first).alias("b_start"), at(second).alias("c_start"))


def with_tier(signals: DataFrame, cuts: DataFrame) -> DataFrame:
    """Signals with tier A, B or C by half-open bounds."""
    t = F.col("decision_time")
    return signals.join(cuts, "symbol").withColumn("tier", F.when(t < F.col("b_start"), "A").when(t < F.col("c_start"), "B").otherwise("C")).drop("b_start", "c_start")


def validation(trades: DataFrame, cuts: DataFrame) -> DataFrame:
    """A row for each scenario on tiers A, B and both together: the summary, how trades ended and how long they were held.

    Tier C is not there: it is looked at once, after everything else.
    """
    t = with_tier(trades, cuts).where("tier <> 'C'").withColumn("tier", F.explode(F.array(F.col("tier"), F.lit("AB"))))
    share = lambda c: F.avg(c.cast("double"))
    reason, held = F.col("exit_reason"), (cal.seconds(F.col("exit_time")) - cal.seconds(F.col("entry_time"))) / 60
    ends = t.groupBy("tier", "scenario").agg(
        share(reason == "target").alias("target_share"), share(reason.startswith("stop")).alias("stop_share"), share(reason == "time").alias("time_share"),
        F.avg(held).alias("mean_held_min"), F.max(held).alias("longest_held_min"),
    )
    return metrics.summary(t, ("tier", "scenario")).join(ends, ["tier", "scenario"])


def walk_forward(trades: DataFrame, fold_table: DataFrame, least: int = 10) -> DataFrame:
    """One row a fold: the variant that was best on its training span, and how it did on the test span.

    ``trades``: variant, decision_time, r_net (one scenario). Every trade meets the folds that it belongs to, as training
    or as test; the rest are aggregates. A fold without ``least`` training trades of any variant chooses none.
    """
    t = F.col("decision_time")
    role = F.when((t >= F.col("train_start")) & (t < F.col("test_start")), "train").when((t >= F.col("test_start")) & (t < F.col("test_end")), "test")
    rows = trades.join(F.broadcast(fold_table), (t >= F.col("train_start")) & (t < F.col("test_end"))).withColumn("role", role)  # some dozens of folds
    sums = rows.groupBy("fold", "variant").agg(*(f(F.when(F.col("role") == r, F.col("r_net"))).alias(f"{r}_{n}") for r in ("train", "test") for f, n in ((F.count, "n"), (F.avg, "r"), (F.sum, "total"))))
    order = Window.partitionBy("fold").orderBy(F.desc("train_r"), "variant")
    best = sums.where(F.col("train_n") >= least).withColumn("_k", F.row_number().over(order)).where("_k = 1")
    return best.select("fold", "variant", F.col("train_n"), F.col("train_r").alias("train_expectancy_r"), F.col("test_n"), F.col("test_r").alias("test_expectancy_r"), F.coalesce("test_total", F.lit(0.0)).alias("test_total_r"))


def lift(study: DataFrame, base: DataFrame, keys=("symbol", "scenario")) -> DataFrame:
    """study_stats of a pattern beside those of its baseline, with the sample's verdict by the number of trades."""
    own = study.select(*keys, "n", "target_rate", "mean_r_net", "mean_r_gross")
    other = base.select(*keys, F.col("target_rate").alias("base_target_rate"), F.col("mean_r_net").alias("base_mean_r_net"))
    return own.join(other, list(keys)).withColumns({"lift_target_rate": F.col("target_rate") - F.col("base_target_rate"), "lift_r_net": F.col("mean_r_net") - F.col("base_mean_r_net"), "sufficient": F.col("n") >= GATES["n_B"]})


def screen(trades: DataFrame, q: float = 0.1, keys=("variant",)) -> DataFrame:
    """One row a behaviour (trades of one scenario): n, rates, p of a mean at or below zero, q_value and whether it is a discovery."""
    stats = study_stats(triple_barrier(trades), keys).select(*keys, "n", "target_rate", "mean_r_gross", "mean_r_net")
    p = bootstrap(trades, keys).select(*keys, F.col("p_mean_le_0").alias("p_value"))
    tested = stats.join(p, list(keys), "left")
    found = false_discoveries(tested.where("p_value is not null"), "p_value", q)
    return found.withColumnRenamed("rejected", "discovery").unionByName(tested.where("p_value is null"), allowMissingColumns=True)


def checklist_rows(metrics: DataFrame) -> DataFrame:
    """name, item, passed of what metrics of tiers A and B can decide: one row an item.

    ``metrics``: name, tier and the columns of a summary; a tier that is missing leaves its items open (null).
    """
    at = lambda tier, c: F.max(F.when(F.col("tier") == tier, F.col(c)))
    items = []
    for tier in "AB":
        items += [(f"expectancy_{tier}", at(tier, "expectancy_r") >= GATES["expectancy_r"]), (f"n_{tier}", at(tier, "n") >= GATES[f"n_{tier}"]), (f"profit_factor_{tier}", at(tier, "profit_factor") >= GATES["profit_factor"]), (f"drawdown_{tier}", at(tier, "max_dd_r") <= GATES["max_dd_r"])]
    wide = metrics.groupBy("name").agg(F.array(*(F.struct(F.lit(n).alias("item"), x.alias("passed")) for n, x in items)).alias("items"))
    return wide.select("name", F.explode("items").alias("i")).select("name", "i.*")




def folds(spark, start: datetime, end: datetime, train_months: int = 12, test_months: int = 3, least_days: int = 20) -> DataFrame:
    """fold, train_start, test_start, test_end: rolling months, from the first whole one; a last test that is too short is left out."""
    lit = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    first = F.date_trunc("month", lit(start)).cast("date")
    first = F.when(F.dayofmonth(lit(start)) > 1, F.add_months(first, 1)).otherwise(first)
    steps = F.sequence(F.lit(0), F.greatest(F.floor(F.months_between(lit(end).cast("date"), first) / test_months).cast("int"), F.lit(0)))
    f = spark.range(1).select(first.alias("first"), F.explode(steps).alias("fold"))
    f = f.withColumn("train_start", F.add_months("first", F.col("fold") * test_months)).withColumn("test_start", F.add_months("train_start", train_months))
    f = f.select("fold", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("train_start", "test_start")), F.least(F.add_months("test_start", test_months).cast("timestamp_ntz"), lit(end)).alias("test_end"))
    return f.where((F.col("test_start") < lit(end)) & (F.datediff("test_end", "test_start") >= least_days))


def grid(parameters: dict[str, list], most: int = 400) -> list[dict]:
    out = [dict(zip(parameters, v)) for v in itertools.product(*parameters.values())]
    if len(parameters) > 3 or len(out) > most:
        raise ValueError(f"at most 3 parameters and {most} variants")
    return out


def plateau(table: DataFrame, axes: list[str], least_trades: int = 30) -> DataFrame:
    """The best variant and whether its neighbours, one step away on one axis, hold up: plateau, slope or spike."""
    t = table
    for a in axes:
        t = t.withColumn(f"_{a}", F.dense_rank().over(Window.orderBy(a)))
    best = t.where((F.col("n") >= least_trades) & F.col("expectancy_r").isNotNull()).orderBy(F.desc("expectancy_r"), *axes).limit(1)
    best = best.select(*(F.col(a).alias(f"best_{a}") for a in axes), *(F.col(f"_{a}").alias(f"_b{a}") for a in axes), F.col("expectancy_r").alias("best_r"))
    steps = sum((F.abs(F.col(f"_{a}") - F.col(f"_b{a}")) for a in axes), F.lit(0))
    near = t.crossJoin(F.broadcast(best)).where(steps == 1)  # one row
    out = near.groupBy(*(f"best_{a}" for a in axes), "best_r").agg(F.avg("expectancy_r").alias("near_r"), F.count("*").alias("neighbours"))
    share = F.col("near_r") / F.when(F.col("best_r") > 0, F.col("best_r"))
    return out.withColumn("ratio", share).withColumn("shape", F.when(share >= 0.7, "plateau").when(share >= 0.4, "slope").otherwise("spike"))


#: What a rule must reach to be a candidate.
GATES = {"expectancy_r": 0.10, "n_A": 1000, "n_B": 250, "profit_factor": 1.15, "max_dd_r": 15.0, "max_dd_pct": 0.20, "stability": 0.70, "ambiguity": 0.05, "holdout_share": 0.5}


def checklist(a: dict | None, b: dict | None, ab: dict | None, c: dict | None, accesses: int, calibrated: bool) -> dict:
    """Fifteen items, each passed, failed or pending (None); a single failure rejects."""
    items: dict[str, bool | None] = {}
    get = lambda m, k: (m or {}).get(k)
    at_least = lambda v, t: None if v is None else v >= t
    for tier, m in (("A", a), ("B", b)):
        items[f"expectancy_{tier}"] = at_least(get(m, "expectancy_r"), GATES["expectancy_r"])
        items[f"n_{tier}"] = at_least(get(m, "n"), GATES[f"n_{tier}"])
        items[f"profit_factor_{tier}"] = at_least(get(m, "profit_factor"), GATES["profit_factor"])
        items[f"drawdown_{tier}"] = None if not m else get(m, "max_dd_r") is not None and m["max_dd_r"] <= GATES["max_dd_r"] and (get(m, "max_dd_pct") or 0) <= GATES["max_dd_pct"]
    for k in ("year", "session"):
        s = get(ab, f"stability_{k}")
        items[f"stability_{k}"] = None if not ab else s is not None and s >= GATES["stability"]
    items["ambiguity"] = None if not ab else get(ab, "ambiguity_rate") is not None and ab["ambiguity_rate"] <= GATES["ambiguity"]
    items["deflated_sharpe"] = None if not ab else get(ab, "deflated_excess") is not None and ab["deflated_excess"] > 0
    held, own = get(c, "expectancy_r"), get(a, "expectancy_r")
    items["holdout"] = None if not c else held is not None and own is not None and held > 0 and held >= GATES["holdout_share"] * own
    items["holdout_accesses"] = None if accesses == 0 else accesses == 1
    items["cost_profile"] = True if calibrated else None
    failed, open_ = [k for k, v in items.items() if v is False], [k for k, v in items.items() if v is None]
    return {"items": items, "verdict": "rejected" if failed else "pending" if open_ else "candidate", "ready_to_unseal": not failed and set(open_) <= {"holdout", "holdout_accesses"}}


# meta-filter


def meta_filter(labelled: DataFrame, columns: list[str], n_folds: int = 5, embargo_days: int = 1, least_train: int = 100, seed: int = SEED) -> DataFrame:
    """Out-of-fold probability that a trade makes money, by boosted trees: decision_time, r_net, fold, probability.

    Folds are blocks of whole days; a fold's model sees only trades decided before the block began, less the embargo. Folds
    without enough such trades are left out. Missing values get a value of their own, below all others.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = labelled.select("decision_time", "r_net", (F.col("r_net") > 0).cast("double").alias("label"), *(F.coalesce(F.col(c).cast("double"), F.lit(-1e9)).alias(c) for c in columns))
    # blocks of equal numbers of trades, cut by the day that the running count of days reaches each share
    days = x.groupBy(F.to_date("decision_time").alias("_day")).agg(F.count("*").alias("_n"))
    upto = days.withColumn("_to", F.sum("_n").over(Window.orderBy("_day")))
    cut = upto.crossJoin(x.agg(F.count("*").alias("_all"))).select("_day", F.least(F.floor((F.col("_to") - F.col("_n")) * n_folds / F.col("_all")), F.lit(n_folds - 1)).cast("int").alias("fold"))
    x = x.withColumn("_day", F.to_date("decision_time")).join(cut, "_day").drop("_day")
    x = staged(VectorAssembler(inputCols=columns, outputCol="features").transform(x).select("decision_time", "r_net", "label", "fold", "features"), "matrix")
    begins = {r["fold"]: r["t"] for r in x.groupBy("fold").agg(F.min("decision_time").alias("t")).collect()}
    out = None
    for k in range(1, n_folds):
        if k not in begins:
            continue
        past = x.where(F.col("decision_time") < F.lit(begins[k] - timedelta(days=embargo_days)).cast("timestamp_ntz"))
        if past.count() < least_train or past.select("label").distinct().count() < 2:
            continue
        model = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.1, seed=seed).fit(past)
        scored = model.transform(x.where(F.col("fold") == k)).select("decision_time", "r_net", "fold", vector_to_array("probability")[1].alias("probability"))
        out = scored if out is None else out.unionByName(scored)
    return out if out is not None else x.select("decision_time", "r_net", "fold", F.lit(None).cast("double").alias("probability")).limit(0)


def choose_threshold(scored: DataFrame, shares: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7), least_share: float = 0.25, least: int = 30) -> DataFrame:
    """One row a quantile of the probability: threshold, kept, expectancy_r; best marks the one to use."""
    cuts = scored.agg(*(F.percentile("probability", F.lit(q)).alias(f"q{i}") for i, q in enumerate(shares)), F.count("*").alias("n_all"))
    rows = scored.crossJoin(F.broadcast(cuts))  # one row
    long = rows.select("r_net", "probability", "n_all", F.explode(F.array(*(F.struct(F.lit(q).alias("quantile"), F.col(f"q{i}").alias("threshold")) for i, q in enumerate(shares)))).alias("t")).select("r_net", "probability", "n_all", "t.*")
    out = long.where("probability >= threshold").groupBy("quantile", "threshold").agg(F.count("*").alias("kept"), F.avg("r_net").alias("expectancy_r"), F.max("n_all").alias("n_all"))
    out = out.withColumn("enough", (F.col("kept") >= least) & (F.col("kept") >= least_share * F.col("n_all")))
    best = F.max(F.when(F.col("enough"), F.struct("expectancy_r", -F.col("quantile")))).over(Window.partitionBy(F.lit(1)))
    return out.withColumn("best", F.coalesce(F.struct("expectancy_r", -F.col("quantile")) == best, F.lit(False))).drop("n_all")
