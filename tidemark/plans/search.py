"""Search for rules: hypotheses as ANDs of bitmaps over the bars, screened a generation at a time.

Every building block, session, regime and gate is a bitmap of the bars on which it *fails*, made once in one pass over the
features. A hypothesis fires where none of its bitmaps has a bit, so a generation is one OR by hypothesis and bucket of
32,768 bars. Every bar is priced once for each side and exit, not once for each hypothesis; a hypothesis then is a join of
its bars with prices, the rule of one position at a time, and a summary.

Hypotheses are written to a ledger before they run and their results after, an append for a generation each. So a search
that stops anywhere goes on from its last whole generation, with the same children, as these are drawn from the seed and
the number of the generation alone. A generation is bounded by ``population``, a search by ``max_trials``.

space: name, family, blocks (label, side, conditions), and the axes sessions, vol_regimes, htf_align, stop_atr, target_atr,
time_exit_bars; method grid, random or evolutionary; max_trials, population, min_trades, top_k, seed.
"""

from __future__ import annotations

import itertools
import json
import random
from dataclasses import dataclass, field
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import all_of
from tidemark.operators import windows as win
from tidemark.plans import metrics, research, simulate, strategy
from tidemark.sources.ledger import Ledger
from tidemark.sources.manifest import staged

AXES = ("blocks", "sessions", "vol_regimes", "htf_align", "stop_atr", "target_atr", "time_exit_bars")
DEFAULTS = {
    "sessions": [None], "vol_regimes": [None], "htf_align": [False], "stop_atr": [1.0], "target_atr": [1.5], "time_exit_bars": [24],
    "method": "grid", "max_trials": 120, "population": 40, "min_trades": 300, "top_k": 3, "seed": 7,
}
SCENARIO = "pessimistic"
HYPOTHESES = "search string, generation int, seq int, gene array<int>, label string, spec_hash string, spec string"
RESULTS = "search string, spec_hash string, n long, expectancy_r double, profit_factor double, max_dd_r double, win_rate double, total_r double, sharpe_per_trade double, passed boolean"


# genes and documents


def whole(space: dict) -> dict:
    return DEFAULTS | space


def spec_of(space: dict, gene: tuple[int, ...]) -> dict:
    """The strategy document of a gene, one index for each axis."""
    at = {axis: space[axis][i] for axis, i in zip(AXES, gene)}
    block = at["blocks"]
    conditions = list(block["conditions"])
    if at["htf_align"]:
        conditions.append({"feature": "h1_sw_trend", "op": "==", "value": 1 if block["side"] == "long" else -1})
    filters = {k: v for k, v in (("sessions", at["sessions"]), ("regimes", at["vol_regimes"])) if v}
    exit_ = {k: at[k] for k in ("stop_atr", "target_atr", "time_exit_bars")} | {"flat_before_weekend": True}
    return {"name": label_of(space, gene), "family": space["family"], "rules": [{"side": block["side"], "conditions": conditions}], "filters": filters, "exit": exit_}


def label_of(space: dict, gene: tuple[int, ...]) -> str:
    at = {axis: space[axis][i] for axis, i in zip(AXES, gene)}
    parts = [at["blocks"]["label"], "/".join(at["sessions"] or []), "vol " + "/".join(at["vol_regimes"]) if at["vol_regimes"] else "", "with the hour" if at["htf_align"] else ""]
    return ", ".join([p for p in parts if p] + [f"stop {at['stop_atr']:g}, target {at['target_atr']:g}, {at['time_exit_bars']} bars"])


def first_genes(space: dict) -> list[tuple[int, ...]]:
    """The whole grid or an even sample of it; else so many random genes."""
    sizes = [len(space[a]) for a in AXES]
    rng = random.Random(space["seed"])
    if space["method"] == "grid" and prod(sizes) <= 100_000:
        every = list(itertools.product(*map(range, sizes)))
        return every if len(every) <= space["max_trials"] else sorted(rng.sample(every, space["max_trials"]))
    most = space["max_trials"] if space["method"] == "random" else min(space["population"], space["max_trials"])
    found: set[tuple[int, ...]] = set()
    while len(found) < min(most, prod(sizes)):
        found.add(tuple(map(rng.randrange, sizes)))
    return sorted(found)


def children(space: dict, parents: list[tuple[int, ...]], generation: int, known: set[str], most: int) -> list[tuple[int, ...]]:
    """New genes of a generation: half are crossed from two parents, all moved by a step on one axis; known documents are passed over."""
    sizes = [len(space[a]) for a in AXES]
    rng = random.Random(f"{space['seed']}:{generation}")
    out, known = [], set(known)
    for _ in range(12 * most):
        gene = list(rng.choice(parents))
        if len(parents) > 1 and rng.random() < 0.5:
            other = rng.choice(parents)
            gene = [rng.choice(pair) for pair in zip(gene, other)]
        axis = rng.randrange(len(AXES))
        gene[axis] = (gene[axis] + rng.choice((-1, 1))) % sizes[axis]
        name = strategy.spec_hash(spec_of(space, tuple(gene)))
        if name not in known and len(out) < most:
            known.add(name)
            out.append(tuple(gene))
    return out


# bitmaps and prices


def predicates(space: dict) -> dict[str, Column]:
    """Everything that a hypothesis may demand, by name; an unknown value fails."""
    spec = lambda **f: strategy.gates({"filters": f})
    out = {"gate": all_of(list(spec().values()))}
    for i, b in enumerate(space["blocks"]):
        out[f"blocks-{i}"] = all_of([strategy.condition(c) for c in b["conditions"]])
    for axis, name in (("sessions", "sessions"), ("vol_regimes", "regimes")):
        out |= {f"{axis}-{i}": spec(**{name: v})[name] for i, v in enumerate(space[axis]) if v}
    if any(space["htf_align"]):
        out |= {f"align-{side}": strategy.condition({"feature": "h1_sw_trend", "op": "==", "value": v}) for side, v in (("long", 1), ("short", -1))}
    return out


def demanded(space: dict, gene: tuple[int, ...]) -> list[str]:
    block, session, regime, align = gene[:4]
    names = ["gate", f"blocks-{block}"]
    names += [f"{axis}-{i}" for axis, i in (("sessions", session), ("vol_regimes", regime)) if space[axis][i]]
    return names + ([f"align-{space['blocks'][block]['side']}"] if space["htf_align"][align] else [])


def bitmaps(features: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """symbol, bucket, bars, name, fails: for each bucket of bars (by place) the bits of those on which a predicate fails."""
    place = F.col(win.PLACE) + 1
    each = [F.bitmap_construct_agg(F.when(~x, F.bitmap_bit_position(place))).alias(name) for name, x in wanted.items()]
    wide = features.groupBy("symbol", F.bitmap_bucket_number(place).alias("bucket")).agg(F.count("*").alias("bars"), *each)
    long = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"`{name}`").alias("fails")) for name in wanted)))
    return wide.select("symbol", "bucket", "bars", long.alias("p")).select("symbol", "bucket", "bars", "p.*")


def fired(maps: DataFrame, demands: DataFrame) -> DataFrame:
    """hyp, symbol, place of every bar on which a hypothesis fires. demands: hyp, name (bounded by the generation)."""
    joined = maps.join(F.broadcast(demands), "name").groupBy("hyp", "symbol", "bucket").agg(F.first("bars").alias("bars"), F.bitmap_or_agg("fails").alias("fails"))

    def run(batches):
        for b in batches:
            hyps, symbols, places, counts = b.column(0), b.column(1), [], []
            for bucket, bars, fails in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                clear = np.flatnonzero(np.unpackbits(np.frombuffer(fails, np.uint8), bitorder="little")[:bars] == 0)
                places.append(clear + (bucket - 1) * 8 * len(fails))
                counts.append(len(clear))
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([hyps.take(at), symbols.take(at), pa.array(np.concatenate(places))], ["hyp", "symbol", "place"])

    return joined.select("hyp", "symbol", "bucket", "bars", "fails").mapInArrow(run, "hyp string, symbol string, place long")


@dataclass
class Market:
    """Features with PLACE, the minute path, and the bounds of the tiers (start and stop, half-open, as text or None).

    made: written bitmaps and prices, so that generations, and searches over the same axes, make them once.
    """

    features: DataFrame
    path: DataFrame
    tiers: dict[str, tuple[str | None, str | None]]
    made: dict[str, DataFrame] = field(default_factory=dict)

    def once(self, name: str, space: dict, axes: tuple[str, ...], make) -> DataFrame:
        key = name + json.dumps([space[a] for a in axes], sort_keys=True)
        if key not in self.made:
            self.made[key] = staged(make(), name)
        return self.made[key]


def market(features: DataFrame, path: DataFrame, minute: DataFrame) -> Market:
    """The market of one history: tiers by the shares of its span; the last tier is not there to be searched."""
    cut = research.tiers(minute).agg(F.min("b_start").alias("b"), F.min("c_start").alias("c")).first()
    at = lambda t: t.strftime("%Y-%m-%d %H:%M:%S")
    return Market(staged(win.placed(features, time="event_time", order=("event_time",)), "search-bars"), path, {"A": (None, at(cut.b)), "B": (at(cut.b), at(cut.c))})


def maps_of(space: dict, m: Market) -> DataFrame:
    return m.once("bitmaps", space, AXES[:4], lambda: bitmaps(m.features, predicates(space)))


def prices(space: dict, m: Market, tier: str) -> DataFrame:
    """The trade of every bar that passes the gate, for each side and exit of the space."""
    return m.once(f"prices-{tier}", space, ("blocks", *AXES[4:]), lambda: _prices(space, m, tier))


def _prices(space: dict, m: Market, tier: str) -> DataFrame:
    start, stop = m.tiers[tier]
    sides = sorted({1 if b["side"] == "long" else -1 for b in space["blocks"]})
    bars = m.features.where(predicates(space)["gate"]).select("symbol", win.PLACE, F.col("available_at").alias("decision_time"), "event_time", F.explode(F.array(*map(F.lit, sides))).alias("side"), "atr_pts")
    stops = [{"stop_atr": float(s), "target_atr": float(t)} for s in space["stop_atr"] for t in space["target_atr"]]
    numbers = bars.sparkSession.createDataFrame([(str(i), v["stop_atr"], v["target_atr"]) for i, v in enumerate(stops)], "variant string, stop_atr double, target_atr double")
    places = bars.select("symbol", "decision_time", F.col(win.PLACE).alias("place")).distinct()
    out = None
    for n in space["time_exit_bars"]:
        rule = simulate.Exit(stop_atr=F.col("stop_atr"), target_atr=F.col("target_atr"), time_exit_bars=n, flat_before_weekend=True)
        t = simulate.label(bars.drop(win.PLACE), m.path, rule, start=start, stop=stop, variants=stops).where(F.col("scenario") == SCENARIO)
        t = t.join(F.broadcast(numbers), "variant").withColumn("time_exit_bars", F.lit(n))  # one row a variant
        out = t if out is None else out.unionByName(t)
    return out.join(places, ["symbol", "decision_time"]).drop("variant")


def screened(space: dict, genes: dict[str, tuple[int, ...]], maps: DataFrame, priced: DataFrame) -> DataFrame:
    """A row a hypothesis (hyp, n and the rest of a summary) of those that trade at all, all of them in one frame."""
    spark = maps.sparkSession
    demands = spark.createDataFrame([(h, name) for h, g in genes.items() for name in demanded(space, g)], "hyp string, name string")
    own = [(h, 1 if space["blocks"][g[0]]["side"] == "long" else -1, float(space["stop_atr"][g[4]]), float(space["target_atr"][g[5]]), space["time_exit_bars"][g[6]]) for h, g in genes.items()]
    exits = spark.createDataFrame(own, "hyp string, side int, stop_atr double, target_atr double, time_exit_bars int")
    trades = fired(maps, demands).join(F.broadcast(exits), "hyp").join(priced, ["symbol", "place", "side", "stop_atr", "target_atr", "time_exit_bars"])
    return metrics.summary(simulate.taken(trades.drop("place"), ("hyp", "symbol")), ("hyp",))


# the search


def run(space: dict, m: Market, ledger: Ledger, search: str, most_generations: int | None = None) -> DataFrame:
    """Screens generation after generation on tier A, then looks at the best on tier B; returns the leaderboard.

    most_generations ends early, as a lost driver would; another call goes on.
    """
    space, spark = whole(space), m.features.sparkSession
    done_now = 0
    while True:
        hyps = [r.asDict() for r in ledger.read("hypotheses", HYPOTHESES).where(F.col("search") == search).orderBy("seq").collect()]  # max_trials at most
        scores = {r.spec_hash: r for r in ledger.read("results", RESULTS).where(F.col("search") == search).collect()}
        todo = {h["spec_hash"]: tuple(h["gene"]) for h in hyps if h["spec_hash"] not in scores}
        if todo:
            if most_generations is not None and done_now >= most_generations:
                break
            ledger.append("results", _results(space, search, todo, screened(space, todo, maps_of(space, m), prices(space, m, "A"))), note=search)
            done_now += 1
            continue
        if not hyps:
            genes, generation = first_genes(space), 0
        elif space["method"] != "evolutionary" or len(hyps) >= space["max_trials"]:
            break
        else:
            best = sorted(hyps, key=lambda h: (-_score(scores[h["spec_hash"]]), h["seq"]))
            parents = [tuple(h["gene"]) for h in best[: max(2, len(best) // 4)]]
            generation = max(h["generation"] for h in hyps) + 1
            genes = children(space, parents, generation, {h["spec_hash"] for h in hyps}, min(space["population"], space["max_trials"] - len(hyps)))
        rows, known = [], {h["spec_hash"] for h in hyps}
        for g in genes:
            spec = spec_of(space, g)
            name = strategy.spec_hash(spec)
            if name not in known:  # two genes may make one document
                known.add(name)
                rows.append((search, generation, len(hyps) + len(rows), list(g), label_of(space, g), name, json.dumps(spec, sort_keys=True)))
        if not rows:
            break
        ledger.append("hypotheses", spark.createDataFrame(rows, HYPOTHESES), note=search)
    return leaderboard(space, m, ledger, search)


def _score(r) -> float:
    """Rounded, so that the order in which sums were made does not tell equal results apart."""
    return -1e9 if r.expectancy_r is None else round(r.expectancy_r, 9)


def _results(space: dict, search: str, todo: dict, found: DataFrame) -> DataFrame:
    all_ = found.sparkSession.createDataFrame([(search, h) for h in todo], "search string, spec_hash string")
    r = all_.join(found.withColumnRenamed("hyp", "spec_hash"), "spec_hash", "left").na.fill(0, ["n"])
    passed = (F.col("n") >= space["min_trades"]) & F.coalesce(F.col("expectancy_r") > 0, F.lit(False))
    return r.select("search", "spec_hash", "n", "expectancy_r", "profit_factor", "max_dd_r", "win_rate", "total_r", "sharpe_per_trade", passed.alias("passed"))


def leaderboard(space: dict, m: Market, ledger: Ledger, search: str) -> DataFrame:
    """Every hypothesis with its result on tier A, best first; of those that passed, the top_k with their result on tier B.

    status: rejected on the screen, not_selected below the top, else candidate or rejected by the items of the checklist
    that tiers A and B decide.
    """
    space = whole(space)
    hyps = ledger.read("hypotheses", HYPOTHESES).where(F.col("search") == search)
    results = ledger.read("results", RESULTS).where(F.col("search") == search).drop("search")
    both = [(r.spec_hash, r.seq, r.gene, r) for r in hyps.join(results, "spec_hash").collect()]  # max_trials at most
    best = sorted(both, key=lambda x: (not x[3].passed, -_score(x[3]), x[1]))
    top = [x for x in best if x[3].passed][: space["top_k"]]
    second = {}
    if top:
        found = screened(space, {h: tuple(g) for h, _, g, _ in top}, maps_of(space, m), prices(space, m, "B"))
        second = {r.hyp: r for r in found.collect()}
    rows = []
    for k, (h, _, _, r) in enumerate(best):
        b, status = second.get(h), "rejected"
        if r.passed and (h not in {t[0] for t in top}):
            status = "not_selected"
        elif r.passed:
            items = research.checklist(r.asDict(), b.asDict() if b else {"expectancy_r": None, "n": 0}, None, None, 0, False)["items"]
            status = "rejected" if any(items[f"{i}_{t}"] is False for i in ("expectancy", "n", "profit_factor", "drawdown") for t in "AB") else "candidate"
        rows.append((k + 1, r.generation, r.label, h, status, r.n, r.expectancy_r, r.profit_factor, r.max_dd_r, b.n if b else None, b.expectancy_r if b else None))
    return hyps.sparkSession.createDataFrame(rows, "rank int, generation int, label string, spec_hash string, status string, n long, expectancy_r double, profit_factor double, max_dd_r double, b_n long, b_expectancy_r double")
