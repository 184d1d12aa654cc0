"""Trade simulation on the minute path.

Where a signal would exit depends on the path after it and on nothing else, so all signals of all scenarios are priced
in parallel: as-of joins find the entry bar and the bar that ends the search, a join by hour buckets brings the minutes
between the two, and one aggregate a signal finds the first bar that hits under each scenario. The rule of one position
at a time is then a chain of pointers among priced signals.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import calendar as cal
from tidemark.operators import chain
from tidemark.operators import windows as win
from tidemark.operators.asof import asof
from tidemark.plans import costs
from tidemark.sources.manifest import staged
from tidemark.sources.tape import POINT

SCENARIOS = ("optimistic", "base", "pessimistic")
LATEST_ENTRY_S = 300
#: Hours of path that one round brings; signals without an exit by then go into the next round.
ROUND_HOURS = 24
#: What tells signals apart.
KEY = ("symbol", "decision_time", "side")
PATH = ("ts_utc", "open", "high", "low", "close", "spread_optimistic", "spread_base", "spread_pessimistic", "in_rollover_window", "measured")


@dataclass(frozen=True)
class Exit:
    """When a trade ends. Numbers may be columns of the signals, so that many variants are priced in one frame."""

    stop_atr: float | Column
    target_atr: float | Column | None = None
    time_exit_bars: int | Column | None = None
    trail_atr: float | Column | None = None
    flat_before_weekend: bool = False
    policy: str = "pessimistic"


@dataclass(frozen=True)
class Account:
    point: float = POINT
    contract_size: float = 100.0
    commission_usd: float = 0.0
    commission_confirmed: bool = True
    swap_long: float = 0.0
    swap_short: float = 0.0
    triple_weekday: int = 3
    initial_equity: float = 10_000.0
    risk_pct: float = 1.0
    lot_step: float = 0.01
    lot_min: float = 0.01
    lot_max: float = 200.0


def path_of(minute: DataFrame, bar_costs: DataFrame) -> DataFrame:
    """The minute path with costs; a minute without costs gets its scenario's median."""
    names = ("spread_optimistic", "spread_base", "spread_pessimistic")
    usual = bar_costs.groupBy("symbol").agg(*(F.median(c).alias(f"_{c}") for c in names))
    out = minute.join(bar_costs, ["symbol", "ts_utc"], "left").join(F.broadcast(usual), "symbol", "left")  # one row a symbol: a shuffle by it would be one task
    return out.select("symbol", "ts_utc", "open", "high", "low", "close", *(F.coalesce(c, f"_{c}").alias(c) for c in names), F.coalesce("in_rollover_window", F.lit(False)).alias("in_rollover_window"), F.coalesce(F.col("spread_source") == "measured", F.lit(False)).alias("measured"))


def weekend_flat(ts: Column) -> Column:
    return (cal.iso_weekday(cal.local(ts, cal.NEW_YORK)) == 5) & (cal.minute_of_day(cal.local(ts, cal.NEW_YORK)) >= 1010)


def _by_scenario(column: str) -> Column:
    out = F.when(F.col("scenario") == SCENARIOS[0], F.col(f"{column}_{SCENARIOS[0]}"))
    for s in SCENARIOS[1:]:
        out = out.when(F.col("scenario") == s, F.col(f"{column}_{s}"))
    return out


def _slip(order: Column, in_window: Column) -> Column:
    out = None
    for s in SCENARIOS:
        for o in ("market", "stop", "limit"):
            on, value = (F.col("scenario") == s) & (order == o), costs.slippage(s, o, F.col("atr_pts"), in_window)
            out = F.when(on, value) if out is None else out.when(on, value)
    return out


def _hour(ts: Column) -> Column:
    """Hours since 1970: the bucket in which a signal meets its minutes."""
    return F.floor(cal.seconds(ts) / 3600)


def entries(signals: DataFrame, path: DataFrame, exit_: Exit, account: Account, start: str | None = None, stop: str | None = None, variants: list[dict] | None = None) -> DataFrame:
    """Signals with their entry bar, the time at which the search for an exit ends and why, and the bar of that time.

    plan is an array with one struct a scenario: spread_in, slip_in, entry_price, stop, target. ``variants``: numbers that
    the exit names as columns; each signal is there once for each (variant: its place in the list), after the as-of joins.
    """
    s = signals
    if start is not None:
        s = s.where(F.col("decision_time") >= F.lit(start).cast("timestamp_ntz"))
    if stop is not None:
        s = s.where(F.col("decision_time") < F.lit(stop).cast("timestamp_ntz"))
    bars = path.select("symbol", *(F.col(c).alias(f"e_{c}") for c in PATH))
    s = asof(s, bars, "decision_time", "e_ts_utc", [f"e_{c}" for c in PATH], direction="forward")
    s = s.where(F.col("e_ts_utc").isNotNull() & (cal.seconds(F.col("e_ts_utc")) - cal.seconds(F.col("decision_time")) <= LATEST_ENTRY_S))
    never = F.lit("9999-01-01 00:00:00").cast("timestamp_ntz")
    if stop is not None:
        s = s.where(F.col("e_ts_utc") < F.lit(stop).cast("timestamp_ntz"))
    ends = [F.struct((F.lit(stop).cast("timestamp_ntz") if stop is not None else never).alias("at"), F.lit(2).alias("rank"), F.lit("end_of_tier" if stop is not None else "end_of_data").alias("why"))]
    if exit_.time_exit_bars is not None:
        ends.append(F.struct(cal.plus_minutes(F.col("decision_time"), 5 * exit_.time_exit_bars).alias("at"), F.lit(1).alias("rank"), F.lit("time").alias("why")))
    if exit_.flat_before_weekend:
        flat = path.where(weekend_flat(F.col("ts_utc"))).select("symbol", F.col("ts_utc").alias("_flat"))
        s = asof(s, flat, "e_ts_utc", "_flat", ["_flat"], direction="forward", strict=True)
        ends.append(F.struct(F.coalesce("_flat", never).alias("at"), F.lit(0).alias("rank"), F.lit("weekend").alias("why")))
    s = s.withColumn("_end", F.array_min(F.array(*ends))).withColumns({"end_time": F.col("_end.at"), "end_reason": F.col("_end.why")})
    last = path.groupBy("symbol").agg(F.max("ts_utc").alias("x_ts_utc"), *(F.max_by(c, "ts_utc").alias(f"x_{c}") for c in PATH if c != "ts_utc"))
    final = path.select("symbol", *(F.col(c).alias(f"f_{c}") for c in PATH))
    s = asof(s, final, "end_time", "f_ts_utc", [f"f_{c}" for c in PATH], direction="forward").join(F.broadcast(last), "symbol")
    if variants:
        each = [F.struct(F.lit(str(i)).alias("variant"), *(F.lit(float(x)).alias(k) for k, x in v.items())) for i, v in enumerate(variants)]
        s = s.withColumn("_v", F.explode(F.array(*each))).select("*", "_v.*").drop("_v")
    pt, side = account.point, F.col("side")
    s = s.withColumn("risk", exit_.stop_atr * F.col("atr_pts") * pt)

    def plan(name: str) -> Column:
        spread, slip = F.col(f"e_spread_{name}"), costs.slippage(name, "market", F.col("atr_pts"), F.lit(False))
        price = F.when(side > 0, F.col("e_open") + (spread + slip) * pt).otherwise(F.col("e_open") - slip * pt)
        target = price + side * exit_.target_atr * F.col("atr_pts") * pt if exit_.target_atr is not None else F.lit(None).cast("double")
        return F.struct(F.lit(name).alias("scenario"), spread.cast("double").alias("spread_in"), slip.alias("slip_in"), price.alias("entry_price"), (price - side * F.col("risk")).alias("stop"), target.alias("target"))

    return s.withColumn("plan", F.array(*map(plan, SCENARIOS)))


FILL = "struct<price:double,reason:string,order:string,ambiguous:boolean>"
HIT = f"struct<ts:timestamp_ntz,fill:{FILL}>"


def _hit(b: Column, spread: Column, stop: Column, target: Column, exit_: Exit) -> Column:
    """The fill on one bar (null if none): price, reason, order, ambiguous. Gaps count after the entry bar only."""
    side = F.col("side")
    ask = F.when(side > 0, 0.0).otherwise(spread)  # the short side trades on the ask
    o, h, lo = b["open"] + ask, b["high"] + ask, b["low"] + ask
    worse = F.when(side > 0, lo <= stop).otherwise(h >= stop)
    better = F.coalesce(F.when(side > 0, h >= target).otherwise(lo <= target), F.lit(False))
    later = b["ts_utc"] > F.col("e_ts_utc")
    fill = lambda price, reason, order, ambiguous=False: F.struct(price.alias("price"), F.lit(reason).alias("reason"), F.lit(order).alias("order"), F.lit(ambiguous).alias("ambiguous")).cast(FILL)
    both = fill(stop, "stop", "stop", True) if exit_.policy == "pessimistic" else fill(target, "target", "limit", True)
    return (
        F.when(later & F.coalesce(F.when(side > 0, o >= target).otherwise(o <= target), F.lit(False)), fill(target, "target", "limit"))
        .when(later & F.when(side > 0, o <= stop).otherwise(o >= stop), fill(o, "stop_gap", "stop"))
        .when(worse & better, both).when(worse, fill(stop, "stop", "stop")).when(better, fill(target, "target", "limit"))
    )


def _one_round(s: DataFrame, bars: DataFrame, k: int, exit_: Exit, account: Account, key: tuple[str, ...]) -> DataFrame:
    """The key, hits and stops (one entry a scenario) over the minutes of the k-th ROUND_HOURS of each search.

    A signal is dealt only the hours of its own search, and once for all scenarios.
    """
    first = F.col("h0") + k * ROUND_HOURS
    rows = s.withColumn("hour", F.explode(F.sequence(first, F.least(first + (ROUND_HOURS - 1), F.col("h1"))))).join(bars, ["symbol", "hour"])
    rows = rows.where((F.col("ts_utc") >= F.col("e_ts_utc")) & (F.col("ts_utc") < F.col("end_time")))
    points = [(i, F.col(f"spread_{name}") * account.point) for i, name in enumerate(SCENARIOS)]
    if exit_.trail_atr is None:
        b = F.struct("ts_utc", "open", "high", "low", "close")

        def first_hit(i: int, spread: Column) -> Column:
            fill = _hit(b, spread, F.col("stops")[i], F.col("plan")[i]["target"], exit_)
            return F.min(F.when(fill.isNotNull(), F.struct(F.col("ts_utc").alias("ts"), fill.alias("fill")).cast(HIT)))

        each = rows.groupBy(*key).agg(F.array(*(first_hit(i, x) for i, x in points)).alias("_hits"))
        return each.withColumn("_stops", F.lit(None).cast("array<double>"))
    # a fold over the sorted minutes of the round: the stop moves when a bar of five minutes closes
    trail = exit_.trail_atr * F.col("atr_pts") * account.point
    state = f"struct<ts:timestamp_ntz,fill:{FILL},stop:double>"

    def fold(i: int, name: str) -> Column:
        def step(now, b):
            spread = b[f"spread_{name}"] * account.point
            fill = _hit(b, spread, now["stop"], F.col("plan")[i]["target"], exit_)
            closes = F.pmod(F.minute(b["ts_utc"]) + 1, F.lit(5)) == 0
            moved = F.when(F.col("side") > 0, F.greatest(now["stop"], b["close"] - trail)).otherwise(F.least(now["stop"], b["close"] + spread + trail))
            then = F.struct(F.when(fill.isNotNull(), b["ts_utc"]).alias("ts"), fill.alias("fill"), F.when(fill.isNull() & closes, moved).otherwise(now["stop"]).alias("stop"))
            return F.when(now["ts"].isNotNull(), now).otherwise(then.cast(state))

        start = F.struct(F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast(FILL).alias("fill"), F.col("stops")[i].alias("stop")).cast(state)
        return F.aggregate("bs", start, step)

    b = F.struct("ts_utc", "open", "high", "low", "close", *(f"spread_{n}" for n in SCENARIOS))
    each = rows.groupBy(*key, "e_ts_utc", "atr_pts", "plan", "stops").agg(F.sort_array(F.collect_list(b)).alias("bs"))
    each = each.withColumn("_x", F.array(*(fold(i, n) for i, n in enumerate(SCENARIOS))))
    hits = F.transform("_x", lambda x: F.when(x["ts"].isNotNull(), F.struct(x["ts"].alias("ts"), x["fill"].alias("fill")).cast(HIT)))
    return each.select(*key, hits.alias("_hits"), F.transform("_x", lambda x: x["stop"]).alias("_stops"))


def exits(signals: DataFrame, path: DataFrame, exit_: Exit, account: Account, key: tuple[str, ...] = KEY) -> DataFrame:
    """The key with hits: by scenario the first exit (time; price, reason, order, ambiguous), null where the search ends without.

    The hours from entry to end are the equality key of the join. Searches longer than ROUND_HOURS go on in rounds with
    the signals that are still open; each round is written.
    """
    newest = path.agg(F.max("ts_utc")).first()[0]
    none = F.array(*(F.lit(None).cast(HIT) for _ in SCENARIOS))
    s = signals.select(*key, "e_ts_utc", "end_time", "atr_pts", "plan", *(c for c in ("trail_atr",) if c in signals.columns), none.alias("hits"), F.transform("plan", lambda p: p["stop"]).alias("stops"))
    if newest is None:
        return s.select(*key, "hits")
    ends = F.timestamp_add("SECOND", F.lit(-1), F.least("end_time", F.timestamp_add("SECOND", F.lit(1), F.lit(newest).cast("timestamp_ntz"))))
    s = s.withColumns({"h0": _hour(F.col("e_ts_utc")), "h1": F.greatest(_hour(F.col("e_ts_utc")), _hour(ends))})
    bars = path.withColumn("hour", _hour(F.col("ts_utc")))
    hours = (s.agg(F.max(F.col("h1") - F.col("h0"))).first()[0] or 0) + 1
    rounds, closed = -(-hours // ROUND_HOURS), None
    for k in range(rounds):
        each = _one_round(s, bars, k, exit_, account, key)
        s = s.join(each, list(key), "left")
        found = F.transform(F.sequence(F.lit(0), F.lit(len(SCENARIOS) - 1)), lambda i: F.coalesce(F.col("hits")[i], F.col("_hits")[i]))
        s = s.withColumns({"hits": found, "stops": F.coalesce("_stops", "stops")}).drop("_hits", "_stops")
        if k + 1 == rounds:
            done = s
        else:
            s = staged(s, "search")
            over = ~F.exists("hits", lambda h: h.isNull()) | (F.col("h1") < F.col("h0") + (k + 1) * ROUND_HOURS)
            done, s = s.where(over), s.where(~over)
        closed = done if closed is None else closed.unionByName(done)
        if k + 1 < rounds and s.isEmpty():
            break
    return closed.select(*key, "hits")


def label(signals: DataFrame, path: DataFrame, exit_: Exit, account: Account = Account(), start: str | None = None, stop: str | None = None, variants: list[dict] | None = None) -> DataFrame:
    """Each signal priced on its own under each scenario: the trades that studies and the one-position rule choose from.

    The path and the entries are read several times, so they are written once. Signals may hold a column ``variant``,
    and ``variants`` makes one: then each variant of a signal is a trade.
    """
    path = staged(path, "path")
    s = staged(entries(signals, path, exit_, account, start, stop, variants), "entries")
    key = (*KEY, "variant") if "variant" in s.columns else KEY
    s = s.join(exits(s, path, exit_, account, key), list(key), "left")
    s = s.withColumn("_p", F.explode(F.arrays_zip("plan", "hits"))).drop("plan", "hits")
    s = s.withColumns({n: F.col(f"_p.plan.{n}") for n in ("scenario", "spread_in", "slip_in", "entry_price", "target")} | {"stop_initial": F.col("_p.plan.stop"), "exit_ts": F.col("_p.hits.ts"), "fill": F.col("_p.hits.fill")}).drop("_p")
    pt, side = account.point, F.col("side")
    closes = F.col("f_ts_utc").isNull()  # no bar left: out at the last close
    out_spread = F.when(closes, _by_scenario("x_spread")).otherwise(_by_scenario("f_spread"))
    price = F.when(closes, F.col("x_close")).otherwise(F.col("f_open")) + F.when(side > 0, 0.0).otherwise(out_spread * pt)
    done = F.struct(price.alias("price"), F.when(closes, "end_of_data").otherwise(F.col("end_reason")).alias("reason"), F.lit("market").alias("order"), F.lit(False).alias("ambiguous"))
    s = s.withColumns({"exit_time": F.coalesce("exit_ts", "f_ts_utc", "x_ts_utc"), "x": F.coalesce("fill", done)})
    last = path.select("symbol", F.col("ts_utc").alias("exit_time"), *(F.col(c).alias(f"o_{c}") for c in PATH if c.startswith("spread") or c in ("in_rollover_window", "measured")))
    s = s.join(last, ["symbol", "exit_time"], "left")
    s = s.withColumn("slip_out", _slip(F.col("x.order"), F.col("o_in_rollover_window")))
    s = s.withColumn("exit_price", F.col("x.price") - side * F.col("slip_out") * pt)
    nights = costs.swap_nights(F.col("e_ts_utc"), F.col("exit_time"), account.triple_weekday)
    fee = F.when(F.col("scenario") == "pessimistic", costs.commission(account.commission_usd, "pessimistic", account.commission_confirmed)).otherwise(account.commission_usd) / account.contract_size
    swap = -F.when(side > 0, account.swap_long).otherwise(account.swap_short) * pt * nights
    risk = F.col("risk")
    s = s.withColumns({"_fee": fee, "_swap": swap, "_spread": F.when(side > 0, F.col("spread_in")).otherwise(_by_scenario("o_spread"))})
    s = s.withColumn("r_net", ((F.col("exit_price") - F.col("entry_price")) * side - F.col("_fee") - F.col("_swap")) / risk)
    s = s.withColumns({
        "cost_spread_r": F.col("_spread") * pt / risk, "cost_slippage_r": (F.col("slip_in") + F.col("slip_out")) * pt / risk, "cost_commission_r": F.col("_fee") / risk, "cost_swap_r": F.col("_swap") / risk,
        "spread_measured": F.when(side > 0, F.col("e_measured")).otherwise(F.col("o_measured")),
    })
    s = s.withColumn("r_before_costs", F.col("r_net") + F.col("cost_spread_r") + F.col("cost_slippage_r") + F.col("cost_commission_r") + F.col("cost_swap_r"))
    return s.select(
        *(c for c in key if c == "variant"), "symbol", "scenario", "side", "decision_time", F.col("e_ts_utc").alias("entry_time"), "exit_time", "entry_price", "exit_price", "stop_initial", "target",
        F.col("x.reason").alias("exit_reason"), F.col("x.ambiguous").alias("ambiguous"), "atr_pts", (risk / pt).alias("risk_pts"), "r_net", "r_before_costs",
        "cost_spread_r", "cost_slippage_r", "cost_commission_r", "cost_swap_r", "spread_measured",
    )


def excursions(trades: DataFrame, path: DataFrame, account: Account = Account()) -> DataFrame:
    """Trades with mfe_r, mae_r and bars_held_m1: the best and worst price from entry to exit bar."""
    key = [*KEY, "scenario"]
    hours = F.sequence(_hour(F.col("entry_time")), _hour(F.col("exit_time")))
    rows = trades.select(*key, "entry_time", "exit_time", "entry_price", "risk_pts", F.explode(hours).alias("hour"))
    rows = rows.join(path.withColumn("hour", _hour(F.col("ts_utc"))), ["symbol", "hour"]).where("ts_utc between entry_time and exit_time")
    ask = F.when(F.col("side") > 0, 0.0).otherwise(_by_scenario("spread") * account.point)
    each = rows.groupBy(*key, "entry_price", "risk_pts").agg(F.max(F.col("high") + ask).alias("h"), F.min(F.col("low") + ask).alias("l"), F.count("*").alias("bars_held_m1"))
    risk, long = F.col("risk_pts") * account.point, F.col("side") > 0
    best, worst = F.when(long, F.col("h") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("l")), F.when(long, F.col("entry_price") - F.col("l")).otherwise(F.col("h") - F.col("entry_price"))
    each = each.select(*key, (F.greatest(best, F.lit(0.0)) / risk).alias("mfe_r"), (F.greatest(worst, F.lit(0.0)) / risk).alias("mae_r"), "bars_held_m1")
    return trades.join(each, key)


def taken(trades: DataFrame, keys=("symbol", "scenario")) -> DataFrame:
    """The trades, with their place, that an account takes that holds one position: the next decision comes after the exit
    bar has opened. Each trade points to the first decision after its exit; the chain of pointers is what is taken."""
    order = ("decision_time", "side")
    placed = staged(win.row_index(trades, "place", keys, "decision_time", order), "placed")
    first = placed.groupBy(*keys, F.col("decision_time").alias("_at")).agg(F.min("place").alias("next"))
    links = asof(placed.select(*keys, "place", "exit_time"), first, "exit_time", "_at", ["next"], keys, "forward", strict=True)
    return placed.join(chain.reached(links.select(*keys, "place", "next"), tuple(keys)), [*keys, "place"])


def one_at_a_time(trades: DataFrame, account: Account = Account(), keys=("symbol", "scenario")) -> DataFrame:
    """``taken`` with lots, pnl_usd and equity_usd: risk_pct of the equity, whole lot steps; a blown account trades no more lots.

    Lots are rounded to steps of an equity that the trades before have made, so that states cannot be put together from
    parts: the money goes trade by trade. It is four numbers a taken trade and one run a group; the rest stays where it is.
    """
    a, names = account, ("lots", "pnl_usd", "equity_usd")
    rows = staged(taken(trades, keys), "taken")
    narrow = rows.select(*keys, "place", "r_net", (F.col("risk_pts") * a.point).alias("risk"))
    schema = T.StructType([*(f for f in narrow.schema.fields if f.name in (*keys, "place")), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("place")
        equity, money = a.initial_equity, []
        for r, risk in zip(p["r_net"].tolist(), p["risk"].tolist()):
            lots = 0.0
            if equity > 0:
                wanted = equity * a.risk_pct / 100 / (risk * a.contract_size)
                lots = round(min(a.lot_max, max(a.lot_min, int(wanted / a.lot_step + 1e-9) * a.lot_step)), 8)
            pnl = max(r * risk * a.contract_size * lots, -equity) if lots else 0.0
            equity += pnl
            money.append((lots, pnl, equity))
        out = p[[*keys, "place"]].copy()
        for n, v in zip(names, zip(*money)):
            out[n] = list(v)
        return out

    money = narrow.groupBy(*keys).applyInPandas(run, schema)
    return rows.join(money, [*keys, "place"]).select(*trades.columns, *names)
