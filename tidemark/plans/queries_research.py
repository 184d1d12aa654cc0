"""Queries on trades, studies, ledgers and plain tables, each with its twin where SQL has one."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans import behaviours, features, metrics, research, search, simulate, strategy, table
from tidemark.plans import queries_bars as qb
from tidemark.plans import queries_features as qf
from tidemark.plans import sql as q
from tidemark.plans.queries_bars import rounded
from tidemark.sources import ledger as lg
from tidemark.sources import manifest
from tidemark.sources import tape as src
from tidemark.sources.datasets import kept
from tidemark.streaming import bars as stream
from tidemark.streaming import quotes

QUERIES, ORACLE = {}, {}


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


EXIT = simulate.Exit(stop_atr=1.0, target_atr=1.5, time_exit_bars=24)


def path(spark, d):
    """The minute path under the spreads of the cost model."""
    return kept(spark, d, "path", lambda: simulate.path_of(src.bars(spark, d, 1), qb.priced(spark, d)))


def signals(spark, d):
    return kept(spark, d, "signals", lambda: strategy.signals(qf.with_rules(spark, d), qf.SPEC))


def labelled(spark, d):
    return research.triple_barrier(simulate.label(signals(spark, d), path(spark, d), EXIT))


def _of(p: str) -> str:
    """The spread of a row's scenario among those of the bar with this prefix."""
    return f"(CASE scenario WHEN 'optimistic' THEN {p}so WHEN 'base' THEN {p}sb ELSE {p}sp END)"


_PATH = f"""{qb._PRICED.split(q.M1 + ',', 1)[1]}, um AS (SELECT symbol AS us, median(spread_optimistic) AS mo, median(spread_base) AS mb, median(spread_pessimistic) AS mp FROM priced GROUP BY symbol),
pm AS (SELECT m1.symbol, m1.ts_utc, open, high, low, close, coalesce(spread_optimistic, mo) AS so, coalesce(spread_base, mb) AS sb, coalesce(spread_pessimistic, mp) AS sp, coalesce(in_rollover_window, false) AS rw
  FROM m1 LEFT JOIN priced ON priced.symbol = m1.symbol AND priced.ts_utc = m1.ts_utc LEFT JOIN um ON us = m1.symbol)"""

def trades_sql(found: str, stop: float = 1.0, target: float = 1.5) -> str:
    """The twin of ``label``: trades of the signals that the given expressions make (as sig)."""
    return f"""{found}, {_PATH},
sc(scenario, fixed, share, factor) AS (VALUES ('optimistic', 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE), ('base', 2.0, 0.01, 2.0), ('pessimistic', 5.0, 0.02, 3.0)),
en AS (SELECT s.*, p.ts_utc AS et, p.open AS eo, p.so AS eso, p.sb AS esb, p.sp AS esp FROM sig s ASOF JOIN pm p ON s.symbol = p.symbol AND s.decision_time <= p.ts_utc),
e1 AS (SELECT *, decision_time + INTERVAL 120 MINUTE AS end_time FROM en WHERE epoch(et) - epoch(decision_time) <= 300),
e2 AS (SELECT e1.*, p.ts_utc AS ft, p.open AS fo, p.so AS fso, p.sb AS fsb, p.sp AS fsp FROM e1 ASOF LEFT JOIN pm p ON e1.symbol = p.symbol AND e1.end_time <= p.ts_utc),
e3 AS (SELECT e2.*, sc.*, {_of('e')} AS spread, {stop} * atr_pts * 0.01 AS risk, fixed + share * greatest(atr_pts, 0) AS slip_in FROM e2 CROSS JOIN sc),
e4 AS (SELECT *, CASE WHEN side > 0 THEN eo + (spread + slip_in) * 0.01 ELSE eo - slip_in * 0.01 END AS ep FROM e3),
e5 AS (SELECT *, ep - side * risk AS stop, ep + side * {target} * atr_pts * 0.01 AS target FROM e4),
h00 AS (SELECT e.symbol, e.decision_time, e.scenario, e.side, e.stop, e.target, p.ts_utc AS ht, p.ts_utc > e.et AS later, p.open AS po, p.high AS ph, p.low AS pl, p.so, p.sb, p.sp FROM e5 e JOIN pm p ON p.symbol = e.symbol AND p.ts_utc >= e.et AND p.ts_utc < e.end_time),
h01 AS (SELECT *, CASE WHEN side > 0 THEN 0 ELSE {_of('')} * 0.01 END AS ask FROM h00), h0 AS (SELECT *, po + ask AS o, ph + ask AS h, pl + ask AS l FROM h01),
h1 AS (SELECT *, CASE WHEN side > 0 THEN l <= stop ELSE h >= stop END AS worse, CASE WHEN side > 0 THEN h >= target ELSE l <= target END AS better,
  later AND CASE WHEN side > 0 THEN o >= target ELSE o <= target END AS gap_target, later AND CASE WHEN side > 0 THEN o <= stop ELSE o >= stop END AS gap_stop FROM h0),
h2 AS (SELECT decision_time, scenario, ht, CASE WHEN gap_target THEN target WHEN gap_stop THEN o WHEN worse THEN stop ELSE target END AS px, CASE WHEN gap_target THEN 'target' WHEN gap_stop THEN 'stop_gap' WHEN worse THEN 'stop' ELSE 'target' END AS why,
  CASE WHEN gap_target THEN 'limit' WHEN gap_stop THEN 'stop' WHEN worse THEN 'stop' ELSE 'limit' END AS ord, NOT gap_target AND NOT gap_stop AND worse AND better AS amb FROM h1 WHERE worse OR better),
h3 AS (SELECT decision_time AS hd, scenario AS hs, min(ht) AS xt0, arg_min(px, ht) AS px, arg_min(why, ht) AS why, arg_min(ord, ht) AS ord, arg_min(amb, ht) AS amb FROM h2 GROUP BY ALL),
lb AS (SELECT max(ts_utc) AS lt, arg_max(close, ts_utc) AS lc, arg_max(so, ts_utc) AS lso, arg_max(sb, ts_utc) AS lsb, arg_max(sp, ts_utc) AS lsp FROM pm),
x0 AS (SELECT e.*, coalesce(xt0, ft, lt) AS xt, coalesce(px, CASE WHEN ft IS NULL THEN lc ELSE fo END + CASE WHEN side > 0 THEN 0 WHEN ft IS NULL THEN {_of('l')} * 0.01 ELSE {_of('f')} * 0.01 END) AS xp,
  coalesce(why, CASE WHEN ft IS NULL THEN 'end_of_data' ELSE 'time' END) AS exit_reason, coalesce(ord, 'market') AS ord, coalesce(amb, false) AS ambiguous FROM e5 e LEFT JOIN h3 ON hd = decision_time AND hs = scenario CROSS JOIN lb),
xb AS (SELECT x0.*, p.rw AS xrw, p.so AS xso, p.sb AS xsb, p.sp AS xsp FROM x0 JOIN pm p ON p.symbol = x0.symbol AND p.ts_utc = xt),
x1 AS (SELECT *, CASE WHEN ord = 'limit' THEN 0 WHEN ord = 'stop' AND xrw THEN slip_in * factor ELSE slip_in END AS slip_out, CASE WHEN side > 0 THEN spread ELSE {_of('x')} END * 0.01 AS paid FROM xb),
tr AS (SELECT *, xp - side * slip_out * 0.01 AS exit_price, ((xp - side * slip_out * 0.01) - ep) * side / risk AS r_net, paid / risk AS cost_spread_r, (slip_in + slip_out) * 0.01 / risk AS cost_slippage_r,
  CASE WHEN exit_reason = 'target' THEN 1 WHEN exit_reason LIKE 'stop%' THEN -1 ELSE 0 END AS label FROM x1),
trades AS (SELECT *, et AS entry_time, xt AS exit_time, r_net + cost_spread_r + cost_slippage_r AS r_before_costs FROM tr)"""


TRADES = trades_sql(qf.SIGNALS)
_TP, _TD = ["symbol", "scenario", "side", "decision_time", "entry_time", "exit_time", "exit_reason", "ambiguous", "label"], ["ep AS entry_price", "exit_price", "r_net", "r_before_costs", "cost_spread_r", "cost_slippage_r"]
register("triple_barrier", q.query(TRADES, "trades", _TP, _TD, places=5))(lambda spark, d: rounded(labelled(spark, d).select(*_TP, *(x.split(" AS ")[-1] for x in _TD)), 5))

_R = "PARTITION BY symbol, scenario"
_SUM = f"""{TRADES}, c0 AS (SELECT *, sum(r_net) OVER ({_R} ORDER BY exit_time, decision_time ROWS UNBOUNDED PRECEDING) AS cum FROM trades),
c1 AS (SELECT *, greatest(max(cum) OVER ({_R} ORDER BY exit_time, decision_time ROWS UNBOUNDED PRECEDING), 0) - cum AS dd FROM c0),
mo AS (SELECT symbol AS ms, scenario AS mc, avg(r_net) AS mu, stddev_samp(r_net) AS sd FROM trades GROUP BY ALL),
sm AS (SELECT symbol, scenario, count(*) AS n, count(*) FILTER (r_net > 0) AS wins, avg(CAST(r_net > 0 AS DOUBLE)) AS win_rate, avg(r_net) AS expectancy_r, median(r_net) AS median_r, stddev_samp(r_net) AS std_r, sum(r_net) AS total_r,
  sum(r_net) FILTER (r_net > 0) / nullif(-sum(r_net) FILTER (r_net < 0), 0) AS profit_factor, max(dd) AS max_dd_r, avg(pow((r_net - mu) / sd, 3)) AS skew, avg(pow((r_net - mu) / sd, 4)) AS kurtosis, avg(CAST(ambiguous AS DOUBLE)) AS ambiguity_rate,
  count(*) FILTER (side > 0) AS long_trades, count(*) FILTER (side < 0) AS short_trades, avg(r_net) / stddev_samp(r_net) AS sharpe_per_trade FROM c1 JOIN mo ON ms = symbol AND mc = scenario GROUP BY symbol, scenario)"""
_SP, _SD = ["symbol", "scenario", "n", "wins", "long_trades", "short_trades"], ["win_rate", "expectancy_r", "median_r", "std_r", "total_r", "profit_factor", "max_dd_r", "skew", "kurtosis", "ambiguity_rate", "sharpe_per_trade"]
register("trade_summary", q.query(_SUM, "sm", _SP, _SD, places=4))(lambda spark, d: rounded(metrics.summary(labelled(spark, d)).select(*_SP, *_SD), 4))


_BY = """SELECT symbol, scenario, 'weekday' AS "by", CAST(isodow(decision_time) AS VARCHAR) AS bucket, r_net FROM trades UNION ALL SELECT symbol, scenario, 'side', CASE WHEN side > 0 THEN 'long' ELSE 'short' END, r_net FROM trades
UNION ALL SELECT symbol, scenario, 'year', CAST(date_part('year', decision_time) AS VARCHAR), r_net FROM trades UNION ALL SELECT symbol, scenario, 'month', strftime(decision_time, '%Y-%m'), r_net FROM trades"""
_BRK = f"""{TRADES}, bk AS (SELECT symbol, scenario, "by", bucket, count(*) AS n, avg(r_net) AS expectancy_r, sum(r_net) AS total_r, avg(CAST(r_net > 0 AS DOUBLE)) AS win_rate FROM ({_BY}) GROUP BY ALL)"""
register("breakdown_sets", q.query(_BRK, "bk", ["symbol", "scenario", '"by"', "bucket", "n"], ["expectancy_r", "total_r", "win_rate"], places=4))(lambda spark, d: rounded(metrics.breakdown(labelled(spark, d), metrics.calendar_buckets()), 4))
register("stability", q.query(f"""{_BRK}, sb AS (SELECT symbol, scenario, "by", count(*) AS buckets_scored, count(*) FILTER (expectancy_r > 0) AS positive, avg(CAST(expectancy_r > 0 AS DOUBLE)) AS score FROM bk WHERE n >= 10 GROUP BY ALL)""", "sb", ["symbol", "scenario", '"by"', "buckets_scored", "positive"], ["score"], places=4))(
    lambda spark, d: rounded(metrics.stability(metrics.breakdown(labelled(spark, d), metrics.calendar_buckets())), 4)
)
register("equity_drawdown", q.query(_SUM, "c1", ["symbol", "scenario", "decision_time", "exit_time"], ["cum AS cum_r", "dd AS dd_r"], places=4))(lambda spark, d: rounded(metrics.with_drawdown(labelled(spark, d)).select("symbol", "scenario", "decision_time", "exit_time", "cum_r", "dd_r"), 4))
_POINTS = f"""{_SUM}, eq AS (SELECT *, row_number() OVER ({_R} ORDER BY exit_time, decision_time) - 1 AS k, count(*) OVER ({_R}) AS m FROM c1),
ep AS (SELECT * FROM eq WHERE k = 0 OR floor(k * (least(m, 100) - 1) / greatest(m - 1, 1)) > floor((k - 1) * (least(m, 100) - 1) / greatest(m - 1, 1)))"""
register("equity_points", q.query(_POINTS, "ep", ["symbol", "scenario", "exit_time"], ["cum AS cum_r", "dd AS dd_r"], places=4))(lambda spark, d: rounded(metrics.equity_curve(labelled(spark, d), 100), 4))
register("cost_stress", q.query(f"{TRADES}, st AS (SELECT symbol, scenario, unnest([0, 10, 20, 50, 100, 150, 200, 300]) AS extra_points, avg(r_net) AS m, avg(0.01 / risk) AS inv FROM trades GROUP BY symbol, scenario)", "st", ["symbol", "scenario", "extra_points"], ["m - extra_points * inv AS expectancy_r", "m / inv AS breakeven_points"], places=4))(
    lambda spark, d: rounded(research.cost_stress(labelled(spark, d)), 4)
)
_STUDY = f"""{TRADES}, sy AS (SELECT symbol, scenario, count(*) AS n, avg(CAST(label = 1 AS DOUBLE)) AS target_rate, avg(CAST(label = -1 AS DOUBLE)) AS stop_rate, avg(CAST(label = 0 AS DOUBLE)) AS time_rate, avg(r_net) AS mean_r_net, median(r_net) AS median_r_net,
  stddev_samp(r_net) AS std_r_net, avg(r_before_costs) AS mean_r_gross, avg(CAST(r_net > 0 AS DOUBLE)) AS win_rate_net, avg(CAST(ambiguous AS DOUBLE)) AS ambiguity_rate FROM trades GROUP BY symbol, scenario)"""
_SY = ["target_rate", "stop_rate", "time_rate", "mean_r_net", "median_r_net", "std_r_net", "mean_r_gross", "win_rate_net", "ambiguity_rate"]
register("study_stats", q.query(_STUDY, "sy", ["symbol", "scenario", "n"], _SY, places=4))(lambda spark, d: rounded(research.study_stats(labelled(spark, d)), 4))


@register("backtest_trades")
def backtest_trades(spark, d):
    """One position at a time, trailing stop, commission and swap, with the money path."""
    account = simulate.Account(commission_usd=6.0, swap_long=-5.0, swap_short=2.0)
    rule = simulate.Exit(stop_atr=1.0, target_atr=3.0, time_exit_bars=48, trail_atr=1.5, flat_before_weekend=True)
    p = path(spark, d)
    trades = simulate.one_at_a_time(simulate.label(signals(spark, d), p, rule, account), account)
    return rounded(simulate.excursions(trades, p, account), 5)


register("bootstrap_ci")(lambda spark, d: rounded(research.bootstrap(labelled(spark, d)), 4))
register("mc_drawdown")(lambda spark, d: rounded(research.shuffled_drawdown(labelled(spark, d)), 4))

_FWD = f"""{qf.SIGNALS}, f0 AS (SELECT s.*, p.open AS o0 FROM sig s ASOF JOIN m1 p ON s.symbol = p.symbol AND s.decision_time <= p.ts_utc), f1 AS (SELECT f0.*, n.n_bars, decision_time + n.n_bars * INTERVAL 5 MINUTE AS lt FROM f0 CROSS JOIN (VALUES (3), (6), (12), (24)) n(n_bars)),
f2 AS (SELECT f1.*, side * (p.open - o0) / (atr_pts * 0.01) AS mv FROM f1 ASOF JOIN m1 p ON f1.symbol = p.symbol AND f1.lt <= p.ts_utc), fw AS (SELECT symbol, n_bars, count(*) AS n, avg(mv) AS mean_atr, avg(CAST(mv > 0 AS DOUBLE)) AS hit_rate FROM f2 GROUP BY ALL)"""
register("forward_returns", q.query(_FWD, "fw", ["symbol", "n_bars", "n"], ["mean_atr", "hit_rate"], places=4))(lambda spark, d: rounded(research.forward_returns(signals(spark, d), path(spark, d)), 4))


@register("baseline_thinned", f"WITH {qf._HYG}, k AS (SELECT *, row_number() OVER (ORDER BY event_time) - 1 AS k, count(*) OVER () AS n FROM hy WHERE NOT hyg_no_entry AND atr_pts > 0) SELECT symbol, available_at AS decision_time, event_time, unnest([1, -1]) AS side, round(atr_pts, 6) AS atr_pts FROM k WHERE k % greatest(n // 30000, 1) = 0")
def baseline_thinned(spark, d):
    return rounded(research.baseline(qf.hygienic(spark, d)))


_PV = "SELECT event_type, CAST(date_part('hour', ts) AS INTEGER) AS hour, round(avg(value) / max(value), 6) AS p_value FROM events GROUP BY ALL"
register("bh_fdr", f"WITH p AS ({_PV}), k AS (SELECT *, row_number() OVER (ORDER BY p_value, event_type, hour) AS k, count(*) OVER () AS m FROM p), a AS (SELECT *, least(min(p_value * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS qv FROM k) SELECT event_type, hour, p_value, round(qv, 6) AS q_value, qv <= 0.1 AS rejected FROM a")(
    lambda spark, d: rounded(research.false_discoveries(src.table(spark, d, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.round(F.avg("value") / F.max("value"), 6).alias("p_value"))))
)
register("feature_distribution", f"""WITH {qf._SEQUENCE}, x AS (SELECT close_loc AS x, CASE WHEN dir > 0 THEN 'up' ELSE 'not up' END AS "group" FROM sq WHERE close_loc IS NOT NULL), qn AS (SELECT list_sort(list(x))[CAST(round_even(0.01 * (count(*) - 1), 0) AS BIGINT) + 1] AS lo, list_sort(list(x))[CAST(round_even(0.99 * (count(*) - 1), 0) AS BIGINT) + 1] AS hi FROM x)
SELECT "group", CAST(least(floor((least(greatest(x, lo), hi) - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM x CROSS JOIN qn GROUP BY ALL""")(
    lambda spark, d: research.distribution(features.anatomy(qf.m5(spark, d)).withColumn("g", F.when(F.col("dir") > 0, "up").otherwise("not up")), "close_loc", by="g")
)
register("category_shares", f"""WITH {qf._SEQUENCE}, x AS (SELECT coalesce(dirs_3, 'none') AS category, CAST(date_part('hour', ts_utc) AS VARCHAR) AS "group" FROM sq), c AS (SELECT "group", category, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT category FROM c GROUP BY category ORDER BY sum(n) DESC, category LIMIT 12),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY "group") AS share FROM c) SELECT "group", category, n, round(share, 6) AS share FROM s JOIN t USING (category)""")(
    lambda spark, d: rounded(research.category_shares(features.sequence(features.anatomy(qf.m5(spark, d))).withColumn("h", F.hour("ts_utc")), "dirs_3", "h"))
)


@register("walk_forward_folds", """WITH span AS (SELECT CAST(min(o_orderdate) AS TIMESTAMP) AS a, CAST(max(o_orderdate) AS TIMESTAMP) AS z FROM orders),
s AS (SELECT z, CASE WHEN day(a) > 1 THEN date_trunc('month', a) + INTERVAL 1 MONTH ELSE date_trunc('month', a) END AS first FROM span),
f AS (SELECT CAST(range AS INTEGER) AS fold, z, first + INTERVAL (range * 3) MONTH AS train_start FROM s, range(0, 400)),
g AS (SELECT fold, z, train_start, train_start + INTERVAL 12 MONTH AS test_start, least(train_start + INTERVAL 15 MONTH, z) AS test_end FROM f)
SELECT fold, CAST(train_start AS TIMESTAMP) AS train_start, CAST(test_start AS TIMESTAMP) AS test_start, test_end FROM g WHERE test_start < z AND date_diff('day', test_start, test_end) >= 20""")
def walk_forward_folds(spark, d):
    """Folds over the span of a long history: that of the orders."""
    span = src.table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("t")).agg(F.min("t").alias("a"), F.max("t").alias("z")).first()
    return research.folds(spark, span.a, span.z)


GRID = research.grid({"stop_atr": [0.75, 1.0, 1.5], "target_atr": [1.0, 1.5, 2.0]})


def variants_of(spark, d):
    """The trades of all variants of the grid in one frame, with their numbers."""
    rule = simulate.Exit(stop_atr=F.col("stop_atr"), target_atr=F.col("target_atr"), time_exit_bars=24)
    trades = simulate.label(signals(spark, d), path(spark, d), rule, variants=GRID)
    numbers = spark.createDataFrame([(str(i), *v.values()) for i, v in enumerate(GRID)], "variant string, stop_atr double, target_atr double")
    return trades.join(numbers, "variant")


def _each_variant(where: str) -> str:
    """The trades of every variant of the grid, as one relation."""
    one = "SELECT '{i}' AS variant, {s}::DOUBLE AS stop_atr, {t}::DOUBLE AS target_atr, decision_time, r_net FROM (WITH {sql} SELECT * FROM trades WHERE {where})"
    return " UNION ALL ".join(one.format(i=i, s=v["stop_atr"], t=v["target_atr"], sql=trades_sql(qf.SIGNALS, v["stop_atr"], v["target_atr"]), where=where) for i, v in enumerate(GRID))


_PLATEAU = f"""WITH g AS (SELECT stop_atr, target_atr, count(*) AS n, avg(r_net) AS r FROM ({_each_variant("scenario = 'base'")}) GROUP BY ALL),
k AS (SELECT *, dense_rank() OVER (ORDER BY stop_atr) AS i, dense_rank() OVER (ORDER BY target_atr) AS j FROM g), b AS (SELECT * FROM k WHERE n >= 30 ORDER BY r DESC, stop_atr, target_atr LIMIT 1),
x AS (SELECT b.stop_atr AS best_stop_atr, b.target_atr AS best_target_atr, b.r AS best_r, avg(k.r) AS near_r, count(*) AS neighbours FROM k, b WHERE abs(k.i - b.i) + abs(k.j - b.j) = 1 GROUP BY ALL),
y AS (SELECT *, near_r / CASE WHEN best_r > 0 THEN best_r END AS ratio FROM x)
SELECT best_stop_atr, best_target_atr, round(best_r, 4) AS best_r, round(near_r, 4) AS near_r, neighbours, round(ratio, 4) AS ratio, CASE WHEN ratio >= 0.7 THEN 'plateau' WHEN ratio >= 0.4 THEN 'slope' ELSE 'spike' END AS shape FROM y"""


@register("grid_search_plateau", _PLATEAU)
def grid_search_plateau(spark, d):
    """Stops by targets over the same signals: every variant of every signal is a row of one frame, the table one aggregate."""
    t = variants_of(spark, d).where("scenario = 'base'").groupBy("stop_atr", "target_atr").agg(F.count("*").alias("n"), F.avg("r_net").alias("expectancy_r"))
    return rounded(research.plateau(t, ["stop_atr", "target_atr"]), 4)


@register("ml_filter")
def ml_filter(spark, d):
    """Thresholds over out-of-fold probabilities of a boosted filter."""
    f = features.session(qf.with_rules(spark, d)).select("symbol", F.col("available_at").alias("decision_time"), "close_loc", "streak", "ret_atr", "ret5_atr", "compression", "pos_in_range20", "min_since_ny_open")
    t = labelled(spark, d).where("scenario = 'base'").select("symbol", "decision_time", "r_net").join(f, ["symbol", "decision_time"])
    return rounded(research.choose_threshold(research.meta_filter(t, [c for c in f.columns if c not in ("symbol", "decision_time")])), 6)


@register("stream_bars_closed", "SELECT 'ALL' AS symbol, time_bucket(INTERVAL '5 minutes', ts) AS ts_utc, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS tick_volume FROM events GROUP BY time_bucket(INTERVAL '5 minutes', ts) HAVING time_bucket(INTERVAL '5 minutes', ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE")
def stream_bars_closed(spark, d):
    """Closed five-minute bars of the events as a file stream."""
    schema = src.table(spark, d, "events").schema
    ticks = src.from_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))
    out = manifest.scratch(spark, "stream")
    stream.run_to_table(stream.closed_bars(ticks), f"{out}/bars", f"{out}/state")
    return spark.read.parquet(f"{out}/bars")


# ledgers and plain relations


@register("ledger_specs_rollup", """SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS runs, last_run, coalesce(fam, 0) AS family_trials FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_run FROM orders GROUP BY 1) r ON o_custkey = c_custkey
LEFT JOIN (SELECT c_mktsegment AS seg, count(DISTINCT o_orderkey) AS fam FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) f ON seg = c_mktsegment""")
def ledger_specs_rollup(spark, d):
    """Specs (customers) with their runs (orders) and the trials of their family (segment)."""
    c, o = src.table(spark, d, "customer"), src.table(spark, d, "orders")
    runs = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("runs"), F.max("o_orderdate").alias("last_run"))
    family = c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.count_distinct("o_orderkey").alias("family_trials"))
    out = c.join(runs, "c_custkey", "left").join(family, "c_mktsegment", "left")
    return out.select("c_custkey", "c_mktsegment", F.coalesce("runs", F.lit(0)).alias("runs"), "last_run", F.coalesce("family_trials", F.lit(0)).alias("family_trials"))


@register("trial_counts", "SELECT c_mktsegment, count(*) AS trials, count(DISTINCT o_custkey || '/' || o_orderpriority) AS distinct_trials, count(*) FILTER (o_orderstatus = 'O') AS open, round(var_samp(o_totalprice), 2) AS var_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def trial_counts(spark, d):
    o = src.table(spark, d, "orders").join(src.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_mktsegment").agg(F.count("*").alias("trials"), F.count_distinct("o_custkey", "o_orderpriority").alias("distinct_trials"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.round(F.var_samp("o_totalprice"), 2).alias("var_price"))


@register("latest_per_key", "SELECT o_custkey, o_orderpriority, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_per_key(spark, d):
    newest = F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("r")
    return src.table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(newest).select("o_custkey", "o_orderpriority", "r.*")


@register("topk_per_group", "SELECT l_returnflag, l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 10")
def topk_per_group(spark, d):
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return src.table(spark, d, "lineitem").withColumn("k", F.row_number().over(w)).where("k <= 10").select("l_returnflag", "l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"))


@register("semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_exists(spark, d):
    return src.table(spark, d, "customer").join(src.table(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@register("union_relaxed", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(NULL AS DOUBLE) AS balance FROM nation UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def union_relaxed(spark, d):
    a = src.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    b = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@register("set_difference", "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_difference(spark, d):
    return src.table(spark, d, "part").select(F.col("p_partkey").alias("id")).subtract(src.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id")))


@register("set_intersection", "SELECT c_nationkey AS id FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, d):
    return src.table(spark, d, "customer").select(F.col("c_nationkey").alias("id")).intersect(src.table(spark, d, "supplier").select(F.col("s_nationkey").alias("id")))


@register("momentum_by_hour", f"""WITH {qf._SEQUENCE}, m AS (SELECT *, lead(close) OVER {q.W} - close AS nxt FROM sq) SELECT CAST(date_part('hour', ts_utc) AS INTEGER) AS hour, count(*) AS n, round(avg(nxt), 6) AS mean_next FROM m WHERE close_loc > 0.7 AND streak >= 2 GROUP BY 1""")
def momentum_by_hour(spark, d):
    b = features.sequence(features.anatomy(qf.m5(spark, d)))
    b = b.withColumn("nxt", F.lead("close").over(Window.partitionBy("symbol").orderBy("ts_utc")) - F.col("close"))
    return b.where("close_loc > 0.7 and streak >= 2").groupBy(F.hour("ts_utc").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("nxt"), 6).alias("mean_next"))


@register("trades_page", q.query(TRADES, "trades", ["decision_time", "exit_reason"], ["r_net"], "WHERE scenario = 'base' ORDER BY decision_time, side LIMIT 50 OFFSET 100", places=5))
def trades_page(spark, d):
    """A page of one scenario's trades."""
    t = labelled(spark, d).where("scenario = 'base'").orderBy("decision_time", "side").offset(100).limit(50)
    return rounded(t.select("decision_time", "exit_reason", "r_net"), 5)


# tiers, folds over trades, screens, registers

_TIERS = """cuts AS (SELECT symbol AS cs, CAST(CAST(min(ts_utc) + to_seconds(CAST(floor((epoch(max(ts_utc)) - epoch(min(ts_utc))) * 0.6) AS BIGINT)) AS DATE) + 1 AS TIMESTAMP) AS b_start,
  CAST(CAST(min(ts_utc) + to_seconds(CAST(floor((epoch(max(ts_utc)) - epoch(min(ts_utc))) * 0.8) AS BIGINT)) AS DATE) + 1 AS TIMESTAMP) AS c_start FROM m1 GROUP BY symbol)"""
_TIER = "CASE WHEN decision_time < b_start THEN 'A' WHEN decision_time < c_start THEN 'B' ELSE 'C' END"


@register("signal_preview", f"WITH {qf.SIGNALS}, {_TIERS}, pv AS (SELECT sig.symbol, {_TIER} AS tier, side FROM sig JOIN cuts ON cs = sig.symbol) SELECT symbol, tier, count(*) AS n, count(*) FILTER (side > 0) AS long_signals, count(*) FILTER (side < 0) AS short_signals FROM pv WHERE tier <> 'C' GROUP BY symbol, tier")
def signal_preview(spark, d):
    """How many signals a rule gives on tiers A and B; C stays hidden."""
    s = research.with_tier(signals(spark, d), research.tiers(src.bars(spark, d, 1))).where("tier <> 'C'")
    return s.groupBy("symbol", "tier").agg(F.count("*").alias("n"), F.count_if(F.col("side") > 0).alias("long_signals"), F.count_if(F.col("side") < 0).alias("short_signals"))


def fold_table(spark, d):
    """Four folds over the history: three sevenths of its days for training, one for the test, each a seventh later."""
    span = src.bars(spark, d, 1).agg(F.min("ts_utc").alias("a"), F.max("ts_utc").alias("z")).first()
    first, unit = datetime(span.a.year, span.a.month, span.a.day), timedelta(days=max(1, (span.z.date() - span.a.date()).days // 7))
    rows = [(i, first + i * unit, first + (i + 3) * unit, first + (i + 4) * unit) for i in range(4)]
    return spark.createDataFrame(rows, "fold int, train_start timestamp_ntz, test_start timestamp_ntz, test_end timestamp_ntz")


_FOLD_SQL = """sp AS (SELECT CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) AS first, greatest(1, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) // 7) AS unit FROM events),
fo AS (SELECT CAST(range AS INTEGER) AS fold, first + INTERVAL 1 DAY * (range * unit) AS train_start, first + INTERVAL 1 DAY * ((range + 3) * unit) AS test_start, first + INTERVAL 1 DAY * ((range + 4) * unit) AS test_end FROM sp, range(0, 4))"""
_WALK = f"""{TRADES}, {_FOLD_SQL}, wf AS (SELECT fold, '0' AS variant, count(*) FILTER (decision_time < test_start) AS train_n, avg(r_net) FILTER (decision_time < test_start) AS train_expectancy_r, count(*) FILTER (decision_time >= test_start) AS test_n,
  avg(r_net) FILTER (decision_time >= test_start) AS test_expectancy_r, coalesce(sum(r_net) FILTER (decision_time >= test_start), 0) AS test_total_r FROM trades JOIN fo ON decision_time >= train_start AND decision_time < test_end WHERE scenario = 'pessimistic' GROUP BY fold HAVING count(*) FILTER (decision_time < test_start) >= 10)"""
register("walk_forward_fixed", q.query(_WALK, "wf", ["fold", "variant", "train_n", "test_n"], ["train_expectancy_r", "test_expectancy_r", "test_total_r"], places=4))(
    lambda spark, d: rounded(research.walk_forward(labelled(spark, d).where("scenario = 'pessimistic'").withColumn("variant", F.lit("0")), fold_table(spark, d)), 4)
)


_WALK_GRID = f"""WITH {_FOLD_SQL}, t AS ({_each_variant("scenario = 'pessimistic'")}),
w AS (SELECT fold, variant, stop_atr, target_atr, count(*) FILTER (decision_time < test_start) AS train_n, avg(r_net) FILTER (decision_time < test_start) AS train_r, count(*) FILTER (decision_time >= test_start) AS test_n,
  avg(r_net) FILTER (decision_time >= test_start) AS test_r, coalesce(sum(r_net) FILTER (decision_time >= test_start), 0) AS test_total FROM t JOIN fo ON decision_time >= train_start AND decision_time < test_end GROUP BY ALL)
SELECT fold, train_n, round(train_r, 4) AS train_expectancy_r, test_n, round(test_r, 4) AS test_expectancy_r, round(test_total, 4) AS test_total_r, stop_atr, target_atr FROM w WHERE train_n >= 10
QUALIFY row_number() OVER (PARTITION BY fold ORDER BY train_r DESC, variant) = 1"""


@register("walk_forward_grid", _WALK_GRID)
def walk_forward_grid(spark, d):
    """Each fold takes the variant of the grid that was best on its training days."""
    t = variants_of(spark, d).where("scenario = 'pessimistic'")
    numbers = t.select("variant", "stop_atr", "target_atr").distinct()
    return rounded(research.walk_forward(t, fold_table(spark, d)).join(numbers, "variant").drop("variant"), 4)


_BASE = f"{qf._HYG}, kb AS (SELECT *, row_number() OVER (ORDER BY event_time) - 1 AS k, count(*) OVER () AS n FROM hy WHERE NOT hyg_no_entry AND atr_pts > 0), sig AS (SELECT symbol, available_at AS decision_time, event_time, unnest([1, -1]) AS side, atr_pts FROM kb WHERE k % greatest(n // 30000, 1) = 0)"
_LIFT = ["target_rate", "mean_r_net", "mean_r_gross"]
_STATS = "SELECT symbol, scenario, count(*) AS n, avg(CAST(label = 1 AS DOUBLE)) AS target_rate, avg(r_net) AS mean_r_net, avg(r_before_costs) AS mean_r_gross FROM {} GROUP BY symbol, scenario"


def _baseline_trades(spark, d):
    return research.triple_barrier(simulate.label(research.baseline(qf.hygienic(spark, d)), path(spark, d), EXIT))


_BASE_TRADES = trades_sql(_BASE).replace("hd = decision_time AND hs = scenario", "hd = decision_time AND hs = scenario AND hside = side").replace("SELECT decision_time AS hd, scenario AS hs", "SELECT decision_time AS hd, scenario AS hs, side AS hside").replace("h2 AS (SELECT decision_time, scenario, ht", "h2 AS (SELECT decision_time, scenario, side, ht")
register("baseline_study", q.query(f"{_BASE_TRADES}, bs AS ({_STATS.format('trades')})", "bs", ["symbol", "scenario", "n"], _LIFT, places=4))(
    lambda spark, d: rounded(research.study_stats(_baseline_trades(spark, d)).select("symbol", "scenario", "n", *_LIFT), 4)
)
_LIFT_SQL = f"""SELECT a.symbol, a.scenario, a.n, {', '.join(f'round(a.{c}, 4) AS {c}' for c in _LIFT)}, round(b.target_rate, 4) AS base_target_rate, round(b.mean_r_net, 4) AS base_mean_r_net, round(a.target_rate - b.target_rate, 4) AS lift_target_rate,
  round(a.mean_r_net - b.mean_r_net, 4) AS lift_r_net, a.n >= 250 AS sufficient FROM (WITH {TRADES} {_STATS.format('trades')}) a JOIN (WITH {_BASE_TRADES} {_STATS.format('trades')}) b ON a.symbol = b.symbol AND a.scenario = b.scenario"""


@register("study_lift", _LIFT_SQL)
def study_lift(spark, d):
    """The rule's trades beside those of every eligible bar under the same barriers."""
    return rounded(research.lift(research.study_stats(labelled(spark, d)), research.study_stats(_baseline_trades(spark, d))), 4)


def _sweep_events(spark, d):
    b = features.session(features.daily(qf.m5(spark, d)))
    return research.previous_day_sweeps(b, "pdh", least_bars=60).unionByName(research.previous_day_sweeps(b, "pdl", least_bars=60))


_EVENTS = f"{qf._DAILY}, sig AS ({qf._sweep_sql('pdh', -1).replace('depth_atr, trading_day', 'depth_atr, trading_day, atr_pts')} UNION ALL {qf._sweep_sql('pdl', 1).replace('depth_atr, trading_day', 'depth_atr, trading_day, atr_pts')})"
register("pattern_study", q.query(f"{trades_sql(_EVENTS)}, ps AS ({_STATS.format('trades')})", "ps", ["symbol", "scenario", "n"], _LIFT, places=4))(
    lambda spark, d: rounded(research.study_stats(research.triple_barrier(simulate.label(manifest.staged(_sweep_events(spark, d), "sweeps"), path(spark, d), EXIT))).select("symbol", "scenario", "n", *_LIFT), 4)
)
_SANE = " UNION ALL ".join(f"SELECT symbol, '{v}' AS level, count(*) AS bars, count(DISTINCT trading_day) AS days, count(*) FILTER ({v}_sweep) AS sweeps, count(DISTINCT trading_day) FILTER ({v}_sweep) AS days_with_sweeps, round(avg({v}_sweep_depth_atr), 6) AS mean_depth_atr FROM da GROUP BY symbol" for v in ("pdh", "pdl"))


@register("detector_sanity", f"WITH {qf._DAILY} {_SANE}")
def detector_sanity(spark, d):
    """How often the detectors fire at all."""
    levels = F.explode(F.array(*(F.struct(F.lit(v).alias("level"), F.col(f"{v}_sweep").alias("on"), F.col(f"{v}_sweep_depth_atr").alias("depth")) for v in ("pdh", "pdl"))))
    b = features.daily(qf.m5(spark, d)).select("symbol", "trading_day", levels.alias("l")).select("symbol", "trading_day", "l.*")
    swept = F.when(F.col("on"), F.col("trading_day"))
    return b.groupBy("symbol", "level").agg(F.count("*").alias("bars"), F.count_distinct("trading_day").alias("days"), F.count_if("on").alias("sweeps"), F.count_distinct(swept).alias("days_with_sweeps"), F.round(F.avg("depth"), 6).alias("mean_depth_atr"))


@register("behaviour_screen")
def behaviour_screen(spark, d):
    """All registered behaviours over the whole feature table, priced in one frame, screened by Benjamini-Hochberg."""
    rows = manifest.staged(table.whole(manifest.staged(src.bars(spark, d, 1), "minute")), "features")
    found = manifest.staged(behaviours.events(rows, behaviours.library()), "events")
    trades = manifest.staged(simulate.label(found, path(spark, d), EXIT).where("scenario = 'pessimistic'"), "trades")
    return rounded(research.screen(trades), 4)


_MADE = """SELECT c_mktsegment AS name, o_orderpriority || o_orderstatus AS hash, o_orderdate AS proposed_at FROM orders JOIN customer ON o_custkey = c_custkey"""


@register("preregistration", f"WITH p AS ({_MADE}), f AS (SELECT name, hash, min(proposed_at) AS registered_at FROM p GROUP BY ALL) SELECT name, hash, CAST(row_number() OVER (PARTITION BY name ORDER BY registered_at, hash) AS INTEGER) AS version, registered_at FROM f")
def preregistration(spark, d):
    """Customers' segments as behaviours, orders as proposals of definitions: half are registered first, then all again."""
    o = src.table(spark, d, "orders").join(src.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = o.select(F.col("c_mktsegment").alias("name"), F.concat("o_orderpriority", "o_orderstatus").alias("hash"), F.col("o_orderdate").alias("proposed_at"))
    none = p.limit(0).select("name", "hash", F.lit(0).alias("version"), F.col("proposed_at").alias("registered_at"))
    early = p.where(F.col("proposed_at") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return behaviours.registered(behaviours.registered(none, early), p)


@register("unseal_once", "SELECT c_mktsegment AS name, o_orderkey AS id, o_orderdate AS asked_at, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate, o_orderkey) = 1 AS granted FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000")
def unseal_once(spark, d):
    o = src.table(spark, d, "orders").where("o_totalprice > 250000").join(src.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return behaviours.unsealed(o.select(F.col("c_mktsegment").alias("name"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("asked_at")))


_CHECK = f"""{TRADES}, {_TIERS}, tt AS (SELECT trades.*, {_TIER} AS tier FROM trades JOIN cuts ON cs = trades.symbol WHERE scenario = 'pessimistic'),
td AS (SELECT *, sum(r_net) OVER (PARTITION BY tier ORDER BY exit_time, decision_time ROWS UNBOUNDED PRECEDING) AS cum FROM tt), te AS (SELECT *, greatest(max(cum) OVER (PARTITION BY tier ORDER BY exit_time, decision_time ROWS UNBOUNDED PRECEDING), 0) - cum AS dd FROM td),
tm AS (SELECT tier, avg(r_net) AS e, count(*) AS n, sum(r_net) FILTER (r_net > 0) / nullif(-sum(r_net) FILTER (r_net < 0), 0) AS pf, max(dd) AS m FROM te GROUP BY tier)"""
_ITEMS = " UNION ALL ".join(f"SELECT 'demo' AS name, '{item}_{t}' AS item, (SELECT {test} FROM tm WHERE tier = '{t}') AS passed" for t in "AB" for item, test in (("expectancy", "e >= 0.1"), ("n", f"n >= {1000 if t == 'A' else 250}"), ("profit_factor", "pf >= 1.15"), ("drawdown", "m <= 15.0")))


@register("checklist_items", f"WITH {_CHECK} {_ITEMS}")
def checklist_items(spark, d):
    """The items of the checklist that tiers A and B decide, from the pessimistic trades of each."""
    t = research.with_tier(labelled(spark, d).where("scenario = 'pessimistic'"), research.tiers(src.bars(spark, d, 1)))
    return research.checklist_rows(metrics.summary(t, ("tier",)).withColumn("name", F.lit("demo")))


_KIND = TRADES.replace("WHEN worse THEN stop ELSE target END AS px", "WHEN better THEN target ELSE stop END AS px").replace("WHEN worse THEN 'stop' ELSE 'target' END AS why", "WHEN better THEN 'target' ELSE 'stop' END AS why").replace("WHEN worse THEN 'stop' ELSE 'limit' END AS ord", "WHEN better THEN 'limit' ELSE 'stop' END AS ord")
_MEANS = "SELECT symbol, avg(r_net) AS r, avg(CAST(ambiguous AS DOUBLE)) AS rate FROM (WITH {} SELECT * FROM trades WHERE scenario = 'pessimistic') GROUP BY symbol"


_VP, _VD = ["tier", "scenario", "n", "wins", "long_trades", "short_trades"], ["win_rate", "expectancy_r", "median_r", "std_r", "total_r", "profit_factor", "max_dd_r", "stderr_r", "target_share", "stop_share", "time_share", "mean_held_min", "longest_held_min"]
_OVER = "OVER (PARTITION BY tier, scenario ORDER BY exit_time, decision_time ROWS UNBOUNDED PRECEDING)"
_VALID = f"""{TRADES}, {_TIERS}, va AS (SELECT trades.*, {_TIER} AS own FROM trades JOIN cuts ON cs = trades.symbol), vb AS (SELECT *, unnest([own, 'AB']) AS tier FROM va WHERE own <> 'C'), vc AS (SELECT *, sum(r_net) {_OVER} AS cum FROM vb),
vd AS (SELECT *, greatest(max(cum) {_OVER}, 0) - cum AS dd, (epoch(exit_time) - epoch(entry_time)) / 60 AS held FROM vc), valid AS (SELECT tier, scenario, count(*) AS n, count(*) FILTER (r_net > 0) AS wins, count(*) FILTER (side > 0) AS long_trades, count(*) FILTER (side < 0) AS short_trades,
  avg(CAST(r_net > 0 AS DOUBLE)) AS win_rate, avg(r_net) AS expectancy_r, median(r_net) AS median_r, stddev_samp(r_net) AS std_r, sum(r_net) AS total_r, sum(r_net) FILTER (r_net > 0) / nullif(-sum(r_net) FILTER (r_net < 0), 0) AS profit_factor, max(dd) AS max_dd_r,
  stddev_samp(r_net) / sqrt(count(*)) AS stderr_r, avg(CAST(exit_reason = 'target' AS DOUBLE)) AS target_share, avg(CAST(exit_reason LIKE 'stop%' AS DOUBLE)) AS stop_share, avg(CAST(exit_reason = 'time' AS DOUBLE)) AS time_share, avg(held) AS mean_held_min, max(held) AS longest_held_min FROM vd GROUP BY tier, scenario)"""
register("validation", q.query(_VALID, "valid", _VP, _VD, places=4))(lambda spark, d: rounded(research.validation(labelled(spark, d), research.tiers(src.bars(spark, d, 1))).select(*_VP, *_VD), 4))


@register("ambiguity_sensitivity", f"SELECT a.symbol, round(a.r, 4) AS pessimistic_r, round(a.rate, 4) AS ambiguity_rate, round(b.r, 4) AS optimistic_r, round(b.r - a.r, 4) AS difference_r FROM ({_MEANS.format(TRADES)}) a JOIN ({_MEANS.format(_KIND)}) b ON a.symbol = b.symbol")
def ambiguity_sensitivity(spark, d):
    """What it changes to settle bars that hit both stop and target for the other side."""
    s, p = signals(spark, d), manifest.staged(path(spark, d), "path")
    out = None
    for policy in ("pessimistic", "optimistic"):
        rule = simulate.Exit(stop_atr=1.0, target_atr=1.5, time_exit_bars=24, policy=policy)
        t = simulate.label(s, p, rule).where("scenario = 'pessimistic'").groupBy("symbol").agg(F.avg("r_net").alias(f"{policy}_r"), F.avg(F.col("ambiguous").cast("double")).alias("ambiguity_rate"))
        out = t if out is None else out.join(t.drop("ambiguity_rate"), "symbol")
    return rounded(out.withColumn("difference_r", F.col("optimistic_r") - F.col("pessimistic_r")), 4)


@register("month_windows", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS starts, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS ends, count(*) AS n FROM orders GROUP BY ALL")
def month_windows(spark, d):
    """A history fetched by half-open months: every row is in exactly one window."""
    o = src.table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("t"))
    start = F.date_trunc("month", "t").cast("timestamp_ntz")
    return o.groupBy(start.alias("starts")).agg(F.count("*").alias("n")).select("starts", F.add_months("starts", 1).cast("timestamp_ntz").alias("ends"), "n")


@register("cost_summary", f"WITH {qb._PRICED}, sr AS (SELECT symbol, spread_source, count(*) AS n, avg(spread_optimistic) AS optimistic, avg(spread_base) AS base, avg(spread_pessimistic) AS pessimistic, avg(CAST(in_rollover_window AS DOUBLE)) AS rollover_share FROM priced GROUP BY symbol, spread_source) SELECT symbol, spread_source, n, round(optimistic, 4) AS optimistic, round(base, 4) AS base, round(pessimistic, 4) AS pessimistic, round(rollover_share, 4) AS rollover_share FROM sr")
def cost_summary(spark, d):
    """What a cost build reports: bars and mean spreads by where they come from."""
    p = qb.priced(spark, d)
    return rounded(p.groupBy("symbol", "spread_source").agg(F.count("*").alias("n"), *(F.avg(f"spread_{c}").alias(c) for c in ("optimistic", "base", "pessimistic")), F.avg(F.col("in_rollover_window").cast("double")).alias("rollover_share")), 4)


@register("profile_choice", "SELECT c_custkey, o_orderkey AS profile, o_orderstatus AS status FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def profile_choice(spark, d):
    """The profile in use: the newest validated one (status F), else the newest."""
    valid = F.col("o_orderstatus") == "F"
    pick = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct(valid, "o_orderdate", "o_orderkey")).alias("r")
    return src.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(pick).select("c_custkey", F.col("r.o_orderkey").alias("profile"), F.col("r.o_orderstatus").alias("status"))


@register("stream_sessions", """WITH g AS (SELECT ts, epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) >= 600000000 AS new FROM events), i AS (SELECT ts, sum(CAST(coalesce(new, true) AS INTEGER)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT 'ALL' AS symbol, min(ts) AS starts, max(ts) + INTERVAL 10 MINUTE AS ends, count(*) AS ticks FROM i GROUP BY k) SELECT * FROM s WHERE ends <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""")
def stream_sessions(spark, d):
    """Runs of ticks without a gap of ten minutes, as a stream; the run that may still go on is not there."""
    schema = src.table(spark, d, "events").schema
    ticks = src.from_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))
    out = manifest.scratch(spark, "stream")
    with stream.merged_before_shuffle(spark):
        stream.run_to_table(stream.sessions(ticks, "10 minutes"), f"{out}/sessions", f"{out}/state")
    return spark.read.parquet(f"{out}/sessions")


@register("stream_quote_durations", q.query(f"{qb._HIST}, closed AS (SELECT * FROM hist WHERE time_bucket(INTERVAL '5 minutes', ts_utc) + INTERVAL 6 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE)", "closed", ["symbol", "ts_utc", "spread_points", "ticks"], ["seconds"]))
def stream_quote_durations(spark, d):
    """How long each spread was quoted, from a stream with state and timers: the tick histogram of all closed buckets."""
    schema = src.table(spark, d, "events").schema
    ticks = src.from_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))
    out = manifest.scratch(spark, "stream")
    with stream.state_in_rocksdb(spark):
        stream.run_to_table(quotes.durations(ticks), f"{out}/durations", f"{out}/state")
    return rounded(spark.read.parquet(f"{out}/durations").select("symbol", "ts_utc", "spread_points", "ticks", "seconds"))


# a search over rules, and the ledger that it is kept in

SPACE = {
    "name": "closes", "family": "closes", "method": "evolutionary", "population": 8, "max_trials": 16, "min_trades": 30, "top_k": 3, "seed": 7,
    "blocks": [
        {"label": "strong closes", "side": "long", "conditions": [{"feature": "close_loc", "op": ">", "value": 0.7}, {"feature": "streak", "op": ">=", "value": 2}]},
        {"label": "weak closes", "side": "short", "conditions": [{"feature": "close_loc", "op": "<", "value": 0.3}, {"feature": "streak", "op": "<=", "value": -2}]},
        {"label": "turn up", "side": "long", "conditions": [{"feature": "dirs_3", "op": "in", "value": ["DDU", "DUU"]}]},
        {"label": "turn down", "side": "short", "conditions": [{"feature": "dirs_3", "op": "in", "value": ["UUD", "UDD"]}]},
    ],
    "sessions": [None, ["london", "overlap"], ["asian"]], "stop_atr": [1.0, 1.5], "target_atr": [1.0, 1.5, 2.0], "time_exit_bars": [24],
}


@register("hypothesis_search")
def hypothesis_search(spark, d):
    """An evolutionary search over four building blocks: its leaderboard, with tier B for the best."""
    m = search.market(features.session(qf.with_rules(spark, d)), path(spark, d), src.bars(spark, d, 1))
    return rounded(search.run(SPACE, m, lg.Ledger(spark, manifest.scratch(spark, "ledger")), "closes"), 4)


@register("ledger_trials", """SELECT c_mktsegment AS family, count(*) AS trials, count(DISTINCT o_custkey || '/' || left(o_orderpriority, 1)) AS distinct_trials, round(var_samp(o_totalprice / 1000), 4) AS var_sharpe
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def ledger_trials(spark, d):
    """Orders as trials of their segment's family, appended by four writers at once and read as one version."""
    o = src.table(spark, d, "orders").join(src.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    trials = o.select(F.col("c_mktsegment").alias("family"), F.col("o_custkey").cast("string").alias("spec_hash"), F.left("o_orderpriority", F.lit(1)).alias("tier"), (F.col("o_totalprice") / 1000).alias("sharpe"), F.col("o_orderkey").alias("n"))
    kept_in = manifest.scratch(spark, "ledger")
    with ThreadPoolExecutor(4) as writers:
        list(writers.map(lambda k: lg.record_trials(lg.Ledger(spark, kept_in), trials.where(F.pmod(F.xxhash64("n"), F.lit(4)) == k)), range(4)))
    return rounded(lg.family_trials(lg.Ledger(spark, kept_in)), 4)
