"""What a set of trades was worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scan

KEYS = ("symbol", "scenario")
LEAST_IN_BUCKET = 10


def profit_factor(column: str = "r_net") -> Column:
    r = F.col(column)
    gains, losses = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), -F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0))
    return F.when(losses > 0, gains / F.when(losses > 0, losses)).when(gains > 0, F.lit(float("inf")))


def with_drawdown(trades: DataFrame, keys=KEYS, order=("exit_time", "decision_time")) -> DataFrame:
    """Trades with cum_r and dd_r, the fall from the best sum so far, the start of 0 included."""
    return scan.drawdown(trades, "r_net", keys, order[0], order, "cum_r", "dd_r")


def summary(trades: DataFrame, keys=KEYS) -> DataFrame:
    """One row a key. Skew and kurtosis are means of powers of z with the sample deviation; the kurtosis is not in excess."""
    R = F.col("r_net")
    t = with_drawdown(trades, keys)
    n = F.count("*")
    share = (n - 1) / n
    out = t.groupBy(*keys).agg(
        n.alias("n"), F.count_if(R > 0).alias("wins"), F.avg((R > 0).cast("double")).alias("win_rate"), F.avg(R).alias("expectancy_r"), F.median(R).alias("median_r"),
        F.stddev_samp(R).alias("std_r"), F.sum(R).alias("total_r"), profit_factor().alias("profit_factor"), F.max("dd_r").alias("max_dd_r"),
        F.when(F.stddev_samp(R) > 0, F.skewness(R) * F.pow(share, 1.5)).otherwise(0.0).alias("skew"), F.when(F.stddev_samp(R) > 0, (F.kurtosis(R) + 3) * F.pow(share, 2.0)).otherwise(0.0).alias("kurtosis"),
        F.avg(F.col("ambiguous").cast("double")).alias("ambiguity_rate"), F.avg(F.col("spread_measured").cast("double")).alias("measured_spread_share"), F.avg("r_before_costs").alias("expectancy_before_costs_r"),
        *(F.avg(c).alias(c) for c in ("cost_spread_r", "cost_slippage_r", "cost_commission_r", "cost_swap_r")),
        F.count_if(F.col("side") > 0).alias("long_trades"), F.count_if(F.col("side") < 0).alias("short_trades"), F.min("decision_time").alias("first_trade"), F.max("decision_time").alias("last_trade"),
    )
    return out.withColumns({"stderr_r": F.when(F.col("n") > 1, F.col("std_r") / F.sqrt("n")), "sharpe_per_trade": F.when(F.col("std_r") > 0, F.col("expectancy_r") / F.col("std_r"))})


def breakdown(trades: DataFrame, buckets: dict[str, Column], keys=KEYS) -> DataFrame:
    """One row for each value of each bucketing, in one pass: by, bucket, n, expectancy_r, total_r, win_rate."""
    R = F.col("r_net")
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("by"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("bucket")) for k, c in buckets.items())))
    rows = trades.select(*keys, R, long.alias("b")).select(*keys, "r_net", "b.*")
    return rows.groupBy(*keys, "by", "bucket").agg(F.count("*").alias("n"), F.avg(R).alias("expectancy_r"), F.sum(R).alias("total_r"), F.avg((R > 0).cast("double")).alias("win_rate"))


def calendar_buckets() -> dict[str, Column]:
    t = F.col("decision_time")
    return {"year": F.year(t), "month": F.date_format(t, "yyyy-MM"), "weekday": F.weekday(t) + 1, "side": F.when(F.col("side") > 0, "long").otherwise("short")}


def stability(buckets: DataFrame, keys=KEYS, least: int = LEAST_IN_BUCKET) -> DataFrame:
    """Share of the buckets with enough trades that made money."""
    scored = buckets.where(F.col("n") >= least)
    return scored.groupBy(*keys, "by").agg(F.count("*").alias("buckets_scored"), F.count_if(F.col("expectancy_r") > 0).alias("positive"), F.avg((F.col("expectancy_r") > 0).cast("double")).alias("score"))


def equity_curve(trades: DataFrame, points: int = 1500, keys=KEYS) -> DataFrame:
    """At most ``points`` evenly spaced points, first and last included."""
    t = scan.scan(with_drawdown(trades, keys), {"k": (scan.SUM, F.lit(1))}, keys, "exit_time", ("exit_time", "decision_time"))
    t = t.withColumn("k", F.col("k") - 1).join(trades.groupBy(*keys).agg(F.count("*").alias("n")), list(keys))
    m = F.least("n", F.lit(points))
    slot = F.floor(F.col("k") * (m - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    before = F.floor((F.col("k") - 1) * (m - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    return t.where((F.col("k") == 0) | (slot > before)).select(*keys, "exit_time", "cum_r", "dd_r")
