"""Registered behaviours: documents of a side and conditions, studied together and screened for false discoveries."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import all_of, truth
from tidemark.plans.strategy import condition
from tidemark.sources.manifest import canonical_hash

#: The registered behaviours.
LIBRARY = [
    {"id": "momentum_cont_long", "side": "long", "conditions": [{"feature": "ret5_atr", "op": ">=", "value": 1.5}, {"feature": "close_loc", "op": ">=", "value": 0.7}, {"feature": "dir", "op": "==", "value": 1}]},
    {"id": "momentum_cont_short", "side": "short", "conditions": [{"feature": "ret5_atr", "op": "<=", "value": -1.5}, {"feature": "close_loc", "op": "<=", "value": 0.3}, {"feature": "dir", "op": "==", "value": -1}]},
    {"id": "breakout_retest_long", "side": "long", "conditions": [{"feature": "retest_up", "op": "==", "value": True}]},
    {"id": "breakout_retest_short", "side": "short", "conditions": [{"feature": "retest_down", "op": "==", "value": True}]},
    {"id": "failed_breakout_short", "side": "short", "conditions": [{"feature": "failed_break_up", "op": "==", "value": True}]},
    {"id": "failed_breakout_long", "side": "long", "conditions": [{"feature": "failed_break_down", "op": "==", "value": True}]},
    {"id": "support_rejection_long", "side": "long", "conditions": [
        {"feature": "sr_below_low_dist_atr", "op": "<", "value": 0},
        {"feature": "sr_below_touches", "op": ">=", "value": 3},
        {"feature": "lower_wick_frac", "op": ">=", "value": 0.4},
    ]},
    {"id": "resistance_rejection_short", "side": "short", "conditions": [
        {"feature": "sr_above_high_dist_atr", "op": "<", "value": 0},
        {"feature": "sr_above_touches", "op": ">=", "value": 3},
        {"feature": "upper_wick_frac", "op": ">=", "value": 0.4},
    ]},
    {"id": "sweep_low_reclaim_long", "side": "long", "conditions": [{"feature": "sweep_low", "op": "==", "value": True}, {"feature": "close_loc", "op": ">=", "value": 0.6}]},
    {"id": "sweep_high_reject_short", "side": "short", "conditions": [{"feature": "sweep_high", "op": "==", "value": True}, {"feature": "close_loc", "op": "<=", "value": 0.4}]},
    {"id": "compression_expansion_long", "side": "long", "conditions": [
        {"feature": "compression", "op": "<=", "value": 0.7},
        {"feature": "range_atr", "op": ">=", "value": 1.8},
        {"feature": "body_frac", "op": ">=", "value": 0.6},
        {"feature": "dir", "op": "==", "value": 1},
    ]},
    {"id": "compression_expansion_short", "side": "short", "conditions": [
        {"feature": "compression", "op": "<=", "value": 0.7},
        {"feature": "range_atr", "op": ">=", "value": 1.8},
        {"feature": "body_frac", "op": ">=", "value": 0.6},
        {"feature": "dir", "op": "==", "value": -1},
    ]},
    {"id": "trendline_bounce_long", "side": "long", "conditions": [
        {"feature": "tl_up_dist_atr", "op": "between", "value": [0.0, 0.3]},
        {"feature": "dir", "op": "==", "value": 1},
        {"feature": "lower_wick_frac", "op": ">=", "value": 0.3},
    ]},
    {"id": "trendline_bounce_short", "side": "short", "conditions": [
        {"feature": "tl_dn_dist_atr", "op": "between", "value": [-0.3, 0.0]},
        {"feature": "dir", "op": "==", "value": -1},
        {"feature": "upper_wick_frac", "op": ">=", "value": 0.3},
    ]},
    {"id": "trendline_break_long", "side": "long", "conditions": [{"feature": "tl_dn_break", "op": "==", "value": True}]},
    {"id": "trendline_break_short", "side": "short", "conditions": [{"feature": "tl_up_break", "op": "==", "value": True}]},
    {"id": "range_floor_long", "side": "long", "conditions": [{"feature": "sw_trend", "op": "==", "value": 0}, {"feature": "rng_pos", "op": "<=", "value": 0.15}, {"feature": "close_loc", "op": ">=", "value": 0.6}]},
    {"id": "range_roof_short", "side": "short", "conditions": [{"feature": "sw_trend", "op": "==", "value": 0}, {"feature": "rng_pos", "op": ">=", "value": 0.85}, {"feature": "close_loc", "op": "<=", "value": 0.4}]},
]


def library() -> list[dict]:
    return copy.deepcopy(LIBRARY)


def definition_hash(behaviour: dict) -> str:
    """What counts is the side and the conditions, not the name."""
    return canonical_hash({k: behaviour[k] for k in ("side", "conditions")})


def events(features: DataFrame, behaviours: list[dict], allowed: Column | None = None) -> DataFrame:
    """All behaviours in one pass: a signal for each bar and behaviour that holds there, told apart by ``variant``."""
    ok = truth(F.col("atr_pts") > 0) & ~F.coalesce(F.col("hyg_no_entry"), F.lit(True))
    rows = features.where(ok if allowed is None else ok & allowed)
    fires = [F.when(all_of([condition(c) for c in b["conditions"]]), F.struct(F.lit(b["id"]).alias("variant"), F.lit(1 if b["side"] == "long" else -1).alias("side"))) for b in behaviours]
    rows = rows.select("symbol", F.col("available_at").alias("decision_time"), "event_time", "atr_pts", F.explode(F.filter(F.array(*fires), lambda f: f.isNotNull())).alias("f"))
    return rows.select("symbol", "decision_time", "event_time", "f.side", "atr_pts", "f.variant")


def registered(known: DataFrame, proposals: DataFrame) -> DataFrame:
    """What the register holds after the proposals: name, hash, version, registered_at.

    A definition that a name has already is the same row; a new one is the name's next version. Rows never change.
    ``known``: the same columns; ``proposals``: name, hash, proposed_at.
    """
    first = proposals.groupBy("name", "hash").agg(F.min("proposed_at").alias("registered_at")).join(known.select("name", "hash"), ["name", "hash"], "left_anti")
    last = known.groupBy("name").agg(F.max("version").alias("_last"))
    order = Window.partitionBy("name").orderBy("registered_at", "hash")
    new = first.join(last, "name", "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).cast("int"))
    return known.select("name", "hash", "version", "registered_at").unionByName(new.select("name", "hash", "version", "registered_at"))


def unsealed(requests: DataFrame) -> DataFrame:
    """Requests for the sealed tier (name, asked_at, id) with granted: the first of each name only."""
    order = Window.partitionBy("name").orderBy("asked_at", "id")
    return requests.withColumn("granted", F.row_number().over(order) == 1)
