"""Declarative strategies: validated documents compiled to column expressions."""

from __future__ import annotations

import copy
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import all_of, any_of, exactly_one, truth
from tidemark.sources.manifest import canonical_hash

COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}
MOST_RULES, MOST_CONDITIONS = 4, 12


def condition(c: dict) -> Column:
    """One condition; an unknown value fulfils none, not even not_in and !=."""
    x, op, v = F.col(c["feature"]), c["op"], c["value"]
    if op in COMPARE:
        return truth(COMPARE[op](x, F.lit(v)))
    if op == "between":
        return truth(x.between(*v))
    if op == "in":
        return truth(x.isin(v))
    if op == "not_in":
        return truth(~x.isin(v))
    raise ValueError(f"unknown operator {op!r}")


def gates(spec: dict) -> dict[str, Column]:
    """Named conditions that any signal must meet."""
    f = spec.get("filters", {})
    out = {"hygiene": ~F.coalesce(F.col("hyg_no_entry"), F.lit(True)), "atr": truth(F.col("atr_pts") > 0)}
    for name, column in (("sessions", "session"), ("regimes", "vol_regime"), ("hours", "hour_utc"), ("weekdays", "dow")):
        if f.get(name):
            out[name] = truth(F.col(column).isin(f[name]))
    if f.get("max_spread_rel") is not None:
        out["max_spread_rel"] = truth(F.col("spread_rel") <= f["max_spread_rel"])
    return out


def side_rule(spec: dict, side: str) -> Column:
    """All conditions of a rule, any rule of a side."""
    return any_of([all_of([condition(c) for c in rule["conditions"]]) for rule in spec["rules"] if rule["side"] == side])


def columns_needed(spec: dict) -> list[str]:
    own = [c["feature"] for r in spec["rules"] for c in r["conditions"]]
    gate = {"sessions": "session", "regimes": "vol_regime", "hours": "hour_utc", "weekdays": "dow", "max_spread_rel": "spread_rel"}
    extra = [col for k, col in gate.items() if spec.get("filters", {}).get(k)]
    return list(dict.fromkeys(["symbol", "event_time", "available_at", "atr_pts", "hyg_no_entry", *own, *extra]))


def signals(features: DataFrame, spec: dict, research_only: bool = False) -> DataFrame:
    """symbol, decision_time, event_time, side, atr_pts: rows on which exactly one side fires."""
    if research_only:
        features = features.where("in_research_window")
    rows = features.select(*columns_needed(spec)).withColumns({"_long": side_rule(spec, "long"), "_short": side_rule(spec, "short")})
    rows = rows.where(all_of(list(gates(spec).values())) & exactly_one(F.col("_long"), F.col("_short")))
    return rows.select("symbol", F.col("available_at").alias("decision_time"), "event_time", F.when(F.col("_long"), 1).otherwise(-1).alias("side"), "atr_pts")


def explain(features: DataFrame, spec: dict) -> DataFrame:
    """A row for each bar and check: its name, the actual value as text, whether it passed."""
    checks = [F.struct(F.lit(f"gate {k}").alias("name"), F.lit(None).cast("string").alias("actual"), g.alias("passed")) for k, g in gates(spec).items()]
    for i, rule in enumerate(spec["rules"]):
        for c in rule["conditions"]:
            checks.append(F.struct(F.lit(f"{rule['side']} {i + 1}: {c['feature']} {c['op']} {c['value']}").alias("name"), F.col(c["feature"]).cast("string").alias("actual"), condition(c).alias("passed")))
    return features.select("symbol", "event_time", F.explode(F.array(*checks)).alias("c")).select("symbol", "event_time", "c.*")


def validate(spec: dict, known: dict[str, str]) -> list[str]:
    """Faults of a document; ``known`` maps features to their Spark types."""
    faults = []
    rules = spec.get("rules") or []
    if not 1 <= len(rules) <= MOST_RULES:
        faults.append(f"one to {MOST_RULES} rules")
    for r in rules:
        if r.get("side") not in ("long", "short"):
            faults.append(f"side {r.get('side')!r}")
        if not 1 <= len(r.get("conditions") or []) <= MOST_CONDITIONS:
            faults.append(f"one to {MOST_CONDITIONS} conditions a rule")
        for c in r.get("conditions") or []:
            kind = known.get(c.get("feature"))
            op, v = c.get("op"), c.get("value")
            if kind is None:
                faults.append(f"unknown feature {c.get('feature')!r}")
            elif op not in (*COMPARE, "between", "in", "not_in"):
                faults.append(f"unknown operator {op!r}")
            elif op == "between" and not (isinstance(v, list) and len(v) == 2 and v[0] <= v[1]):
                faults.append(f"{c['feature']}: between takes two values in order")
            elif op in ("in", "not_in") and not (isinstance(v, list) and v):
                faults.append(f"{c['feature']}: {op} takes a list")
            elif kind in ("string", "boolean") and op not in ("==", "!=", "in", "not_in"):
                faults.append(f"{c['feature']}: {op} does not fit {kind}")
    stop = spec.get("exit", {}).get("stop_atr")
    if not stop or stop <= 0:
        faults.append("a stop above zero")
    return faults


def spec_hash(spec: dict) -> str:
    """Names and notes don't count, the family does."""
    return canonical_hash({k: v for k, v in spec.items() if k not in ("name", "notes")})


def get_path(spec: dict, path: str):
    return reduce(lambda d, k: d[int(k)] if isinstance(d, list) else d[k], path.split("."), spec)


def with_parameters(spec: dict, values: dict) -> dict:
    """A copy with values at dotted paths, which must exist."""
    out = copy.deepcopy(spec)
    for path, v in values.items():
        get_path(out, path)
        *head, last = path.split(".")
        at = get_path(out, ".".join(head)) if head else out
        at[int(last) if isinstance(at, list) else last] = v
    return out


def draft_conditions(row: dict, kinds: dict[str, str]) -> list[dict]:
    """Conditions that a bar would meet: events and codes as they are, fractions and distances within a margin, counts at least."""
    out = []
    for name, value in row.items():
        unit = kinds.get(name)
        if value is None or unit is None:
            continue
        if unit == "bool" and value:
            out.append({"feature": name, "op": "==", "value": True})
        elif unit in ("code", "label", "sign"):
            out.append({"feature": name, "op": "==", "value": value})
        elif unit == "frac":
            out.append({"feature": name, "op": "between", "value": [round(max(0.0, value - 0.15), 4), round(min(1.0, value + 0.15), 4)]})
        elif unit == "atr":
            margin = max(0.25, abs(value) * 0.3)
            out.append({"feature": name, "op": "between", "value": [round(value - margin, 4), round(value + margin, 4)]})
        elif unit in ("count", "bars"):
            out.append({"feature": name, "op": ">=", "value": value})
    return out
