"""Join shapes of the cost and quality models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_tables(a: DataFrame, b: DataFrame, on: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """One row a key of either side: in_a, in_b, and whether all columns agree within the tolerance."""
    left = a.select(*on, F.lit(True).alias("in_a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = b.select(*on, F.lit(True).alias("in_b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    both = left.join(right, on, "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.coalesce(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= tolerance, F.lit(False))
    return both.withColumns({"in_a": F.coalesce("in_a", F.lit(False)), "in_b": F.coalesce("in_b", F.lit(False)), "same": same})


def cascade(rows: DataFrame, levels: list[tuple[DataFrame, list[str]]], values: list[str], least: str) -> DataFrame:
    """``rows`` with ``values`` and ``level`` from the first level that has a row for its keys with ``least`` not null.

    All values of a row come from one level. Levels are small dimension tables, the last may have no keys.
    """
    out = rows
    for i, (cells, keys) in enumerate(levels):
        found = cells.where(F.col(least).isNotNull()).select(*keys, F.struct(F.lit(i).alias("level"), *values).alias(f"_l{i}"))
        out = out.join(found, keys, "left") if keys else out.join(found, F.lit(True), "left")
    pick = F.coalesce(*(F.col(f"_l{i}") for i in range(len(levels))))
    return out.withColumn("_pick", pick).select(*rows.columns, *(F.col(f"_pick.{v}").alias(v) for v in ("level", *values)))
