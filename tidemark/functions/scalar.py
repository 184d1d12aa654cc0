"""Null-safe arithmetic on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive(x: Column) -> Column:
    """x where it is above zero, else null: the denominators of ratios."""
    return F.when(x > 0, x)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null unless b is above zero."""
    return a / positive(b)


def truth(x: Column) -> Column:
    """A condition in which null counts as false."""
    return F.coalesce(x, F.lit(False))


def sign_of(x: Column) -> Column:
    return F.signum(x).cast("int")


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def exactly_one(a: Column, b: Column) -> Column:
    return (a & ~b) | (~a & b)
