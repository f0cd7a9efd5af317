"""IEEE-754 arithmetic and comparisons as Columns.

ANSI mode raises on a division by zero, and Spark orders NaN above all numbers and equal to itself; metric queries need
IEEE rules, so expressions over sample values go through these helpers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def nan() -> Column:
    return F.lit(NAN)


def div(a: Column, b: Column) -> Column:
    signed_inf = F.when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    # 1/-0.0 is -Inf; the sign of a zero shows in its text only
    by_zero = F.when(F.isnan(a) | (a == 0), nan()).otherwise(F.when(b.cast("string") == "-0.0", -signed_inf).otherwise(signed_inf))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def mod(a: Column, b: Column) -> Column:
    return F.when((b == 0) | F.isnan(b), nan()).otherwise(F.try_mod(a, b))


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def _real(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


COMPARE = {
    "==": lambda a, b: _real(a, b) & (a == b),
    "!=": lambda a, b: ~_real(a, b) | (a != b),
    ">": lambda a, b: _real(a, b) & (a > b),
    "<": lambda a, b: _real(a, b) & (a < b),
    ">=": lambda a, b: _real(a, b) & (a >= b),
    "<=": lambda a, b: _real(a, b) & (a <= b),
}
ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": div, "%": mod, "^": power, "atan2": F.atan2}


def number(a: Column) -> Column:
    """a where it is a number, else null: aggregates then skip NaN."""
    return F.when(~F.isnan(a), a)


def log(a: Column, f) -> Column:
    return F.when(F.isnan(a) | (a < 0), nan()).when(a == 0, F.lit(-INF)).otherwise(f(a))


def nan_if_null(a: Column) -> Column:
    return F.coalesce(a, nan())
