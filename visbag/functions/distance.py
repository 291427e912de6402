"""Distances and similarities of array columns, as Catalyst expressions.

``*_raw`` forms sum in double; the others, for whole vectors, sum in float and give 1e-30 where the result is 0.
``visbag.functions.sparse`` has those of sparse vectors. Null vectors give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-30
#: sums a term over the entries of two vectors, in a type
Over = Callable[[Column, Column, Callable[[Column, Column], Column], str], Column]


def _sum(values: Column, kind: str) -> Column:
    return F.aggregate(values, F.lit(0.0).cast(kind), lambda s, v: s + v)


def _over(a: Column, b: Column, term: Callable[[Column, Column], Column], kind: str) -> Column:
    return _sum(F.zip_with(a, b, term), kind)


def _some(value: Column) -> Column:
    return F.when(value == 0, F.lit(TINY).cast("float")).otherwise(value.cast("float"))


def _per_sum(x: Column, y: Column, top: Column) -> Column:
    return F.when(x + y == 0, F.lit(0.0).cast("float")).otherwise((top / F.when(x + y != 0, x + y)).cast("float"))


def bounded(value: Column, most: float) -> Column:
    """What early abandoning reports: ``most`` + 1 beyond ``most``."""
    return F.when(value > most, F.lit(most + 1.0)).otherwise(value)


def l2sq(a: Column, b: Column, over: Over = _over) -> Column:
    """Squared Euclidean distance: float differences and products, double sum."""
    return over(a, b, lambda x, y: (x - y) * (x - y), "double")


def l1_raw(a: Column, b: Column, over: Over = _over) -> Column:
    return over(a, b, lambda x, y: F.abs(x - y), "double")


def lr_raw(a: Column, b: Column, power: float) -> Column:
    """Sum of absolute differences to a power, no root."""
    return _over(a, b, lambda x, y: F.pow(F.abs(x - y).cast("double"), F.lit(float(power))), "double")


def x2_raw(a: Column, b: Column) -> Column:
    """Chi-square without a guard: 0/0 is NaN, other divisions by zero are infinite."""

    def term(x, y):
        d, s = ((x - y) * (x - y)).cast("double"), (x + y).cast("double")
        return F.when(s != 0, d / F.when(s != 0, s)).when(d == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))

    return _over(a, b, term, "double")


def x2(a: Column, b: Column, over: Over = _over) -> Column:
    """Chi-square; entries whose sum is 0 count nothing."""
    return _some(over(a, b, lambda x, y: _per_sum(x, y, (x - y) * (x - y)), "float"))


def l1(a: Column, b: Column, over: Over = _over) -> Column:
    return _some(over(a, b, lambda x, y: F.abs(x - y), "float"))


def l2(a: Column, b: Column, over: Over = _over) -> Column:
    return _some(F.sqrt(over(a, b, lambda x, y: (x - y) * (x - y), "float")))


def ln(a: Column, b: Column, power: int, over: Over = _over) -> Column:
    """Even powers only; 0 for odd ones."""
    if power % 2:
        return F.lit(0.0).cast("float")
    return _some(F.pow(over(a, b, lambda x, y: F.pow((x - y).cast("double"), F.lit(float(power))).cast("float"), "float").cast("double"), F.lit(1.0 / power)))


def dot(a: Column, b: Column, over: Over = _over) -> Column:
    return over(a, b, lambda x, y: x * y, "float")


def intersection(a: Column, b: Column, over: Over = _over) -> Column:
    """Histogram intersection, each bin over its sum; empty bins count nothing."""
    return _some(over(a, b, lambda x, y: _per_sum(x, y, F.least(x, y)), "float"))


KERNELS = {"X2": x2, "LINEAR": dot, "L1": l1, "L2": l2}
