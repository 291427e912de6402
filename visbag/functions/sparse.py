"""Distances of sparse vectors (struct of dimension, ids, data) as one Catalyst expression each: a merge of the two sorted
id arrays, in as many steps as there are entries, whatever the dimension. Sums run in the order of the ids, in the type
that the dense form sums in, so both forms give the same number. Ids ascend strictly; null vectors give null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import distance as D


def merged(a: Column, b: Column, term: Callable[[Column, Column], Column], kind: str) -> Column:
    """The sum of ``term`` (0 for two zeros) over the ids of either vector; an entry that is missing is 0."""
    zero = F.lit(0.0).cast("float")

    def step(s: Column, _: Column) -> Column:
        x, y = F.get(a["ids"], s["i"]), F.get(b["ids"], s["j"])
        left, right = x.isNotNull() & (y.isNull() | (x <= y)), y.isNotNull() & (x.isNull() | (y <= x))
        value = term(F.when(left, F.get(a["data"], s["i"])).otherwise(zero), F.when(right, F.get(b["data"], s["j"])).otherwise(zero))
        return F.struct(
            (s["i"] + left.cast("int")).alias("i"), (s["j"] + right.cast("int")).alias("j"),
            F.when(left | right, (s["sum"] + value).cast(kind)).otherwise(s["sum"]).alias("sum"),
        )

    steps = F.size(a["ids"]) + F.size(b["ids"])
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).cast(kind).alias("sum"))
    whole = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, step, lambda s: s["sum"])
    return F.when(a.isNotNull() & b.isNotNull(), whole)


l2sq, l1_raw, l1, l2, x2, dot, intersection = (partial(f, over=merged) for f in (D.l2sq, D.l1_raw, D.l1, D.l2, D.x2, D.dot, D.intersection))


def ln(a: Column, b: Column, power: int) -> Column:
    return D.ln(a, b, power, over=merged)


KERNELS = {"X2": x2, "LINEAR": dot, "L1": l1, "L2": l2}
