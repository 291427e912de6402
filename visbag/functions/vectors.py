"""Vectors as array<float> columns, or as structs (dimension, ids, data), ids null for dense ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VECTOR_TYPE = "struct<dimension:int,ids:array<int>,data:array<float>>"


def zeros(dimension: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dimension)


def vector(values: Column) -> Column:
    """A dense vector of an array."""
    return F.struct(F.size(values).alias("dimension"), F.lit(None).cast("array<int>").alias("ids"), values.alias("data")).cast(VECTOR_TYPE)


def sparse(values: Column) -> Column:
    """Without exact zeros; NaN stays."""
    kept = F.filter(F.transform(values, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s.x != 0)
    return F.struct(F.size(values).alias("dimension"), F.transform(kept, lambda s: s.i).alias("ids"), F.transform(kept, lambda s: s.x).alias("data")).cast(VECTOR_TYPE)


def dense(v: Column) -> Column:
    """The array of a vector, dense or sparse."""
    at = F.map_from_arrays(v.ids, v.data)
    places = F.when(v.dimension > 0, F.sequence(F.lit(0), v.dimension - 1)).otherwise(F.array().cast("array<int>"))
    filled = F.transform(places, lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0).cast("float")))
    return F.when(v.ids.isNull(), v.data).otherwise(filled)


def is_u8(values: Column) -> Column:
    """Whether every value is integral within 0 .. 255, so that a byte holds it."""
    return F.forall(values, lambda x: (x >= 0) & (x <= 255) & (x == F.floor(x)))


def encoding(v: Column) -> Column:
    """is_u8, dense_bytes, sparse_bytes and is_sparse of the smaller encoding of a vector; a sparse vector has an
    end marker among its ids, a dense one that would become sparse has not yet."""
    values = dense(v)
    width = F.when(is_u8(values), 1).otherwise(4)
    stored = F.size(F.filter(values, lambda x: x != 0)) + F.when(v.ids.isNull(), 0).otherwise(1)
    dense_bytes, sparse_bytes = v.dimension * width, stored * (width + 4)
    return F.struct(is_u8(values).alias("is_u8"), dense_bytes.alias("dense_bytes"), sparse_bytes.alias("sparse_bytes"), (dense_bytes > sparse_bytes).alias("is_sparse"))


def optimised(v: Column) -> Column:
    return F.when(encoding(v).is_sparse, sparse(dense(v))).otherwise(vector(dense(v)))


def concatenated(a: Column, b: Column) -> Column:
    """Ids of the second move behind the first; dense if either is."""
    both = F.struct((a.dimension + b.dimension).alias("dimension"), F.concat(a.ids, F.transform(b.ids, lambda i: i + a.dimension)).alias("ids"), F.concat(a.data, b.data).alias("data")).cast(VECTOR_TYPE)
    return F.when(a.ids.isNotNull() & b.ids.isNotNull(), both).otherwise(vector(F.concat(dense(a), dense(b))))


def without(values: Column, dims: list[int]) -> Column:
    """Without the given dimensions; an error if the largest is beyond the vector."""
    if not dims:
        return values
    kept = F.filter(values, lambda x, i: ~i.isin(*dims))
    return F.when(F.size(values) > max(dims), kept).otherwise(F.raise_error(F.lit("dimension out of range")).cast("array<float>"))


def scaled(values: Column, scales: list[tuple[int, float]]) -> Column:
    """Dimensions times their factors; repeated ones multiply, ones out of range are ignored."""
    factor: dict[int, float] = {}
    for dim, by in scales:
        factor[dim] = factor.get(dim, 1.0) * by
    if not factor:
        return values
    at = F.create_map(*(F.lit(x) for pair in factor.items() for x in pair))
    return F.transform(values, lambda x, i: (x * F.coalesce(F.try_element_at(at, i), F.lit(1.0))).cast("float"))


def _ratio(x: Column, by: Column) -> Column:
    """x / by in double; what IEEE gives for a zero divisor."""
    return F.when(by != 0, x / F.when(by != 0, by)).when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))


def _total(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + term(x.cast("double")))


def normalised_l1(values: Column, length: float = 1.0) -> Column:
    """Absolute values sum to ``length``; a zero vector becomes NaN."""
    return _divided(values, _total(values, F.abs), length)


def normalised_l2(values: Column, length: float = 1.0) -> Column:
    return _divided(values, F.sqrt(_total(values, lambda x: x * x)), length)


def _divided(values: Column, by: Column, length: float) -> Column:
    return F.transform(F.transform(F.array(by), lambda n: F.transform(values, lambda x: _ratio(x.cast("double") * length, n).cast("float"))), lambda v: v)[0]


def standardised(values: Column, deviation: float = 1.0, n: Column | None = None) -> Column:
    """(x - mean) * deviation / population deviation over the stored entries (of a sparse vector, its data)."""
    n = F.size(values) if n is None else n
    moments = F.struct((_total(values, lambda x: x) / F.nullif(n, F.lit(0))).alias("m"), (_total(values, lambda x: x * x) / F.nullif(n, F.lit(0))).alias("q"))
    out = F.transform(F.array(moments), lambda s: F.transform(values, lambda x: _ratio((x.cast("double") - s.m) * deviation, F.sqrt(F.greatest(F.lit(0.0), s.q - s.m * s.m))).cast("float")))
    return out[0]


NORMS = {"": lambda v: v, "NONE": lambda v: v, "L1": normalised_l1, "L2": normalised_l2, "STDDEV": standardised}


def normalised(values: Column, kind: str) -> Column:
    """By name; null vectors stay null, unknown names are an error."""
    if kind not in NORMS:
        raise ValueError(f"unknown normalisation {kind!r}; one of {sorted(NORMS)}")
    return NORMS[kind](values)


def repaired(values: Column, by: float = 0.9) -> Column:
    """NaN entries become ``by``; a null vector is an error, as the file format has no repair for it."""
    fixed = F.transform(values, lambda x: F.nanvl(x, F.lit(by).cast("float")))
    return F.when(values.isNotNull(), fixed).otherwise(F.raise_error(F.lit("null vector")).cast("array<float>"))
