"""Statistics of vectors by dimension and by class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(vectors: DataFrame, values: str, *keep: str) -> DataFrame:
    """``keep``, dim (0-based), val."""
    return vectors.select(*keep, F.posexplode(values).alias("dim", "val"))


def dimension_stats(vectors: DataFrame, values: str) -> DataFrame:
    """dim, mean, deviation (population)."""
    return exploded(vectors, values).groupBy("dim").agg(F.avg(F.col("val").cast("double")).alias("mean"), F.stddev_pop(F.col("val").cast("double")).alias("deviation"))


def class_counts(vectors: DataFrame, label: str) -> DataFrame:
    return vectors.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def projected(values: Column, weights: list[list[float]]) -> Column:
    """Each row of ``weights`` times the vector, in double; the vector is not centred."""
    rows = F.array(*(F.array(*(F.lit(float(w)) for w in row)) for row in weights))
    return F.transform(rows, lambda row: F.aggregate(F.zip_with(row, values, lambda w, x: w * x.cast("double")), F.lit(0.0), lambda s, v: s + v))


def projected_class_deviation(values: DataFrame) -> DataFrame:
    """Of (label, p): one row, the mean over classes of the projected deviation, variances floored at 1e-10."""
    by_class = values.groupBy("label").agg(F.sqrt(F.greatest(F.var_pop("p"), F.lit(1e-10))).alias("d"))
    return by_class.agg(F.avg("d").alias("class_deviation"))


def projected_stats(values: DataFrame) -> DataFrame:
    """Of (component, p): component, deviation, mean_abs, mean."""
    return values.groupBy("component").agg(F.stddev_pop("p").alias("deviation"), F.avg(F.abs("p")).alias("mean_abs"), F.avg("p").alias("mean"))


def moments(vectors: DataFrame, values: str) -> DataFrame:
    """i, j, s (sum of x_i x_j), and row -1: sums, entry (-1, -1): the count. One partial matrix a task."""

    def run(batches):
        total = None
        for batch in batches:
            column = batch.column(0).drop_null()
            if len(column):
                x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
                x = np.column_stack([np.ones(len(x)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.reshape(-1) - 1, pa.int32()), pa.array(j.reshape(-1) - 1, pa.int32()), pa.array(total.reshape(-1))], ["i", "j", "s"])

    return vectors.select(values).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def second_moments(vectors: DataFrame, values: str) -> DataFrame:
    """i, j, m: the mean of x_i x_j, not centred."""
    all_ = moments(vectors, values)
    n = all_.where("i = -1 and j = -1").select(F.col("s").alias("n"))
    return all_.where("i >= 0 and j >= 0").join(F.broadcast(n)).select("i", "j", (F.col("s") / F.col("n")).alias("m"))


def centred(vectors: DataFrame, values: str) -> DataFrame:
    """i, j, c: the population covariance."""
    all_ = moments(vectors, values)
    sums = all_.where("i = -1").select(F.col("j").alias("k"), F.col("s").alias("total"))  # dim + 1 rows
    n = sums.where("k = -1").select(F.col("total").alias("n"))
    rows = all_.where("i >= 0 and j >= 0").join(F.broadcast(n))
    for side in ("i", "j"):
        rows = rows.join(F.broadcast(sums.select(F.col("k").alias(side), F.col("total").alias(f"s{side}"))), side)
    return rows.select("i", "j", (F.col("s") / F.col("n") - F.col("si") / F.col("n") * F.col("sj") / F.col("n")).alias("c"))


def label_subset(rows: DataFrame, label: str, classes: int, seed: int = 1) -> DataFrame:
    """``rows`` of ``classes`` drawn labels; of all if ``classes`` is below 2 or not fewer than there are."""
    if classes < 2:
        return rows
    from .kmeans import drawn_hash

    drawn = rows.select(label).where(F.col(label).isNotNull()).distinct().orderBy(drawn_hash(label, seed), label).limit(classes)
    return rows.join(drawn, label, "left_semi").select(*rows.columns)


def covariance(vectors: DataFrame, values: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, population covariance and count: dim x dim numbers reach the driver."""
    rows = moments(vectors, values).collect()
    size = max((r.i for r in rows), default=-1) + 2
    s = np.zeros((size, size))
    for r in rows:
        s[r.i + 1, r.j + 1] = r.s
    n = s[0, 0] if size > 1 else 0
    if not n:
        return np.zeros(0), np.zeros((0, 0)), 0
    mean = s[0, 1:] / n
    return mean, s[1:, 1:] / n - np.outer(mean, mean), int(n)
