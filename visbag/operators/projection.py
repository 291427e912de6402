"""Linear projections: principal components, and local discriminative projection from pair differences.

Second moments are summed in Spark; the dim x dim eigenproblem is solved on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from . import statistics
from .places import numbered

PAIRS = 15_000


def applied(features: DataFrame, weights: np.ndarray, column: str = "descriptor") -> DataFrame:
    """``features`` with ``column`` projected (float), not centred; one matrix product a batch."""
    w = np.asarray(weights, np.float64)
    names = features.columns

    def run(batches):
        for batch in batches:
            c = batch.column(column)
            ok = c.drop_null()
            x = ok.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), -1) @ w.T if len(ok) else np.zeros((0, len(w)))
            rows, out = iter(x.astype(np.float32)), []
            for valid in c.is_valid().to_pylist():
                out.append(next(rows).tolist() if valid else None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float32())) if n == column else batch.column(n) for n in names], names)

    return features.mapInArrow(run, features.withColumn(column, F.col(column).cast("array<float>")).schema)


def pca(features: DataFrame, column: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` principal directions (rows) and their variances; from all rows rather than a sample."""
    _, cov, _ = statistics.covariance(features, column)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:n]
    return vectors[:, order].T, values[order]


def neighbour_pairs(features: DataFrame, column: str, label: str, same: bool, key: str = "feature_id", seed: int = 1) -> DataFrame:
    """Pairs (columns l, a, b) of each row and the three after it in a seeded order of its class, or, for two classes, of
    256 parts of all rows that are kept where the labels differ. Rows meet by their numbers, so no task holds a class."""
    from .kmeans import drawn_hash

    rows = features.where(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(column).alias("v"))
    rows = rows.withColumn("group", F.col("l") if same else F.substring(drawn_hash("k", seed + 1), 1, 2)).withColumn("draw", drawn_hash("k", seed + 2))
    placed = numbered(rows, "group", "draw", "k")
    ahead = placed.select("group", F.explode(F.array(*(F.col("nth") + d for d in (1, 2, 3)))).alias("nth"), "l", F.col("v").alias("a"))
    met = ahead.join(placed.select("group", "nth", F.col("l").alias("o"), F.col("v").alias("b")), ["group", "nth"])
    return met.where(F.col("l") == F.col("o") if same else F.col("l") != F.col("o")).select("l", "a", "b")


def random_pairs(features: DataFrame, column: str, label: str, n: int, same: bool, key: str = "feature_id", seed: int = 1) -> DataFrame:
    """``n`` random pairs (columns pair, a, b): the first of a pair is any row (for ``same``, any of a class of two or
    more), the second any other row of its class, or any row of the other classes.

    Rows are numbered class by class, so a class is a range of numbers and the second one's number is arithmetic on the
    first one's: two joins on numbers, and a class with most of the rows makes no large task. Repeats occur. None if there
    is no such pair; null labels are left out.
    """
    from .kmeans import drawn_hash

    rows = features.where(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(column).alias("v")).withColumn("draw", drawn_hash("k", seed + 2))
    if same:
        rows = rows.join(rows.groupBy("l").agg(F.count("*").alias("many")).where("many > 1").select("l"), "l", "left_semi")
    placed = written(numbered(rows, "l", "draw", "k").select("v", "nth", "size", "start", (F.col("start") + F.col("nth")).alias("place")))
    total = placed.count()
    drawn = lambda of: F.conv(F.substring(drawn_hash("pair", seed + of), 1, 15), 16, 10).cast("bigint")
    draws = features.sparkSession.range(n if total else 0).withColumnRenamed("id", "pair").select("pair", (drawn(3) % max(1, total)).alias("place"), drawn(4).alias("r"))
    first = draws.join(placed, "place").select("pair", F.col("v").alias("a"), "nth", "size", "start", "r")
    if same:
        second = F.col("start") + (F.col("nth") + 1 + F.col("r") % (F.col("size") - 1)) % F.col("size")
    else:
        first = first.where(F.col("size") < total)
        second = (F.col("start") + F.col("size") + F.col("r") % (total - F.col("size"))) % total
    return first.select("pair", "a", second.alias("place")).join(placed.select("place", F.col("v").alias("b")), "place").select("pair", "a", "b")


def ldp(features: DataFrame, column: str, label: str, n: int, key: str = "feature_id", seed: int = 1, unit: bool = False, pair_count: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` leading directions (rows) that maximise between-class over within-class pair differences.

    A symmetric generalised eigenproblem, by Cholesky whitening; without same-class pairs the within-class moments
    are the identity. ``unit``: differences of length 1.
    """

    def moments(same: bool):
        d = F.zip_with("a", "b", lambda x, y: (x - y).cast("double"))
        rows = random_pairs(features, column, label, pair_count, same, key, seed).select(d.alias("d"))
        if unit:
            norm = F.sqrt(F.aggregate("d", F.lit(0.0), lambda s, x: s + x * x))
            rows = rows.withColumn("n", norm).where("n > 0").select(F.expr("transform(d, x -> x / n)").alias("d"))
        mean, cov, count = statistics.covariance(rows, "d")
        return cov + np.outer(mean, mean) if count else None

    between, within = moments(False), moments(True)
    if between is None:
        raise ValueError("pairs of two classes are needed")
    within = np.eye(len(between)) if within is None else within
    within = within + 1e-9 * max(1e-30, np.trace(within) / len(within)) * np.eye(len(within))
    white = np.linalg.inv(np.linalg.cholesky(within))
    values, vectors = np.linalg.eigh(white @ between @ white.T)
    order = np.argsort(-values)[:n]
    rows = (white.T @ vectors[:, order]).T
    return rows / np.linalg.norm(rows, axis=1, keepdims=True), values[order]
