"""Bags of words: soft weights of assigned words, histograms of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def soft_weight(distance: Column, sigma: Column) -> Column:
    """exp(-d*d / (2 sigma^2)); the distance is squared already."""
    return F.exp(-distance * distance / F.greatest(F.lit(1e-30), 2 * sigma * sigma))


def soft_assigned(assigned: DataFrame, sigma: DataFrame) -> DataFrame:
    """``assigned`` (with words, distances) with ``weights``, of sum 1 a feature; ``sigma``: one row, one number."""
    out = assigned.join(F.broadcast(sigma.toDF("_sigma")))
    out = out.withColumn("_w", F.transform("distances", lambda d: soft_weight(d, F.col("_sigma"))))
    total = F.greatest(F.aggregate("_w", F.lit(0.0), lambda s, x: s + x), F.lit(1e-30))
    return out.withColumn("weights", F.transform("_w", lambda w: w / total)).select(*assigned.columns, "weights")


def long_form(assigned: DataFrame) -> DataFrame:
    """A row for each neighbour: rank and word (both 1-based), weight."""
    keep = [c for c in assigned.columns if c not in ("words", "distances", "weights")]
    return assigned.select(*keep, F.posexplode(F.arrays_zip("words", "weights")).alias("at", "pair")).select(*keep, (F.col("at") + 1).alias("rank"), (F.col("pair.words") + 1).alias("word"), F.col("pair.weights").alias("weight"))


def histogram(words: DataFrame, codebook_size: int | None = None) -> DataFrame:
    """image_id, word (1-based), value: weights summed over an image's features; words out of range are left out."""
    if codebook_size is not None:
        words = words.where(F.col("word").between(1, codebook_size))
    return words.groupBy("image_id", "word").agg(F.sum("weight").alias("value"))
