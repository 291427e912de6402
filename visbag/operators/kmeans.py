"""K-means and codebook training on feature rows (a key and an array<float>), as loops of Spark jobs.

The codebook (words x dim numbers) is on the driver between steps; features never are. Randomness is seeded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import new_folder, written
from . import bounds, projection
from .codebook import blocks, nearest_word


def drawn_hash(key: str, seed: int) -> Column:
    """Sixteen hexadecimal digits that depend on seed and key alone."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 16)


def seeded_sample(rows: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """``n`` rows without replacement, the same whenever the keys are."""
    return rows.orderBy(drawn_hash(key, seed), key).limit(n)


def numbered(rows: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """``rows`` with ``number``, 0 .. n - 1, by the first digits of the key's hash, then the key: counts of the 16**digits
    buckets give each bucket its first number, and each is numbered by itself."""
    dealt = rows.withColumn("_bucket", F.substring(drawn_hash(key, 0), 1, digits))
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).select("_bucket", "_start")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return dealt.join(F.broadcast(starts), "_bucket").withColumn("number", F.col("_start") + place - 1).drop("_bucket", "_start")


def sample_with_replacement(rows: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """``draw`` (0 .. n - 1) and the row that it takes: the draw's hash names a number of the rows'."""
    spark, total = rows.sparkSession, rows.count()
    draws = spark.range(n if total else 0).withColumnRenamed("id", "draw")
    number = F.conv(F.substring(drawn_hash("draw", seed), 1, 12), 16, 10).cast("bigint") % F.lit(max(1, total))
    return draws.select("draw", number.alias("number")).join(numbered(rows, key), "number").drop("number")


def initial_words(features: DataFrame, words: int, key: str = "feature_id", seed: int = 1, first: bool = False) -> DataFrame:
    """word, center of ``words`` distinct features: drawn, or the first by key."""
    rows = features.orderBy(key).limit(words) if first else seeded_sample(features, words, key, seed)
    spark = features.sparkSession
    found = [(i, list(r.descriptor)) for i, r in enumerate(rows.select("descriptor").collect())]
    return spark.createDataFrame(found, "word int, center array<float>")


def means(assigned: DataFrame) -> DataFrame:
    """word, n, center of assigned features: a count and a sum a task and word, added up by word."""

    def partial(batches):
        total: dict[int, list] = {}
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column("word")), pc.is_valid(batch.column("descriptor"))))
            if len(batch):
                x = batch.column("descriptor").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
                used, at, n = np.unique(batch.column("word").to_numpy(), return_inverse=True, return_counts=True)
                sums = np.zeros((len(used), x.shape[1]))
                np.add.at(sums, at, x)
                for w, k, s in zip(used.tolist(), n.tolist(), sums):
                    entry = total.setdefault(w, [0, 0.0])
                    entry[0] += k
                    entry[1] = entry[1] + s
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1].tolist() for v in total.values()], pa.list_(pa.float64()))], ["word", "n", "s"])

    def added(table: pa.Table) -> pa.Table:
        n = int(pc.sum(table.column("n")).as_py())
        center = np.array(table.column("s").to_pylist()).sum(0) / n
        return pa.table([table.column("word")[:1], pa.array([n]), pa.array([center.astype(np.float32).tolist()], pa.list_(pa.float32()))], ["word", "n", "center"])

    parts = assigned.select(F.col("word").cast("int").alias("word"), F.col("descriptor").cast("array<float>").alias("descriptor")).mapInArrow(partial, "word int, n bigint, s array<double>")
    return parts.groupBy("word").applyInArrow(added, "word int, n bigint, center array<float>")


def step(features: DataFrame, codebook: DataFrame) -> DataFrame:
    """One Lloyd step: word, n, center of the words that keep features."""
    return means(nearest_word(features, codebook))


def lost(codebook: DataFrame, stepped: DataFrame) -> DataFrame:
    """Words without features."""
    return codebook.select("word").join(stepped, "word", "left_anti")


def changed(before: DataFrame, after: DataFrame, key: str = "feature_id") -> DataFrame:
    """One row: the share of features whose word changed."""
    pairs = before.select(key, F.col("word").alias("a")).join(after.select(key, F.col("word").alias("b")), key)
    return pairs.agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("changed"))


def _local(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "word int, center array<float>")


def trained(features: DataFrame, words: int, iterations: int, key: str = "feature_id", seed: int = 1, start: DataFrame | None = None, bounded: bool = False, work: list | None = None) -> DataFrame:
    """word, center after exactly ``iterations`` steps; lost words are seeded again from drawn features.

    ``bounded``: rows keep distance bounds from step to step (see ``bounds``), in a table that each step writes, and
    distances that cannot matter are skipped; the codebook is held whole by each task. The words are the same either
    way. It pays for long trainings with many words, whose later steps skip most distances; a step costs a table of the
    features. To ``work`` each bounded step adds (distances computed, rows times words)."""
    spark, book = features.sparkSession, start if start is not None else initial_words(features, words, key, seed)
    rows, before, folders = features.select(key, "descriptor"), None, [new_folder(spark) for _ in range(2)]
    for i in range(iterations):
        ids = [r.word for r in book.select("word").collect()]
        if bounded and ids:
            at, centers = (np.concatenate(x) for x in zip(*blocks(book)))
            rows = written(bounds.assigned(rows, bounds.Step(at, centers, before)), folders[i % 2])  # in place of the last but one
            before, stepped = centers.astype(np.float64), means(rows)
            if work is not None:
                n = rows.where("word is not null").agg(F.sum("compared"), F.count("*")).first()
                work.append((n[0] or 0, n[1] * len(at)))
        else:
            stepped = step(features, book)
        found = {r.word: list(r.center) for r in stepped.select("word", "center").collect()}
        gone = [w for w in ids if w not in found]
        if gone:
            drawn = seeded_sample(features, len(gone), key, seed + i + 1).select("descriptor").collect()
            found |= {w: list(r.descriptor) for w, r in zip(gone, drawn)}
        book = _local(spark, sorted(found.items()))
    return book


def fast(features: DataFrame, words: int, iterations: int, seed: int = 1) -> DataFrame:
    """The same by the library's k-means: random start, no new seeds for lost words."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=words, initMode="random", maxIter=iterations, tol=0.0, seed=seed).fit(features.select(array_to_vector(F.col("descriptor")).alias("features")))
    return _local(features.sparkSession, [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())])


def supervised(features: DataFrame, target: int, words: int, iterations: int, method: str = "LDP", key: str = "feature_id", seed: int = 1):
    """(projection rows, codebook): a projection learned from labels (PCA or LDP), then k-means in its space."""
    if method == "PCA":
        weights, _ = projection.pca(features, "descriptor", target)
    else:
        weights, _ = projection.ldp(features, "descriptor", "label", target, key=key, seed=seed)
    return weights, trained(projection.applied(features, weights), words, iterations, key, seed)


def joint(features: DataFrame, target: int, words: int, iterations: int, key: str = "feature_id", seed: int = 1):
    """(projection rows, codebook): assign, learn a discriminative projection of the clusters, project, take means."""
    book = initial_words(features, words, key, seed)  # random clusters to begin with
    labels = nearest_word(features, book).select(key, F.col("word").alias("label"))
    weights = None
    for i in range(max(1, iterations)):
        labelled = features.drop("label").join(labels, key)
        weights, _ = projection.ldp(labelled, "descriptor", "label", target, key=key, seed=seed + i)
        shown = projection.applied(features, weights)
        centers = means(shown.join(labels.withColumnRenamed("label", "word"), key)).select("word", "center")
        book = _local(features.sparkSession, sorted((r.word, list(r.center)) for r in centers.collect()))
        labels = nearest_word(shown, book).select(key, F.col("word").alias("label"))
    return weights, book
