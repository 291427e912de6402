from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from visbag.operators import bounds, kmeans
from visbag.operators.codebook import nearest_word


def clustered(n=3000, clusters=40, dims=8, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((clusters, dims)) * 4
    return (centers[rng.integers(0, clusters, n)] + 0.3 * rng.standard_normal((n, dims))).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "feature_id bigint, descriptor array<float>").repartition(4)


def test_bounds_keep_the_words_of_full_comparison():
    """Step after step, in numpy alone: the words are those of all distances, and bounds hold."""
    x = clustered()
    x[100:200] = x[0]  # equal rows
    rng = np.random.default_rng(1)
    centers = x[rng.choice(len(x), 40, replace=False)].copy()
    centers[7] = centers[3]  # equal words: the smaller one is taken
    ids, at, upper, lower, before, shares = np.arange(0, 80, 2), None, np.zeros(0), np.zeros(0), None, []
    for _ in range(8):
        step = bounds.Step(ids, centers, before)
        at, upper, lower, compared = step.assigned(x, at, upper, lower)
        d = np.sqrt(bounds.squared(x, centers))
        assert np.array_equal(at, d.argmin(1))
        k = np.arange(len(x))
        assert (upper >= d[k, at] * (1 - 1e-6)).all()
        d[k, at] = np.inf
        assert (lower <= d.min(1) * (1 + 1e-6) + 1e-9).all()
        shares.append(compared / d.size)
        before = centers.astype(np.float64)
        centers = np.array([x[at == w].mean(0) if (at == w).any() else x[w] for w in range(40)], np.float32)
    assert shares[0] == 1 and shares[-1] < 0.2


def test_training_is_the_same(spark):
    rows = frame(spark, clustered()).unionByName(spark.createDataFrame([(9999, None)], "feature_id bigint, descriptor array<float>"))
    start = kmeans.initial_words(rows.where("descriptor is not null"), 30)
    far = spark.createDataFrame([(99, [50.0] * 8)], "word int, center array<float>")  # loses all rows, is seeded again
    work: list = []
    bounded = kmeans.trained(rows, 31, 5, start=start.unionByName(far), bounded=True, work=work).orderBy("word").collect()
    plain = kmeans.trained(rows, 31, 5, start=start.unionByName(far), bounded=False).orderBy("word").collect()
    assert [r.word for r in bounded] == [r.word for r in plain]
    assert np.allclose([r.center for r in bounded], [r.center for r in plain], atol=1e-5)
    assert len(work) == 5 and all(p == 3000 * 31 for _, p in work) and work[0][0] == work[0][1] and work[-1][0] < 0.5 * work[-1][1]


def test_one_word_and_no_rows(spark):
    rows = frame(spark, clustered(50))
    book = kmeans.trained(rows, 1, 2, bounded=True).collect()
    assert len(book) == 1 and np.allclose(book[0].center, clustered(50).mean(0), atol=1e-4)
    assert kmeans.trained(rows.limit(0), 3, 2, bounded=True).count() == 0
    ids, centers = np.array([4, 9]), clustered(2)
    got = bounds.assigned(rows.withColumn("extra", F.lit("x")), bounds.Step(ids, centers, None))
    want = nearest_word(rows, spark.createDataFrame([(int(i), c.tolist()) for i, c in zip(ids, centers)], "word int, center array<float>"))
    assert {r.feature_id: r.word for r in got.collect()} == {r.feature_id: r.word for r in want.collect()} and "extra" in got.columns
