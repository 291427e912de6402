from __future__ import annotations

import numpy as np

from visbag.operators import projection, wide


def features(spark, x, labels=None):
    rows = [(i, int(labels[i]) if labels is not None else 0, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "feature_id bigint, label int, descriptor array<float>").repartition(5)


def signed(v):
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]


def exact(x, n):
    values, vectors = np.linalg.eigh(np.cov(x.astype(np.float64), rowvar=False, bias=True))
    return signed(vectors[:, ::-1].T[:n]), values[::-1][:n]


def test_directions_of_wide_vectors(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((200, 12)) * 0.7 ** np.arange(12)) @ rng.standard_normal((12, 1500)) + 0.01 * rng.standard_normal((200, 1500)) + 3
    x = x.astype(np.float32)
    rows, variances = wide.pca(features(spark, x), "descriptor", 4)
    want, values = exact(x, 4)
    assert rows.shape == (4, 1500) and np.allclose(variances, values, rtol=1e-6) and np.abs(rows - want).max() < 1e-5


def test_few_rows_few_dimensions_and_none(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((90, 6)).astype(np.float32)
    rows, variances = wide.pca(features(spark, x), "descriptor", 6)  # the rank is the dimension: exact
    want, values = exact(x, 6)
    assert np.allclose(rows, want, atol=1e-6) and np.allclose(variances, values)
    rows, variances = wide.pca(features(spark, x[:3]), "descriptor", 4)  # three rows span two directions
    assert np.allclose(variances[:2], exact(x[:3], 2)[1], rtol=1e-6) and np.abs(variances[2:]).max() < 1e-9
    rows, variances = wide.pca(features(spark, np.repeat(x[:1], 20, 0)), "descriptor", 2)
    assert np.isfinite(rows).all() and np.abs(variances).max() < 1e-9
    empty, none = wide.pca(features(spark, x).limit(0), "descriptor", 2)
    assert len(empty) == len(none) == 0
    with_null = features(spark, x).unionByName(spark.createDataFrame([(99, 0, None)], "feature_id bigint, label int, descriptor array<float>"))
    assert np.allclose(wide.pca(with_null, "descriptor", 2)[0], want[:2], atol=1e-6)


def test_discriminative_directions_inside_principal_ones(spark):
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 2, 300)
    base = rng.standard_normal((300, 8)) * np.array([5, 4, 3, 2, 2, 1, 1, 1])
    base[:, 2] += 12 * labels  # what tells the labels apart
    mix = np.linalg.qr(rng.standard_normal((400, 8)))[0].T
    rows, _ = wide.ldp(features(spark, base @ mix, labels), "descriptor", "label", 1, 8, pair_count=2000)

    def told(direction):  # distance of the class means over the spread inside a class
        v = base @ mix @ direction
        return abs(v[labels == 1].mean() - v[labels == 0].mean()) / np.sqrt(np.mean([v[labels == c].var() for c in (0, 1)]))

    assert told(rows[0]) > 0.98 * told(mix[2])  # no worse than the direction that the labels were written along
    narrow, _ = projection.ldp(features(spark, base, labels), "descriptor", "label", 1, pair_count=2000)
    assert abs(rows[0] @ (narrow[0] @ mix)) > 0.99
