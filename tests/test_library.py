"""Edge cases of the operators, formats and streams."""

from __future__ import annotations

import math
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from visbag.functions import distance as D
from visbag.functions import sparse
from visbag.functions import vectors as V
from visbag.operators import bow, codebook, information, kdtree, kmeans, places, projection, search, statistics, trees
from visbag.operators.repair import repair_file
from visbag.plans import later
from visbag.schema import ENVELOPE, VECTOR_FILE
from visbag.sources import envelope, text_files, vector_file
from visbag.streaming import pipeline


def one(spark, *columns, **values):
    kinds = ", ".join(f"{k} array<float>" for k in values)
    return tuple(spark.createDataFrame([tuple(values.values())], kinds).select(*columns).first())


def test_distances_of_edge_cases(spark):
    a, b = F.col("a"), F.col("b")
    z = one(spark, D.l1(a, b), D.l2(a, b), D.ln(a, b, 3), D.x2(a, b), D.intersection(a, b), D.l2sq(a, b), D.x2_raw(a, b), a=[0.0, 0.0], b=[0.0, 0.0])
    assert all(math.isclose(x, 1e-30, rel_tol=1e-6) for x in (z[0], z[1], z[3], z[4])) and z[2] == 0 and z[5] == 0 and math.isnan(z[6])
    assert one(spark, D.l2(a, b), D.l2sq(a, b), D.bounded(D.l2sq(a, b), 3.0), a=[0.0, 0.0], b=[3.0, 4.0]) == (5.0, 25.0, 4.0)
    assert one(spark, D.l2sq(a, b), D.l1(a, b), a=None, b=[1.0]) == (None, None)
    sparse = V.dense(V.sparse(a))
    assert one(spark, D.l1(sparse, V.dense(V.sparse(b))) == D.l1(a, b), a=[0.0, 2.0, 0.0], b=[1.0, 2.0, 0.0]) == (True,)


def test_vectors(spark):
    a = F.col("a")
    n = one(spark, V.normalised_l1(a), V.normalised_l2(a), V.standardised(a), a=[0.0, 0.0])
    assert all(math.isnan(x) for v in n for x in v)
    assert one(spark, V.dense(V.sparse(a)), V.sparse(a).ids, a=[]) == ([], [])
    assert one(spark, V.repaired(a), a=[float("nan"), 1.0])[0] == pytest.approx([0.9, 1.0])
    assert one(spark, V.scaled(a, [(0, 2.0), (0, 3.0), (9, 5.0)]), V.without(a, [1]), a=[1.0, 2.0]) == ([6.0, 2.0], [1.0])
    assert one(spark, V.normalised(a, "L1"), a=None) == (None,)
    with pytest.raises(ValueError):
        V.normalised(a, "L7")
    with pytest.raises(Exception, match="out of range"):
        one(spark, V.without(a, [2]), a=[1.0, 2.0])
    with pytest.raises(Exception, match="null vector"):
        one(spark, V.repaired(a), a=None)
    e = one(spark, V.encoding(V.sparse(a)), V.optimised(V.vector(a)).ids, a=[0.0] * 20 + [7.0])
    assert e[0].is_u8 and e[0].dense_bytes == 21 and e[0].sparse_bytes == 10 and e[0].is_sparse and e[1] == [20]


def book_and_features(spark, n=200, words=7, dim=5, seed=2):
    rng = np.random.default_rng(seed)
    c, x = rng.standard_normal((words, dim)).astype(np.float32), rng.standard_normal((n, dim)).astype(np.float32)
    book = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "word int, center array<float>")
    feats = spark.createDataFrame([(i, i % 9, v.tolist(), int(v[0] > 0)) for i, v in enumerate(x)], "feature_id bigint, image_id bigint, descriptor array<float>, label int")
    return c, x, book, feats.repartition(3)


def test_nearest_in_blocks_and_by_expressions(spark):
    c, x, book, feats = book_and_features(spark)
    order = np.argsort(((x[:, None] - c[None]) ** 2).sum(2), axis=1, kind="stable")
    for block in (1 << 20, 45):
        got = {r.feature_id: r.words for r in codebook.nearest(feats, book, 3, block_bytes=block).collect()}
        assert all(got[i] == order[i, :3].tolist() for i in range(len(x)))
    slow = {(r.feature_id, r["rank"], r.word) for r in codebook.nearest_join(feats, book, 3).collect()}
    assert slow == {(i, k + 1, int(order[i, k])) for i in range(len(x)) for k in range(3)}
    ties = spark.createDataFrame([(5, [1.0]), (2, [1.0]), (3, [-1.0])], "word int, center array<float>")
    f = spark.createDataFrame([(1, [0.0]), (2, None)], "feature_id bigint, descriptor array<float>")
    assert {r.feature_id: r.word for r in codebook.nearest_word(f, ties).collect()} == {1: 2, 2: None}
    assert codebook.nearest(f, ties, 32).where("feature_id = 1").first().words == [2, 3, 5]
    lone = codebook.average_word_distance(ties.limit(1)).first()[0]
    assert lone is None and codebook.nearest(f, ties.limit(0), 3).first().words == []


def test_soft_weights_sum_to_one(spark):
    _, _, book, feats = book_and_features(spark)
    soft = bow.soft_assigned(codebook.nearest(feats, book, 4), codebook.average_word_distance(book))
    assert all(math.isclose(sum(r.weights), 1, rel_tol=1e-9) for r in soft.collect())
    total = bow.histogram(bow.long_form(soft)).agg(F.sum("value")).first()[0]
    assert math.isclose(total, 200, rel_tol=1e-9)
    assert bow.histogram(bow.long_form(soft), 3).where("word > 3").count() == 0


def test_kd_tree_without_a_limit_is_exact():
    rng = np.random.default_rng(5)
    for words, dim, k in ((1, 3, 4), (7, 2, 3), (500, 4, 10), (3000, 16, 5)):
        centers = np.round(rng.standard_normal((words, dim)), 1).astype(np.float32)  # ties and equal words
        x = np.round(rng.standard_normal((300, dim)), 1).astype(np.float32)
        names = rng.permutation(words).astype(np.int64)
        tree = kdtree.KdTree(names, centers)
        got_w, got_d, compared = tree.search(x, k)
        w, d = codebook._best(names, codebook.squared(x, centers), k)
        assert (got_w == w).all() and (got_d == d).all() and compared.max() <= words
    assert compared.mean() < words  # boxes spare comparisons
    assert kdtree.KdTree(np.arange(100), np.ones((100, 2), np.float32)).search(np.zeros((1, 2), np.float32), 100)[0].tolist() == [list(range(100))]


def test_kd_tree_recall_at_the_default_limit():
    """Descriptors lie in clusters, as those of images do; 200 of 20,000 words are compared."""
    rng = np.random.default_rng(6)
    middle = rng.standard_normal((400, 32)).astype(np.float32)
    draw = lambda n: (middle[rng.integers(0, 400, n)] + rng.standard_normal((n, 32)) * 0.25).astype(np.float32)
    centers, x = draw(20_000), draw(400)
    tree = kdtree.KdTree(np.arange(20_000), centers)
    w, _ = codebook._best(np.arange(20_000), codebook.squared(x, centers), 10)
    recall = {}
    for visits in (200, 2000):
        got, _, compared = tree.search(x, 10, visits)
        assert compared.max() < visits + kdtree.LEAF
        recall[visits] = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got.tolist(), w.tolist())])
    assert recall[200] > 0.7 and recall[2000] > 0.95, recall


def test_closest_equals_a_full_comparison():
    """Ties, equal words, more neighbours than words, numbers of any size, NaN and infinity."""
    rng = np.random.default_rng(9)
    for words, dim, k, size in ((1, 3, 4, 1), (9000, 2, 3, 1), (6000, 64, 5, 1e-3), (5000, 5, 7, 1e18), (5000, 5, 7, 1e-25), (300, 4, 300, 1)):
        centers, x = ((np.round(rng.standard_normal((n, dim)), 1) * size).astype(np.float32) for n in (words, 700))
        names = rng.permutation(words).astype(np.int64)
        x[:4] = centers[0]
        x[5], x[6], x[7, 0] = np.nan, np.inf, 3e19
        with np.errstate(all="ignore"):
            w, d = codebook.closest(names, centers, x, k)
            want_w, want_d = codebook._best(names, codebook.squared(x, centers), k)
        assert (w == want_w).all() and np.array_equal(d, want_d, equal_nan=True)
    centers[7, 1] = np.nan
    assert (codebook.closest(names, centers, x[:5], 3)[0] == codebook._best(names, codebook.squared(x[:5], centers), 3)[0]).all()


def test_nearest_takes_bounded_memory(spark, monkeypatch):
    """A batch of features and a block of words make no table of their distances."""
    searchers = []
    monkeypatch.setattr(codebook, "_passes", lambda features, book, k, descriptor, size, searcher: searchers.append(searcher) or features.withColumns({"words": F.lit(1), "distances": F.lit(1)}))
    codebook.nearest(spark.range(1), None, 5)
    rng = np.random.default_rng(3)
    x, centers = rng.standard_normal((4000, 8)).astype(np.float32), rng.standard_normal((10_000, 8)).astype(np.float32)
    tracemalloc.start()
    try:
        w, _ = searchers[0](np.arange(10_000), centers)(x, 5)
        assert w.shape == (4000, 5) and tracemalloc.get_traced_memory()[1] < 100e6  # all distances would be 320 MB
    finally:
        tracemalloc.stop()


def test_kd_tree_without_a_limit_is_no_slower_than_a_full_comparison():
    """Boxes rule nothing out in 64 dimensions."""
    rng = np.random.default_rng(10)
    x, centers = rng.standard_normal((300, 64)).astype(np.float32), rng.standard_normal((10_000, 64)).astype(np.float32)
    tree, took = kdtree.KdTree(np.arange(10_000), centers), [time.perf_counter()]
    w, _, _ = tree.search(x, 5)
    took.append(time.perf_counter())
    full, _ = codebook._best(np.arange(10_000), codebook.squared(x, centers), 5)
    took.append(time.perf_counter())
    assert (w == full).all() and took[1] - took[0] < took[2] - took[1]


def test_approximate_search_in_blocks(spark):
    c, x, book, feats = book_and_features(spark, words=40)
    exact = {r.feature_id: (r.words, r.distances) for r in codebook.nearest(feats, book, 3).collect()}
    for block in (1 << 20, 300):
        near = codebook.approximate_nearest(feats, book, 3, None, block_bytes=block).collect()
        assert {r.feature_id: (r.words, r.distances) for r in near} == exact and all(0 < r.compared <= 40 for r in near)
    one = feats.withColumn("descriptor", F.when(F.col("feature_id") > 3, F.col("descriptor")))
    assert {r.feature_id for r in codebook.approximate_nearest(one, book, 3).where("words is null and compared is null").collect()} == {0, 1, 2, 3}
    assert codebook.approximate_nearest(feats, book.limit(0), 3).first().words == []


def test_features_keep_a_column_named_compared(spark):
    c, x, book, feats = book_and_features(spark, words=40)
    exact = {r.feature_id: r.words for r in codebook.nearest(feats, book, 3).collect()}
    own = feats.withColumn("compared", F.col("feature_id") * 2)
    for block in (1 << 20, 300):
        got = codebook.nearest(own, book, 3, block_bytes=block)
        assert got.columns == [*own.columns, "words", "distances"]
        assert {r.feature_id: (r.words, r.compared) for r in got.collect()} == {i: (w, 2 * i) for i, w in exact.items()}
    with pytest.raises(ValueError, match="compared"):
        codebook.approximate_nearest(own, book, 3)


def test_limited_kd_tree_query(spark, sf):
    """Found and compared of each feature, as a search beside Spark has them."""
    features, words = (df.collect() for df in later._halves(spark, sf))
    centers, names = np.array([r.center for r in words], np.float32), np.array([r.word for r in words], np.int64)
    x = np.array([r.descriptor for r in features], np.float32)
    order = np.argsort(names)
    near, _, compared = kdtree.KdTree(names[order], centers[order]).search(x, later.K, later.VISITS)
    exact, _ = codebook._best(names, codebook.squared(x, centers), later.K)
    want = {r.feature_id: (len(set(a) & set(b)), n) for r, a, b, n in zip(features, near.tolist(), exact.tolist(), compared.tolist())}
    got = later.knn_kd_tree_limited(spark, sf).collect()
    assert len(got) == len(want) and {r.feature_id: (r.found, r.compared) for r in got} == want


def test_sparse_distances_equal_dense_ones(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        a, b = (np.where(rng.random(20) < rng.choice([0, 0.2, 0.9]), np.abs(rng.standard_normal(20)), 0).astype(np.float32) for _ in "ab")
        rows.append((i, a.tolist(), b.tolist()))
    df = spark.createDataFrame(rows, "i int, a array<float>, b array<float>").withColumns({c + "s": V.sparse(F.col(c)) for c in "ab"})
    for f, g in ((D.l2sq, sparse.l2sq), (D.l1_raw, sparse.l1_raw), (D.l1, sparse.l1), (D.l2, sparse.l2), (D.x2, sparse.x2), (D.dot, sparse.dot), (D.intersection, sparse.intersection), (lambda a, b: D.ln(a, b, 4), lambda a, b: sparse.ln(a, b, 4))):
        assert df.where(~f(F.col("a"), F.col("b")).eqNullSafe(g(F.col("as"), F.col("bs")))).count() == 0
    assert df.select(sparse.l1(F.col("as"), F.lit(None).cast(df.schema["bs"].dataType)).alias("d")).first().d is None


@pytest.mark.parametrize("mode", ["reference", "euclidean"])
def test_search_by_posting_lists(spark, monkeypatch, mode):
    """Blocks of queries and of items, ties, items without terms or common words, more words than memory would have rows:
    what is skipped by its bound never comes first."""
    rng = np.random.default_rng(9)
    held = {i: {int(w) * 10_000_019: round(float(v), 1) for w, v in zip(rng.choice(40, rng.integers(1, 9), False), rng.random(9))} for i in range(400)}
    base = spark.createDataFrame([(i, w, v) for i, t in held.items() for w, v in t.items()] + [(900, 1, 0.0), (901, None, None)], "id bigint, word int, value double").repartition(3)
    asked = base.where("id % 8 = 0")

    def plain(a, b):
        common = sorted(w for w in held[a] if w in held.get(b, {}) and held[a][w] and held[b][w])
        if mode == "reference":
            return abs(held[a][common[-1]] - held[b][common[-1]]) if common else 0.0
        return math.sqrt(sum((held[a][w] - held[b][w]) ** 2 for w in common)) if common else 0.9

    want = {}
    for a in (i for i in held if i % 8 == 0):
        order = sorted((round(plain(a, b), 6), b) for b in [*held, 900, 901])[:12]
        want |= {(a, n + 1): (b, s) for n, (s, b) in enumerate(order)}
    for terms, rows in ((10**6, "10000"), (60, "10000"), (10**6, "16")):
        monkeypatch.setattr(search, "BLOCK_TERMS", terms)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = search.top(asked, base, mode, 0.9, 12, 6).collect()
            seen = search.work(asked, base, mode, 0.9, 12, 6).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {(r.query_id, r["rank"]): (r.item_id, r.score) for r in got} == want
        assert all(r.scored <= r["items"] == 402 for r in seen) and {r.query_id for r in seen} == {a for a, _ in want}
    assert sum(r.skipped for r in seen) > 0 and sum(r.scored for r in seen) < 0.6 * sum(r["items"] for r in seen)
    assert search.top(asked, base, mode, 0.9, 0).count() == 0


def test_search_traps(spark):
    base = spark.createDataFrame([(1, 1, 0.5), (1, 3, 0.2), (2, 1, 0.1), (3, 2, 1.0), (4, 3, 0.0)], "id bigint, word int, value double")
    query = spark.createDataFrame([(9, 1, 0.4), (9, 3, 0.9)], "id bigint, word int, value double")
    got = {r.item_id: round(r.score, 6) for r in search.scores(query, base).collect()}
    assert got == {1: 0.7, 2: 0.3, 3: 0.0, 4: 0.0}  # the highest common word decides; without one, 0
    order = [r.item_id for r in search.ranked(search.scores(query, base), 100).orderBy("rank").collect()]
    assert order == [3, 4, 2, 1]  # not padded to 100
    far = {r.item_id: round(r.score, 6) for r in search.scores(query, base, "euclidean", 5.0).collect()}
    assert far == {1: round(math.sqrt(0.01 + 0.49), 6), 2: 0.3, 3: 5.0, 4: 5.0}
    lists = search.result_lists(search.ranked(search.scores(query, base), 2), spark.createDataFrame([(3, "c"), (4, "d")], "item_id bigint, name string")).first().result
    assert [(r["rank"], r.url) for r in lists] == [(1, "http://foo/c"), (2, "http://foo/d")]
    with pytest.raises(ValueError):
        search.scores(query, base, "other")


def test_base_lines(spark, tmp_path):
    lines = ["a 1:0.5 2:1 2:3", "", "x", "b 0:1 -1:2 7:abc q 8:1e-2x", "  c\t5:.5 ", "d"]
    path = tmp_path / "base.txt"
    path.write_text("\n".join(lines))
    got = {(r.name, r.word): r.value and round(r.value, 6) for r in text_files.read_base(spark, str(path)).collect()}
    assert got == {("a", 1): 0.5, ("a", 2): 3.0, ("b", 7): 0.0, ("b", 8): 0.01, ("c", 5): 0.5, ("d", None): None} or got == {("a", 1): 0.5, ("a", 2): 3.0, ("b", 7): 0.0, ("b", 8): 0.01, ("c", 5): 0.5}
    text_files.write_base(text_files.read_base(spark, str(path)), str(tmp_path / "again"))
    assert {(r.name, r.word) for r in text_files.read_base(spark, str(tmp_path / "again")).collect()} == {g for g in got if g[1]}


def split_score(labels, left, method):
    def h(x, n):
        c = np.unique(x, return_counts=True)[1]
        return float(-(c / n * np.log2(c / n)).sum())

    n, l, r = len(labels), labels[left], labels[~left]
    if method == "Entropy":
        return h(l, n) + h(r, n)
    hc, ht = h(labels, n), h(left, n)
    mi = hc - len(l) / n * h(l, len(l)) - len(r) / n * h(r, len(r))
    return mi if method == "MutualInformation" else 2 * mi / (hc + ht)


@pytest.mark.parametrize("method", ["Sc", "MutualInformation", "Entropy", "Balanced", "ScWithError"])
def test_thresholds_do_not_depend_on_ranges(spark, method):
    """Nodes of any size, values nearly all in one place, repeated values, labels: ranges of any size give one result."""
    rng = np.random.default_rng(8)
    rows = [(1, int(k % 3), float(v)) for k, v in enumerate(rng.random(300) * 1e-3)] + [(1, 0, 1.0), (1, 1, 1000.0)]
    rows += [(2, int(k), float(v)) for k, v in zip(rng.integers(0, 2, 200), rng.integers(0, 6, 200))] + [(3, 1, 2.0), (3, 0, float("nan")), (4, 5, 1.0), (4, 6, 2.0)]
    samples = spark.createDataFrame(rows, "node bigint, label int, val double").repartition(3)
    whole, cut, fine = ({r.node: (r.threshold, round(r.score, 9)) for r in information.best_threshold(samples, method, n).collect()} for n in (10**6, 40, 3))
    assert whole == cut == fine and {1, 2, 4} <= set(whole)


def test_skewed_values_spread_evenly(spark):
    """All values but one lie in one 256th of the range; no range has many more counts than another."""
    samples = spark.range(40_000).select(F.lit(1).alias("node"), (F.col("id") % 2).alias("label"), F.when(F.col("id") == 0, 1e9).otherwise(F.sqrt(F.col("id").cast("double"))).alias("val"))
    ranges = [r["count"] for r in information._running(samples).groupBy("range").count().collect()]
    assert len(ranges) == information.RANGES and max(ranges) < 2 * 40_000 / len(ranges)


def test_ranges_are_the_same_each_time(spark):
    """Rows that arrive in another order each time they are read fall into the same ranges."""

    def mixed(batches):
        table = pa.Table.from_batches(batches)
        yield from table.take(np.random.default_rng().permutation(len(table))).to_batches()

    rows = spark.range(600_000, numPartitions=2).selectExpr("1L as node", "cast(pmod(xxhash64(id), 3) as int) as label", "xxhash64(id, 1L) / 1e18 as val")
    running = information._running(rows.mapInArrow(mixed, rows.schema))
    first, second = (sorted(map(tuple, running.groupBy("range").agg(F.count("*"), F.min("val"), F.max("val")).collect())) for _ in range(2))
    assert first == second


@pytest.mark.parametrize("method", ["Sc", "MutualInformation", "Entropy"])
def test_best_threshold_is_the_best(spark, method):
    rng = np.random.default_rng(4)
    rows = [(node, int(rng.integers(0, 3)), float(np.float32(rng.integers(0, 15) / (node + 1)))) for node in range(4) for _ in range(80)]
    samples = spark.createDataFrame([*rows, (0, None, 1.0), (0, 1, None), (0, 1, float("nan")), (9, 1, 2.0)], "node bigint, label int, val float")
    got = {r.node: (r.threshold, r.score) for r in information.best_threshold(samples, method).collect()}
    for node in range(4):
        y, v = np.array([r[1] for r in rows if r[0] == node]), np.array([r[2] for r in rows if r[0] == node], np.float32)
        values = np.unique(v).astype(np.float64)
        options = [(split_score(y, v <= t, method), -t) for t in (values[1:] + values[:-1]) / 2]
        assert math.isclose(max(options)[0], got[node][1], abs_tol=1e-9)
        check = information.evaluated(samples.where(F.col("node") == node), spark.createDataFrame([(node, got[node][0])], "node bigint, threshold double"), method).first()
        assert math.isclose(check.score, got[node][1], abs_tol=1e-9)
    single = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0)], "node bigint, label int, val float")
    assert information.evaluated(single, spark.createDataFrame([(1, 9.0)], "node bigint, threshold double"), "Sc").first().score is None
    with pytest.raises(ValueError):
        information.best_threshold(samples, "Gini")


def test_threshold_with_error_of_floats_is_their_middle(spark):
    """The sum of two floats need not be a float."""
    rows = spark.createDataFrame([(1, k, v) for k, v in ((0, 16777216.0), (1, 16777218.0)) for _ in range(4)], "node bigint, label int, val float")
    assert information.best_threshold(rows, "ScWithError").first().threshold == 16777217.0


def test_balanced_with_few_values(spark):
    two = spark.createDataFrame([(1, 1, 2.0), (1, 0, 4.0)], "node bigint, label int, val float")
    assert information.best_threshold(two, "Balanced").first().threshold == 4.0
    assert information.best_threshold(two, "Mean").first().threshold == 3.0


def test_kmeans(spark):
    feats = envelope.gaussian_mixture(spark, 400, 3)
    book = kmeans.trained(feats, 4, 5)
    assert book.count() == 4
    before, after = codebook.nearest_word(feats, kmeans.initial_words(feats, 4)), codebook.nearest_word(feats, book)
    assert after.agg(F.avg("distance")).first()[0] < before.agg(F.avg("distance")).first()[0]
    assert 0 <= kmeans.changed(before, after).first()[0] <= 1
    far = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [1e3, 0.0, 0.0])], "word int, center array<float>")
    assert [r.word for r in kmeans.lost(far, kmeans.step(feats, far)).collect()] == [1]
    assert kmeans.trained(feats, 2, 2, start=far).where("word = 1 and center[0] < 100").count() == 1  # seeded again
    assert kmeans.fast(feats, 4, 3).count() <= 4
    weights, small = kmeans.supervised(feats, 2, 4, 2)
    assert weights.shape == (2, 3) and len(small.first().center) == 2
    weights, small = kmeans.joint(feats, 2, 4, 2)
    assert weights.shape == (2, 3) and len(small.first().center) == 2


def test_projections(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 4)) * [5, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "feature_id bigint, descriptor array<double>, label int")
    rows, values = projection.pca(df, "descriptor", 2)
    want = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(values, want[0][::-1][:2]) and np.allclose(abs(rows[0]), abs(want[1][:, -1]), atol=1e-6)
    apart = spark.createDataFrame([(i, [float(v[0]), 5.0 * (i % 2) + float(v[3]), float(v[2])], i % 2) for i, v in enumerate(x)], "feature_id bigint, descriptor array<double>, label int")
    best, _ = projection.ldp(apart, "descriptor", "label", 1)
    assert abs(best[0, 1]) > 0.95  # the dimension that tells classes apart
    assert projection.ldp(apart.withColumn("label", F.col("feature_id").cast("int")), "descriptor", "label", 1)[0].shape == (1, 3)
    assert len(projection.applied(df, rows).first().descriptor) == 2
    assert statistics.covariance(df.limit(0), "descriptor")[2] == 0


def test_tree_nodes_by_their_own_rows(spark):
    """Statistics of a level's nodes, a block of nodes at a time, against numpy; directions; label subsets."""
    _, x, _, feats = book_and_features(spark, n=300)
    x, labels = x.astype(np.float64), (x[:, 0] > 0).astype(int)
    rows = feats.select("label", F.col("descriptor").alias("x"), F.xxhash64("descriptor").alias("key"))
    decided = [{"dim1": 1, "threshold": 0.0, "left_node": 1, "right_node": 2}, None, None]
    got = trees._node_stats(rows, "TERC", decided, [1, 2], 5, 4, True)
    for n, mine in ((1, x[:, 1] <= 0), (2, x[:, 1] > 0)):
        v = x[mine]
        assert got[n].n == len(v) and np.allclose(got[n].mean, v.mean(0)) and np.allclose(got[n].deviation, v.std(0)) and np.allclose(got[n].products, v.T @ v)
        assert all(np.allclose(got[n].classes[c][1:], v[labels[mine] == c].sum(0)) for c in (0, 1)) and len(got[n].drawn) == 4
        assert all(np.abs(v - d).sum(1).min() < 1e-6 for d in got[n].drawn)
        values, directions = got[n].directions("PCA")
        assert np.allclose(values, np.linalg.eigvalsh(np.cov(v, rowvar=False, bias=True))[::-1])
        assert abs(got[n].directions("LDP")[1][0][0]) > 0.9  # the dimension that tells the labels apart
    rng = np.random.default_rng(1)
    turns = np.bincount([trees.wheel(rng, np.array([2.0, 1.0, -5.0, 9.0]), 3) for _ in range(2000)], minlength=4)
    assert turns[2] == turns[3] == 0 and 0.75 < turns[0] / 2000 < 0.85
    whole, few = (trees.grown(feats, "TERC", tries=4, levels=4, seed=3, classes=c) for c in (0, 5))
    assert whole == few and trees.grown(feats, "TPC", tries=2, levels=2, seed=3, random_threshold=False, method="ScWithError")
    with pytest.raises(ValueError):
        trees.grown(feats, "TERC", method="ScWithError")


@pytest.mark.parametrize("kind,products", [("TERC", False), ("TPC", False), ("TPC", True)])
def test_histograms_give_the_statistics_of_both_children(spark, kind, products):
    """What one pass and differences give is what a pass over the children's own rows gives, drawn rows included."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((700, 5)).astype(np.float32)
    x[300:400] = x[0]  # equal rows
    rows = spark.createDataFrame([(int(i % 3), v.tolist()) for i, v in enumerate(x)], "label int, x array<float>").repartition(7)
    rows = rows.select("label", "x", F.xxhash64("x").alias("key"))
    stats = trees._node_stats(rows, kind, [None], [0], 5, 3, products, classes=True)
    tests = {0: trees._tests(rng, kind, 5, 4, stats[0], "")}
    tests[0][1] = tests[0][0] | {"threshold": -2.5}  # few rows on one side
    found = trees._histograms(rows, kind, [None], tests, stats, True, 3)
    assert found.where("test = -1").count() <= 2 * 3 * 4
    counts = {(r.test, r.label): (r.left, r.right) for r in trees._sides(found, stats, [0]).collect()}
    want = {(r.test, r.label): (r.left, r.right) for r in trees._counts(rows, kind, [None], tests).collect()}
    assert counts == want
    for t in range(4):
        decided = [tests[0][t] | {"left_node": 1, "right_node": 2}, None, None]
        children = trees._children(found, kind, decided, {0: t}, stats, 5, True, 3)
        if products:
            trees._with_products(rows, kind, decided, {0: stats[0]}, children, 5)
        direct = trees._node_stats(rows, kind, decided, [1, 2], 5, 3, products, classes=True)
        for n in (1, 2):
            a, b = children[n], direct[n]
            assert a.n == b.n and a.labels == b.labels and np.allclose(a.sums, b.sums) and np.allclose(a.squares, b.squares)
            assert np.array_equal(a.drawn[np.lexsort(a.drawn.T)], b.drawn[np.lexsort(b.drawn.T)])
            if products:
                assert np.allclose(a.products, b.products) and all(np.allclose(a.classes[c], b.classes[c]) for c in b.classes)


def test_tree_level_is_one_pass(spark, monkeypatch):
    _, _, _, feats = book_and_features(spark, n=300)
    passes = []
    own = trees._histograms
    monkeypatch.setattr(trees, "_histograms", lambda *a: passes.append(len(a[3])) or own(*a))
    nodes = trees.grown(feats, "TERC", tries=6, levels=4, seed=5)
    assert 1 <= len(passes) <= 4 and len(nodes) > 4
    monkeypatch.setattr(trees, "CELLS", 1)  # a node at a time: the same tree
    assert [n["dim1"] for n in trees.grown(feats, "TERC", tries=6, levels=4, seed=5)] == [n["dim1"] for n in nodes] and len(passes) > 8


def test_trees(spark):
    _, _, _, feats = book_and_features(spark, n=300)
    for kind, options in (("TERC", {}), ("TERC", {"random_threshold": False}), ("TCMP", {}), ("TPC", {}), ("TPC", {"directions": "PCA"}), ("TPC", {"directions": "LDP"})):
        nodes = trees.grown(feats, kind, tries=6, levels=3, seed=5, **options)
        words = sorted(w for n in nodes for s in ("left", "right") if n[f"{s}_node"] is None for w in [n[f"{s}_word"]])
        assert words == list(range(len(nodes) + 1)) and trees.rightmost_word(nodes) == len(nodes)
        found = trees.words(feats, nodes, kind)
        assert {r.tree_words[0] for r in found.select("tree_words").distinct().collect()} <= set(words)
        if kind == "TERC":
            joined = {r.feature_id: r.word for r in trees.descended(feats, trees.frame(spark, nodes), "feature_id", "descriptor", 4).collect()}
            assert joined == {r.feature_id: r.tree_words[0] for r in found.collect()}
        again, rows = text_files.parse_forest(text_files.format_forest(kind, nodes))
        assert again == kind and [(r["node"], r["left_node"], r["right_word"]) for r in rows] == [(i, *x) for i, x in enumerate((r["left_node"], r["right_word"]) for r in rows)]
        assert sorted(w for n in rows for s in ("left", "right") if n[f"{s}_node"] is None for w in [n[f"{s}_word"]]) == words
    soft = trees.soft_words(feats, nodes, 10, seed=None).first().word_weights
    assert math.isclose(sum(w.weight for w in soft), 1, rel_tol=1e-6)
    drawn = trees.soft_words(feats, nodes, 10).first().word_weights
    assert math.isclose(sum(w.weight for w in drawn), 1, rel_tol=1e-6)
    assert trees.grown(feats.withColumn("label", F.lit(1)), "TERC", tries=3)[0]["left_node"] is None  # one class: a leaf
    assert trees.grown(feats.limit(0), "TERC") == []
    assert trees.tail(0) == pytest.approx(0.5, abs=0.01) and trees.tail(6) == 0


def test_random_pairs(spark):
    """One class has 90 % of the rows, some have one row; pairs are as many as asked, within or across classes, spread over
    all rows, and no two rows of a class share a number."""
    labels = [0] * 1800 + [1] * 150 + [2] * 40 + list(range(3, 13)) + [None] * 5
    df = spark.createDataFrame([(i, l) for i, l in enumerate(labels)], "k bigint, label int").withColumn("v", F.col("k")).repartition(4)
    of = dict(enumerate(labels))
    for same in (True, False):
        got = projection.random_pairs(df, "v", "label", 3000, same, "k", 5).collect()
        assert len(got) == 3000 and all(r.a != r.b and (of[r.a] == of[r.b]) == same and None not in (of[r.a], of[r.b]) for r in got)
        assert len({r.a for r in got}) > 1000 and len({(r.a, r.b) for r in got}) > 2500
        again = projection.random_pairs(df.repartition(2), "v", "label", 3000, same, "k", 5).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    share = sum(of[r.a] == 0 for r in projection.random_pairs(df, "v", "label", 3000, True, "k", 5).collect()) / 3000
    assert share == pytest.approx(1800 / 1990, abs=0.03)
    placed = places.numbered(df.withColumn("draw", F.md5(F.col("k").cast("string"))), "label", "draw", "k").collect()
    assert sorted(r.start + r.nth for r in placed) == list(range(2000))
    one = df.where("label = 0")
    assert projection.random_pairs(one, "v", "label", 10, False, "k").count() == 0
    assert projection.random_pairs(df.where("label > 2"), "v", "label", 10, True, "k").count() == 0


def test_vector_files(spark, tmp_path):
    vector_file.register(spark)
    rows = [(0, (3, None, [1.0, 2.0, 255.0])), (1, None), (2, (4, [1, 3], [0.5, -1.0])), (3, (2, None, [float("nan"), 1.5])), (4, (0, None, []))]
    path = str(tmp_path / "v.fvf")
    spark.createDataFrame(rows, VECTOR_FILE).repartition(3).write.format("fvf").option("capacity", 100).mode("overwrite").save(path)
    assert len(vector_file.header(path)) == 5
    for size in (1, 2, 100):
        got = spark.read.format("fvf").option("size", size).load(path).orderBy("vec_id").collect()
        assert [(r.vec_id, None if r.vector is None else (r.vector.dimension, r.vector.ids)) for r in got] == [(i, None if v is None else v[:2]) for i, v in rows]
        assert got[2].vector.data == [0.5, -1.0] and math.isnan(got[3].vector.data[0])
    assert [r.vec_id for r in spark.read.format("fvf").load(path).where("vec_id in (1, 3)").orderBy("vec_id").collect()] == [1, 3]
    assert spark.read.format("fvf").load(path).where("vec_id >= 3").count() == 2
    picked = vector_file.selected(spark, path, spark.createDataFrame([(2,)], "vec_id bigint")).orderBy("vec_id").collect()
    assert [r.vector is not None for r in picked] == [False, False, True, False, False]
    with pytest.raises(Exception, match="null vector"):
        repair_file(spark, path, str(tmp_path / "w.fvf"))
    spark.createDataFrame([rows[0], rows[3]], VECTOR_FILE).write.format("fvf").mode("overwrite").save(path)
    repair_file(spark, path, str(tmp_path / "w.fvf"))
    fixed = spark.read.format("fvf").load(str(tmp_path / "w.fvf")).orderBy("vec_id").collect()
    assert fixed[1].vector.data == pytest.approx([0.9, 1.5])
    with pytest.raises(Exception, match="room for 1"):
        spark.createDataFrame(rows, VECTOR_FILE).write.format("fvf").option("capacity", 1).mode("overwrite").save(path)
    (tmp_path / "bad").write_bytes(b"something else, long enough to be read")
    with pytest.raises(ValueError):
        vector_file.header(str(tmp_path / "bad"))


def test_vector_files_in_ranges_and_in_one(spark, tmp_path):
    """A folder of ranges, a folder of interleaved parts and one file written by all tasks hold the same; a table of ids
    reads in proportion to the ids."""
    vector_file.register(spark)
    rng = np.random.default_rng(11)
    rows = [(i * 3, None if i % 50 == 7 else (40, None, rng.random(40).astype(np.float32).tolist()) if i % 3 else (10**6, [5, 70_000 + i], [1.0, 2.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, VECTOR_FILE).repartition(5)
    paths = {k: str(tmp_path / k) for k in ("ranges", "mixed", "one")}
    vector_file.write(df, paths["ranges"], 4)
    df.write.format("fvf").mode("append").save(paths["mixed"])
    vector_file.write_file(df, paths["one"], 4, capacity=5000)
    for k, path in paths.items():
        assert vector_file.is_folder(path) == (k != "one") and ("merged" in (vector_file.Places(path).manifest or {})) == (k == "mixed")
        for size in (700, 10**6):
            got = [(r.vec_id, None if r.vector is None else tuple(r.vector)) for r in spark.read.format("fvf").option("size", size).load(path).orderBy("vec_id").collect()]
            assert got == [(i, v) for i, (_, v) in enumerate(rows)]
        wanted = [2, 3, 4, 7, 900, 901, 2999, 5000, -1]
        picked = vector_file.picked(spark, path, spark.createDataFrame([(i,) for i in [*wanted, 3, None]], "vec_id bigint")).collect()
        assert {r.vec_id: None if r.vector is None else tuple(r.vector) for r in picked} == {i: rows[i][1] for i in wanted if 0 <= i < 3000}
        assert sum(r.bytes for r in picked) < 3000  # of some 400,000
        assert vector_file.selected(spark, path, spark.createDataFrame([(1,)], "vec_id bigint")).count() == 3000
    assert sorted(p.name for p in tmp_path.iterdir()) == ["mixed", "one", "ranges"]
    with pytest.raises(Exception, match="room for 10"):
        vector_file.write_file(df, paths["one"], 4, capacity=10)
    assert vector_file.Places(paths["one"]).count == 3000 and sorted(p.name for p in tmp_path.iterdir()) == ["mixed", "one", "ranges"]
    vector_file.write(df.limit(0), paths["one"])
    assert spark.read.format("fvf").load(paths["one"]).count() == 0
    vector_file.write_file(df.limit(0), paths["ranges"])
    assert spark.read.format("fvf").load(paths["ranges"]).count() == 0


def test_codebook_files(spark, tmp_path):
    book = text_files.Codebook(np.array([[1.5, 2], [3, 4.25]]), np.array([[1.0, 0, 0], [0, 1, 0]]), 0.125, True)
    path = str(tmp_path / "book.txt")
    text_files.write_codebook(book, path)
    got = text_files.read_codebook(spark, path)
    assert np.array_equal(got.centers, book.centers) and np.array_equal(got.projection, book.projection) and got.average == 0.125 and got.exact
    assert got.input_dimension == 3 and got.word_count == 2 and got.frame(spark).count() == 2
    plain = text_files.parse_codebook("Projection+K-means\n0\n0 0\n\n1 2\n1 2 \n")
    assert plain.projection is None and plain.average is None and not plain.exact
    with pytest.raises(ValueError):
        text_files.parse_codebook("else")


def request(uuid, steps, **more):
    return {"uuid": uuid, "configuration": [{"queue": q} | c for q, c in steps], "returnQueue": "back"} | more


def test_envelope_round_trip(spark):
    matrix = np.arange(6, dtype="<f4")
    message = {"uuid": "u1", "timestamp": 1.5, "configuration": [{"queue": "a", "fe": {}, "translate": {"neighborCount": 300}}, {"match": {"listSize": 7, "database": "d"}}], "errorCode": 3, "message": ["x", "y"], "image": b"\0\1", "blob": {"dim": [3, 2], "data": matrix.tobytes()}, "result": {"score": [0.5], "url": ["http://foo/n"]}}
    data = envelope.serialise(message)
    assert envelope.parse(data) == message
    unknown = data + bytes([100 << 3 & 127 | 128 | 0, 100 >> 4, 5])
    assert envelope.parse(unknown) == message
    rows = envelope.decode(spark.createDataFrame([(data,), (b"\xff\xff",), (b"\x92\x01\x00",)], "value binary")).collect()
    assert [r.malformed for r in rows] == [False, True, True]
    assert rows[0].configuration[0].translate.neighborCount == 300 and rows[0].configuration[0].fe and rows[0].result[0].url == "http://foo/n"
    back = envelope.encode(envelope.decode(spark.createDataFrame([(data,)], "value binary"))).first()
    assert envelope.parse(bytes(back.value)) == message
    flat = envelope.matrix_rows(envelope.decode(spark.createDataFrame([(data,)], "value binary")), "blob", "uuid").orderBy("row").collect()
    assert [r["values"] for r in flat] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]
    assert envelope.dummy_features(spark).count() == 5


def test_routing(spark):
    rows = [request("a", [("q1", {}), ("q2", {})]), request("b", [("q1", {})]), request("c", []), {"uuid": "d", "configuration": None, "returnQueue": None}]
    df = spark.createDataFrame(rows, ENVELOPE)
    got = {r.uuid: (r.next_queue, r.errorCode, len(r.configuration or []), len(r.pastConfiguration or [])) for r in pipeline.routed(df).collect()}
    assert got == {"a": ("q2", 0, 1, 1), "b": ("back", 0, 0, 1), "c": ("back", 10, 0, 0), "d": (None, 10, 0, 0)}
    alive, dead = pipeline.dead_letters(df)
    assert alive.count() == 3 and [r.uuid for r in dead.collect()] == ["d"]


def test_stream_equals_batch(spark, tmp_path):
    def extract(data: bytes):
        if data == b"bad":
            raise ValueError("no image")
        rng = np.random.default_rng(list(data))
        return rng.standard_normal((4, 6)), rng.standard_normal((4, 5))

    _, _, book, _ = book_and_features(spark)
    base = spark.createDataFrame([(i, w, 0.1 * (i + w)) for i in range(5) for w in range(1, 8)], "id bigint, word int, value double")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "item_id bigint, name string")
    stages = [pipeline.extraction_stage(extract), pipeline.words_stage(book, 3.0, 3), pipeline.search_stage(base, names)]
    steps = [("f", {"fe": True}), ("w", {"translate": {"neighborCount": 3}}), ("s", {"match": {"listSize": 2, "database": None}})]
    rows = [request(f"u{i}", steps, image=bytes([i])) for i in range(3)] + [request("bad", steps, image=b"bad"), {"uuid": "lost", "configuration": None, "returnQueue": None}]
    df = spark.createDataFrame(rows, ENVELOPE)
    df.write.json(str(tmp_path / "in"))
    query = pipeline.start(pipeline.read(spark, str(tmp_path / "in")), stages, str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    plain = lambda d: {r.uuid: (r.next_queue, r.errorCode, [(x["rank"], x.url, round(x.score, 4)) for x in r.result or []]) for r in d.collect()}
    streamed = plain(spark.read.schema(ENVELOPE.add("next_queue", "string")).option("basePath", str(tmp_path / "out")).json(str(tmp_path / "out" / "*")))
    ENVELOPE.fields.pop()
    ENVELOPE.names.pop()
    want = plain(pipeline.run(pipeline.dead_letters(df)[0], stages))
    assert streamed == want and want["u0"][0] == "back" and len(want["u0"][2]) == 2 and want["bad"][1] == 10
    assert [r.uuid for r in spark.read.json(str(tmp_path / "dead" / "*")).collect()] == ["lost"]


def test_no_module_needs_the_llm_folder():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['visbag.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50 and len(e.oracle_sql()) > 50"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def png(image: np.ndarray, kind: int) -> bytes:
    """A PNG whose lines all use one filter."""
    import struct
    import zlib

    depth, out, x = image.shape[2], b"", image.astype(np.int64)
    for y in range(len(x)):
        left = np.vstack([np.zeros((1, depth), int), x[y, :-1]])
        up = x[y - 1] if y else np.zeros_like(x[y])
        corner = np.vstack([np.zeros((1, depth), int), up[:-1]])
        guess = left + up - corner
        a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out += bytes([kind]) + ((x[y] - (0, left, up, (left + up) // 2, paeth)[kind]) & 255).astype(np.uint8).tobytes()
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, {1: 0, 3: 2, 4: 6}[depth], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")


def test_keypoints(spark, tmp_path):
    from visbag.sources import keypoints

    rng = np.random.default_rng(4)
    color = rng.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    want = np.rint(color @ np.array(keypoints.WEIGHTS)).astype(np.uint8)
    for kind in range(5):
        assert np.array_equal(keypoints.grey(png(color, kind)), want)
    assert np.array_equal(keypoints.grey(png(np.dstack([color, color[:, :, :1]]), 4)), want)
    assert np.array_equal(keypoints.grey(b"P6 7 9 255\n" + color.tobytes()), want)
    assert np.array_equal(keypoints.grey(b"P5\n# c\n7 9\n255\n" + want.tobytes()), want)
    for bad in (b"", b"P5 1", b"\x89PNG\r\n\x1a\n"):
        with pytest.raises(Exception):
            keypoints.grey(bad)
    (tmp_path / "a.png").write_bytes(png(color, 1))
    row = keypoints.grey_images(spark, str(tmp_path)).first()
    assert (row.height, row.width) == (9, 7) and np.abs(np.array(row["values"]).reshape(9, 7) - want.astype(int)).max() <= 1
    image = np.kron(rng.integers(0, 256, (12, 12)), np.ones((10, 10))).astype(np.uint8)
    moved = np.roll(image, (10, 10), (0, 1))
    points, values = keypoints.described(image)
    others, found = keypoints.described(moved)
    assert len(points) > 10 and np.allclose(np.linalg.norm(values, axis=1), 1, atol=1e-5)
    at = {(p[0], p[1], p[5]): v for p, v in zip(others, found)}
    same = [np.abs(v - at[p[0] + 10, p[1] + 10, p[5]]).max() < 1e-5 for p, v in zip(points, values) if (p[0] + 10, p[1] + 10, p[5]) in at]
    assert len(same) > 5 and sum(same) / len(same) > 0.9
    images = spark.createDataFrame([(1, bytearray(b"P5 120 120 255\n" + image.tobytes())), (2, bytearray(b"x")), (3, None)], "image_id bigint, image binary")
    got = envelope.extracted(images, keypoints.extract)
    assert {r.image_id for r in got.collect()} == {1} and got.count() == len(points)


def test_requests_choose_neighbours_and_database(spark):
    book = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "word int, center array<float>")
    rows = np.array([[0, 0, 1, 0, 0, 0, 0.4, 0.0], [0, 0, 1, 0, 0, 0, 2.2, 0.0]], "<f4")
    slip = lambda k, db: [("bow", None, (k,) if k is not None else None, None, None), ("search", None, None, (2, db), None)]
    from visbag.schema import ENVELOPE

    data = [(str(i), None, slip(k, db), [], 0, None, "back", None, ([8, 2], bytearray(rows.tobytes())), None) for i, (k, db) in enumerate(((2, ""), (None, "other"), (0, "none")))]
    envelopes = spark.createDataFrame(data, ENVELOPE)
    worded = pipeline.words_stage(book, 1.0, 3)(envelopes)
    size = {r.uuid: r.blob.dim[0] for r in worded.collect()}
    assert size == {"0": 6 + 2 * 2, "1": 6 + 2 * 3, "2": 6 + 2 * 3}
    base = spark.createDataFrame([(10, 1, 0.5), (11, 2, 0.5)], "id bigint, word int, value double")
    other = spark.createDataFrame([(20, 1, 0.5)], "id bigint, word int, value double")
    names = spark.createDataFrame([(10, "a"), (11, "b"), (20, "c")], "item_id bigint, name string")
    asked = pipeline.routed(worded).select(*(f.name for f in ENVELOPE.fields))
    got = {r.uuid: r for r in pipeline.search_stage(base, names, databases={"other": (other, names)})(asked).collect()}
    assert {x.url[-1] for x in got["0"].result} == {"a", "b"} and [x.url[-1] for x in got["1"].result] == ["c"]
    assert got["2"].result is None and got["2"].errorCode == 10 and "unknown database" in got["2"].message
