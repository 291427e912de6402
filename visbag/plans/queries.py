"""The reference operators as queries over ``embeddings``, each over its whole table.

Bindings: a word of the codebook is the mean of the vectors whose id leaves the same remainder by 64 (centers rounded
to 6 digits, so that they do not depend on the order of summing); every vector is a feature of the image
vec_id div 10; queries are the images divisible by 50, against all images; a pair is a vector and the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import vectors as V
from ..operators import bow, codebook, information, kmeans, search, statistics, trees
from ..streaming import pipeline

WORDS, PER_IMAGE, QUERY_STEP, K, TOP = 64, 10, 50, 8, 10
CUT = 0.1


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.expr(f"vec_id div {PER_IMAGE}").alias("image_id"), F.col("vec_id").alias("feature_id"), F.col("embedding").alias("descriptor"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select(F.expr(f"cast(pmod(vec_id, {WORDS}) as int)").alias("word"), F.posexplode("embedding").alias("dim", "v"))
    means = rows.groupBy("word", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 6).cast("float").alias("m"))
    center = F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s.m)
    return means.groupBy("word").agg(center.alias("center"))


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6) + F.lit(0.0)


# --- distances


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = embeddings(spark, sf_dir).select(F.col("vec_id").alias("a_id"), (F.col("vec_id") + 1).alias("b_id"), F.col("embedding").alias("a"))
    b = embeddings(spark, sf_dir).select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return a.join(b, "b_id")


def positive(v: Column) -> Column:
    return F.transform(v, F.abs)


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "dist_l2sq": D.l2sq,
    "dist_l2sq_bounded": lambda a, b: D.bounded(D.l2sq(a, b), 2.0),
    "dist_l1_raw": D.l1_raw,
    "dist_l1_bounded": lambda a, b: D.bounded(D.l1_raw(a, b), 9.0),
    "dist_lr": lambda a, b: D.lr_raw(a, b, 3),
    "dist_lr_bounded": lambda a, b: D.bounded(D.lr_raw(a, b, 3), 0.5),
    "dist_x2_raw": lambda a, b: D.x2_raw(positive(a), positive(b)),
    "dist_x2_bounded": lambda a, b: D.bounded(D.x2_raw(positive(a), positive(b)), 3.0),
    "dist_l1": D.l1,
    "dist_l2": D.l2,
    "dist_ln4": lambda a, b: D.ln(a, b, 4),
    "dist_x2": lambda a, b: D.x2(positive(a), positive(b)),
    "dot": D.dot,
    "hist_intersection": lambda a, b: D.intersection(positive(a), positive(b)),
}


def _distance(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: pairs(spark, sf_dir).select("a_id", "b_id", r6(DISTANCES[name](F.col("a"), F.col("b"))).alias("d"))


# --- assignment and search


def nn1_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebook.nearest_word(features(spark, sf_dir), book(spark, sf_dir)).select("feature_id", "word", r6(F.col("distance")).alias("distance"))


def knn_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = codebook.nearest(features(spark, sf_dir), book(spark, sf_dir), K)
    return codebook.long_form(near).select("feature_id", "rank", "word", r6(F.col("distance")).alias("distance"))


def avg_word_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebook.average_word_distance(book(spark, sf_dir)).select(r6(F.col("avg_word_distance")).alias("avg_word_distance"))


def soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = book(spark, sf_dir)
    return bow.soft_assigned(codebook.nearest(features(spark, sf_dir), words, K), codebook.average_word_distance(words))


def soft_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bow.long_form(soft(spark, sf_dir)).select("feature_id", "rank", "word", r6(F.col("weight")).alias("weight"))


def histograms(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    words = book(spark, sf_dir)
    assigned = bow.soft_assigned(codebook.nearest(features(spark, sf_dir), words, k), codebook.average_word_distance(words))
    return bow.histogram(bow.long_form(assigned))


def bow_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms(spark, sf_dir).select("image_id", "word", r6(F.col("value")).alias("value"))


def _search(spark: SparkSession, sf_dir: str, mode: str, k: int = K) -> DataFrame:
    base = histograms(spark, sf_dir, k).select(F.col("image_id").alias("id"), "word", "value")
    return search.top(base.where(F.col("id") % QUERY_STEP == 0), base, mode, 9.0, TOP, 6)


def search_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "reference").withColumn("score", F.col("score") + F.lit(0.0))


def search_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "euclidean", 1).withColumn("score", F.col("score") + F.lit(0.0))


def search_no_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "reference", 1).withColumn("score", F.col("score") + F.lit(0.0))


def search_result_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = search.result_lists(_search(spark, sf_dir, "reference"))
    return lists.select("query_id", F.explode("result").alias("r")).select("query_id", "r.rank", "r.url", F.round(F.col("r.score").cast("double"), 4).alias("score"))


def url_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("image_id").distinct().select("image_id", F.concat(F.lit(search.URL), F.lit("image"), F.col("image_id").cast("string")).alias("url"))


def base_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the histograms as thousandths, written and parsed again."""
    terms = histograms(spark, sf_dir).select(F.concat(F.lit("image"), F.col("image_id").cast("string")).alias("name"), "word", F.floor(F.round("value", 6) * 1000).cast("long").alias("value"))
    return search.parsed_base(search.base_lines(terms)).select("name", "word", r6(F.col("value")).alias("value"))


# --- vectors


def sparse_input(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(F.abs(x.cast("double")) < CUT, F.lit(0.0).cast("float")).otherwise(x))


def bytes_input(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("float"))


def _entries(values: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = embeddings(spark, sf_dir).select("vec_id", F.posexplode(values(F.col("embedding"))).alias("dim", "val"))
        return rows.select("vec_id", "dim", r6(F.col("val")).alias("val"))

    return query


def to_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.sparse(sparse_input(F.col("embedding")))
    rows = embeddings(spark, sf_dir).select("vec_id", v.alias("v")).select("vec_id", "v.dimension", F.explode(F.arrays_zip("v.ids", "v.data")).alias("e"))
    return rows.select("vec_id", "dimension", F.col("e.ids").alias("dim"), r6(F.col("e.data")).alias("val"))


def optimize_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select("vec_id", F.explode(F.array(F.struct(F.lit("float").alias("kind"), F.col("embedding").alias("v")), F.struct(F.lit("thin").alias("kind"), sparse_input(F.col("embedding")).alias("v")), F.struct(F.lit("bytes").alias("kind"), bytes_input(F.col("embedding")).alias("v")))).alias("s"))
    e = V.encoding(V.vector(F.col("s.v")))
    return rows.select("vec_id", F.col("s.kind").alias("kind"), e.alias("e")).select("vec_id", "kind", "e.is_u8", "e.dense_bytes", "e.sparse_bytes", "e.is_sparse")


def concat_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = V.concatenated(V.sparse(sparse_input(F.col("a"))), V.sparse(sparse_input(F.col("b"))))
    rows = pairs(spark, sf_dir).select("a_id", both.alias("v")).select("a_id", F.explode(F.arrays_zip("v.ids", "v.data")).alias("e"))
    return rows.select("a_id", F.col("e.ids").alias("dim"), r6(F.col("e.data")).alias("val"))


def concat_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = V.dense(V.concatenated(V.vector(F.col("a")), V.vector(F.col("b"))))
    return pairs(spark, sf_dir).select("a_id", F.posexplode(both).alias("dim", "val")).select("a_id", "dim", r6(F.col("val")).alias("val"))


def nan_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 17 == 0, F.lit(float("nan")).cast("float")).otherwise(x))
    rows = embeddings(spark, sf_dir).select("vec_id", F.posexplode(V.repaired(holes)).alias("dim", "val"))
    return rows.select("vec_id", "dim", r6(F.col("val")).alias("val"))


REMOVED, SCALED = [0, 5, 63], [(1, 2.0), (7, 0.5), (1, 3.0), (99, 4.0)]

# --- statistics and information


def dim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.dimension_stats(embeddings(spark, sf_dir), "embedding").select("dim", r6(F.col("mean")).alias("mean"), r6(F.col("deviation")).alias("deviation"))


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.class_counts(embeddings(spark, sf_dir), "label")


WEIGHTS = [[((i * (c + 3)) % 7 - 3) / 10 for i in range(64)] for c in range(4)]


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", "label", F.posexplode(statistics.projected(F.col("embedding"), WEIGHTS)).alias("component", "p"))


def project_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir).select("vec_id", "component", r6(F.col("p")).alias("p"))


def projected_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.projected_stats(_projected(spark, sf_dir))
    return out.select("component", *(r6(F.col(c)).alias(c) for c in ("deviation", "mean_abs", "mean")))


def class_projected_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _projected(spark, sf_dir).where("component = 0")
    return statistics.projected_class_deviation(one).select(r6(F.col("class_deviation")).alias("class_deviation"))


def second_moment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.second_moments(embeddings(spark, sf_dir), "embedding").select("i", "j", r6(F.col("m")).alias("m"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each dimension."""
    return statistics.exploded(embeddings(spark, sf_dir), "embedding", "label").select(F.col("dim").cast("bigint").alias("node"), "label", "val")


def zero_thresholds(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.col("id").alias("node"), F.lit(0.0).cast("float").alias("threshold"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return information.split_counts(samples(spark, sf_dir), zero_thresholds(spark))


def _score(method: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: information.evaluated(samples(spark, sf_dir), zero_thresholds(spark), method).select("node", r6(F.col("score")).alias("score"))


def _best(method: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: information.best_threshold(samples(spark, sf_dir), method).select("node", r6(F.col("threshold")).alias("threshold"), r6(F.col("score")).alias("score"))


# --- clustering, trees, routing


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kmeans.step(features(spark, sf_dir), book(spark, sf_dir))
    return out.select("word", "n", F.posexplode("center").alias("dim", "c")).select("word", "n", "dim", F.round(F.col("c").cast("double"), 5).alias("c")).withColumn("c", F.col("c") + F.lit(0.0))


def kmeans_lost_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = book(spark, sf_dir).select((F.col("word") + WORDS).alias("word"), F.transform("center", lambda x: (x + F.lit(9.0).cast("float"))).alias("center"))
    both = book(spark, sf_dir).unionByName(far)
    return kmeans.lost(both, kmeans.step(features(spark, sf_dir), both))


def kmeans_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kmeans.trained(features(spark, sf_dir), 16, 3)
    return out.select("word", F.posexplode("center").alias("dim", "c")).select("word", "dim", (F.round(F.col("c").cast("double"), 3) + F.lit(0.0)).alias("c"))


# dim1 and threshold of a tree of seven leaves, three levels deep
TREE = [(0, 0, 0.0, 1, 2), (1, 1, 0.05, 3, 4), (2, 2, -0.05, 5, None), (3, 3, 0.0, None, None), (4, 4, 0.02, None, None), (5, 5, 0.0, None, None)]


def literal_tree() -> list[dict]:
    rows = [{"tree": 0, "node": n, "left_node": left, "right_node": right, "left_word": None, "right_word": None, "dim1": d, "dim2": None, "threshold": t, "deviation": None, "projection": None} for n, d, t, left, right in TREE]
    return trees.assign_words(rows)


def tree_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trees.words(embeddings(spark, sf_dir).select("vec_id", "embedding"), literal_tree(), "TERC", "embedding")
    return out.select("vec_id", F.col("tree_words")[0].alias("word"))


def tree_assign_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.descended(embeddings(spark, sf_dir), trees.frame(spark, literal_tree()), "vec_id", "embedding", 3).select("vec_id", "word")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An envelope for each vector, with label % 4 configurations left."""
    step = lambda q: f"named_struct('queue', '{q}', 'fe', cast(null as boolean), 'translate', cast(null as struct<neighborCount:bigint>), 'match', cast(null as struct<listSize:bigint,database:string>), 'caffe', cast(null as struct<resultSize:bigint>))"
    slips = f"slice(array({step('features')}, {step('bow')}, {step('search')}), 1, pmod(label, 4))"
    none = {f: f"cast(null as {t}) as {f}" for f, t in (("timestamp", "double"), ("errorCode", "bigint"), ("message", "array<string>"), ("image", "binary"))}
    return embeddings(spark, sf_dir).selectExpr("cast(vec_id as string) as uuid", *none.values(), f"{slips} as configuration", f"slice({slips}, 1, 0) as pastConfiguration", "'back' as returnQueue")


def route_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipeline.routed(envelopes(spark, sf_dir))
    return out.select("uuid", "next_queue", "errorCode", F.size("configuration").alias("left_over"), F.size("pastConfiguration").alias("past"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _distance(name) for name in DISTANCES}
QUERIES |= {f.__name__: f for f in (
    nn1_assign, knn_assign, avg_word_distance, soft_assign, bow_histogram, search_reference, search_euclidean, search_no_overlap, search_result_list, url_build, base_parse,
    to_sparse, optimize_encoding, concat_sparse, concat_dense, nan_repair, dim_stats, class_counts, project_linear, projected_stats, class_projected_std, second_moment_matrix,
    split_counts, kmeans_step, kmeans_lost_clusters, kmeans_train, tree_assign, tree_assign_joined, route_next,
)}
QUERIES |= {
    "to_dense": _entries(lambda v: V.dense(V.sparse(sparse_input(v)))),
    "remove_dims": _entries(lambda v: V.without(v, REMOVED)),
    "scale_dims": _entries(lambda v: V.scaled(v, SCALED)),
    "norm_l1": _entries(V.normalised_l1),
    "norm_l2": _entries(lambda v: V.normalised_l2(v, 2.0)),
    "norm_stddev": _entries(V.standardised),
    **{f"split_score_{k}": _score(m) for k, m in (("sc", "Sc"), ("mi", "MutualInformation"), ("entropy", "Entropy"))},
    **{f"best_threshold_{k}": _best(m) for k, m in (("sc", "Sc"), ("mi", "MutualInformation"), ("entropy", "Entropy"), ("balanced", "Balanced"), ("mean", "Mean"))},
}
