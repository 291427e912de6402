"""Further queries over ``embeddings``, each over its whole table: formats there and back, samples, trees of all kinds,
criteria, covariance, streams. The bindings are those of ``visbag.plans.queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import distance as D
from ..functions import vectors as V
from ..operators import bow, codebook, information, kmeans, projection, search, statistics, trees
from ..schema import ENVELOPE, HEADER
from ..scratch import new_folder as scratch
from ..sources import envelope, queue, text_files, vector_file
from ..streaming import pipeline
from . import queries as Q

DRAWN, SEED, CLASSES, RANGE = 50, 7, 3, 40
NAMES = ("L1", "L2", "STDDEV")


# --- statistics, samples, pairs


def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.centred(Q.embeddings(spark, sf_dir), "embedding").select("i", "j", Q.r6(F.col("c")).alias("c"))


def change_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by the whole codebook and by its even half."""
    words, rows = Q.book(spark, sf_dir), Q.features(spark, sf_dir)
    half = words.where("word % 2 = 0")
    return kmeans.changed(codebook.nearest_word(rows, words), codebook.nearest_word(rows, half)).select(Q.r6(F.col("changed")).alias("changed"))


def sample_without_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.seeded_sample(Q.features(spark, sf_dir), DRAWN, "feature_id", SEED).select("feature_id")


def sample_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.sample_with_replacement(Q.features(spark, sf_dir), 10 * DRAWN, "feature_id", SEED).select("draw", "feature_id")


def label_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.label_subset(Q.embeddings(spark, sf_dir), "label", CLASSES, SEED).select("vec_id", "label")


def _pairs(spark: SparkSession, sf_dir: str, same: bool) -> DataFrame:
    rows = Q.embeddings(spark, sf_dir)
    found = projection.neighbour_pairs(rows.select("vec_id", "label", F.array("vec_id").alias("own")), "own", "label", same, key="vec_id", seed=SEED)
    return found.select(F.col("a")[0].alias("a_id"), F.col("b")[0].alias("b_id"))


def pairs_same_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, True)


def pairs_two_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, False)


def roulette_wheel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector draws one of the projections, by their means (negative ones read as 0)."""
    wheel = statistics.projected_stats(Q._projected(spark, sf_dir)).select(F.col("component").alias("id"), F.round("mean", 9).alias("value"))
    draws = Q.embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), (F.pmod(F.col("vec_id") * 7919, F.lit(1000)) / 1000.0).alias("u"))
    return information.roulette(draws, wheel, 3).select(F.col("id").alias("vec_id"), "choice")


def split_score_sc_with_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return information.evaluated(Q.samples(spark, sf_dir), Q.zero_thresholds(spark), "ScWithError").select("node", Q.r6(F.col("score")).alias("score"))


def best_threshold_sc_with_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = information.best_threshold(Q.samples(spark, sf_dir), "ScWithError")
    return out.select("node", Q.r6(F.col("threshold")).alias("threshold"), Q.r6(F.col("score")).alias("score"))


def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variances along all principal directions add up to those along the dimensions."""
    _, values = projection.pca(Q.embeddings(spark, sf_dir), "embedding", 64)
    return spark.createDataFrame([(float(values.sum()), bool((values[:-1] >= values[1:]).all()))], "total double, falling boolean").select(Q.r6(F.col("total")).alias("total"), "falling")


def project_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection of ``project_linear`` as a matrix product a batch."""
    import numpy as np

    rows = projection.applied(Q.embeddings(spark, sf_dir).select("vec_id", "embedding"), np.array(Q.WEIGHTS), "embedding")
    return rows.select("vec_id", F.posexplode("embedding").alias("component", "p")).select("vec_id", "component", F.round(F.col("p").cast("double"), 4).alias("p") + F.lit(0.0)).toDF("vec_id", "component", "p")


def knn_by_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest words by built-in expressions alone."""
    out = codebook.nearest_join(Q.features(spark, sf_dir), Q.book(spark, sf_dir), 3)
    return out.select("feature_id", "rank", "word", Q.r6(F.col("distance")).alias("distance"))


def base_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the histograms, as thousandths, through a base file."""
    path = scratch(spark)
    terms = Q.histograms(spark, sf_dir, 1).select(F.concat(F.lit("image"), F.col("image_id").cast("string")).alias("name"), "word", F.floor(F.round("value", 6) * 1000).cast("long").alias("value"))
    text_files.write_base(terms, path)
    return text_files.read_base(spark, path).select("name", "word", Q.r6(F.col("value")).alias("value"))


# --- vectors and distances


def sparse_l2sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distance of sparse vectors, by their ids."""
    both = D.l2sq(V.dense(V.sparse(Q.sparse_input(F.col("a")))), V.dense(V.sparse(Q.sparse_input(F.col("b")))))
    return Q.pairs(spark, sf_dir).select("a_id", "b_id", Q.r6(both).alias("d"))


def kernel_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel that a name tells: one of four for each pair, by its first id."""
    a, b = Q.positive(F.col("a")), Q.positive(F.col("b"))
    chosen = F.element_at(F.array(*(D.KERNELS[n](a, b).cast("double") for n in sorted(D.KERNELS))), F.pmod(F.col("a_id"), F.lit(4)).cast("int") + 1)
    return Q.pairs(spark, sf_dir).select("a_id", "b_id", Q.r6(chosen).alias("d"))


def norm_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalisation that a name tells: one of three for each vector."""
    v = F.col("embedding")
    chosen = F.element_at(F.array(*(V.normalised(v, n) for n in NAMES)), F.pmod(F.col("vec_id"), F.lit(3)).cast("int") + 1)
    rows = Q.embeddings(spark, sf_dir).select("vec_id", F.posexplode(chosen).alias("dim", "val"))
    return rows.select("vec_id", "dim", Q.r6(F.col("val")).alias("val"))


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors constructed dense and sparse: their dimension, and how many ids and values they hold."""
    rows = Q.embeddings(spark, sf_dir)
    dense, sparse = V.vector(F.col("embedding")), V.sparse(Q.sparse_input(F.col("embedding")))
    return rows.select("vec_id", dense.dimension.alias("dimension"), dense.ids.isNull().alias("dense"), F.size(dense.data).alias("n"), F.size(sparse.ids).alias("sparse_n"))


# --- assignment, search


def word_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of the words up to RANGE."""
    out = bow.histogram(bow.long_form(Q.soft(spark, sf_dir)), RANGE)
    return out.select("image_id", "word", Q.r6(F.col("value")).alias("value"))


def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lists with the items' names."""
    names = Q.features(spark, sf_dir).select(F.col("image_id").alias("item_id"), F.concat(F.lit("image"), F.col("image_id").cast("string")).alias("name")).distinct()
    lists = search.result_lists(Q._search(spark, sf_dir, "reference", 1), names)
    return lists.select("query_id", F.explode("result").alias("r")).select("query_id", "r.rank", "r.url")


# --- formats there and back


def _values(rows: DataFrame) -> DataFrame:
    """vec_id, dim, val of vec_id and an array ``values``."""
    return rows.select("vec_id", F.posexplode("values").alias("dim", "val")).select("vec_id", "dim", Q.r6(F.col("val")).alias("val"))


def blob_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten vectors a blob, and back by their rows."""
    rows = Q.embeddings(spark, sf_dir).select(F.expr("cast(vec_id div 10 as string)").alias("uuid"), "vec_id", F.col("embedding").alias("values"))
    blobs = envelope.blobs(rows, "uuid", "vec_id", "values")
    first = rows.groupBy("uuid").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    back = envelope.matrix_rows(blobs, "blob", "uuid").join(first, "uuid")
    return _values(back.select(F.get("ids", F.col("row")).alias("vec_id"), "values"))


def header_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six values named, and how many are left."""
    rows = envelope.header_and_descriptor(Q.embeddings(spark, sf_dir).select("vec_id", F.col("embedding").alias("values")))
    return rows.select("vec_id", *(Q.r6(F.col(c)).alias(c) for c in HEADER), F.size("descriptor").alias("n"))


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.envelopes(spark, sf_dir)
    return rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ENVELOPE.fields))


def envelope_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes as bytes of the wire format, and back; one in five has its bytes cut."""
    coded = envelope.encode(_envelopes(spark, sf_dir))
    cut = F.when(F.pmod(F.col("uuid").cast("bigint"), F.lit(5)) == 0, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    back = envelope.decode(coded.select(cut.alias("value")))
    return back.where("not malformed").select("uuid", F.size("configuration").alias("steps"), "returnQueue")


def malformed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = envelope.encode(_envelopes(spark, sf_dir)).select(F.expr("case when cast(uuid as bigint) % 4 = 1 then substring(value, 1, length(value) - 1) else value end as value"))
    return envelope.decode(coded).groupBy("malformed").agg(F.count("*").alias("n"))


def dead_letter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.envelopes(spark, sf_dir).withColumn("returnQueue", F.when(F.pmod(F.col("uuid").cast("bigint"), F.lit(3)) > 0, F.col("returnQueue")))
    alive, dead = pipeline.dead_letters(rows)
    return alive.select("uuid", F.lit(False).alias("dead")).unionByName(dead.select("uuid", F.lit(True).alias("dead")))


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipeline.failed(Q.envelopes(spark, sf_dir), F.pmod(F.col("uuid").cast("bigint"), F.lit(6)) == 0, "no features")
    return rows.select("uuid", "errorCode", F.coalesce(F.array_join("message", ","), F.lit("")).alias("messages"))


def vector_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors into one file, whole bytes where they fit, and back; places are ranks of vec_id."""
    vector_file.register(spark)
    path = scratch(spark)
    rows = Q.embeddings(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 2 == 0, V.sparse(Q.bytes_input(F.col("embedding")))).otherwise(V.vector(F.col("embedding"))).alias("vector"))
    rows.write.format("fvf").mode("append").save(path)
    back = spark.read.format("fvf").load(path)
    return _values(back.select("vec_id", V.dense(F.col("vector")).alias("values")))


def vector_file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the file of all vectors, those in the places 3, 4, 5 and 200 and the place 7."""
    vector_file.register(spark)
    path = scratch(spark)
    Q.embeddings(spark, sf_dir).select("vec_id", V.vector(F.col("embedding")).alias("vector")).write.format("fvf").mode("append").save(path)
    some = spark.read.format("fvf").load(path).where("vec_id in (3, 4, 5, 200)").unionByName(vector_file.looked_up(spark, path, 7, check=True))
    return _values(some.select("vec_id", V.dense(F.col("vector")).alias("values")))


def codebook_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    rows = sorted(Q.book(spark, sf_dir).collect(), key=lambda r: r.word)
    path = scratch(spark)
    text_files.write_codebook(text_files.Codebook(np.array([r.center for r in rows])), path, spark)
    back = text_files.read_codebook(spark, path)
    out = back.frame(spark).select("word", F.posexplode("center").alias("dim", "val"), F.lit(float(back.average)).alias("average"))
    return out.select("word", "dim", Q.r6(F.col("val")).alias("val"), Q.r6(F.col("average")).alias("average"))


# --- trees

TCMP_TREE = [(0, 0, 1, 1, 2), (1, 2, 3, None, None), (2, 4, 5, None, 3), (3, 6, 7, None, None)]  # node, dim1, dim2, left, right
TPC_TREE = [(0, 0, 0.0, 0.3, 1, 2), (1, 1, 0.05, 0.2, None, None), (2, 2, -0.05, 0.4, None, None)]  # node, weights, threshold, deviation, left, right


def _node(node: int, left: int | None, right: int | None, **more) -> dict:
    return {"tree": 0, "node": node, "left_node": left, "right_node": right, "left_word": None, "right_word": None, "dim1": None, "dim2": None, "threshold": None, "deviation": None, "projection": None} | more


def tcmp_tree() -> list[dict]:
    return trees.assign_words([_node(n, left, right, dim1=a, dim2=b) for n, a, b, left, right in TCMP_TREE])


def tpc_tree() -> list[dict]:
    return trees.assign_words([_node(n, left, right, projection=Q.WEIGHTS[w], threshold=t, deviation=d) for n, w, t, d, left, right in TPC_TREE])


def _words(spark: SparkSession, sf_dir: str, nodes: list[dict], kind: str) -> DataFrame:
    out = trees.words(Q.embeddings(spark, sf_dir).select("vec_id", "embedding"), nodes, kind, "embedding")
    return out.select("vec_id", F.col("tree_words")[0].alias("word"))


def tree_assign_tcmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, tcmp_tree(), "TCMP")


def tree_assign_tpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, tpc_tree(), "TPC")


def tree_soft_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected weights of the leaves of the projection tree."""
    rows = Q.embeddings(spark, sf_dir).select("vec_id", "embedding")
    out = trees.soft_words(rows, tpc_tree(), 1, "embedding", "vec_id", None)
    return out.select("vec_id", F.explode("word_weights").alias("w")).select("vec_id", "w.word", F.round("w.weight", 5).alias("weight"))


def normal_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail table at ten times each vector's first value."""
    table = F.array(*(F.lit(float(x)) for x in trees._tail_table()))
    at = F.floor(F.abs(F.col("embedding")[0].cast("double") * 10) / trees.MOST * (trees.BINS - 1) + 0.5).cast("int")
    return Q.embeddings(spark, sf_dir).select("vec_id", F.round(F.coalesce(F.get(table, at), F.lit(0.0)), 5).alias("tail"))


def forest_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of trees of each kind, written and read again."""
    out = None
    for kind, nodes in (("TERC", Q.literal_tree()), ("TCMP", tcmp_tree()), ("TPC", tpc_tree())):
        path = scratch(spark)
        text_files.write_forest(kind, trees.frame(spark, nodes), path)
        read, back = text_files.read_forest(spark, path)
        found = _words(spark, sf_dir, [r.asDict() for r in back.collect()], read).select("vec_id", F.lit(read).alias("kind"), "word")
        out = found if out is None else out.unionByName(found)
    return out


# --- training, streams


def kmeans_from_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps from the first eight features; centers to three digits."""
    rows = Q.features(spark, sf_dir)
    out = kmeans.trained(rows, 8, 2, start=kmeans.initial_words(rows, 8, first=True))
    return out.select("word", F.posexplode("center").alias("dim", "c")).select("word", "dim", (F.round(F.col("c").cast("double"), 3) + F.lit(0.0)).alias("c"))


def dummy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed test matrix, as many rows as there are images."""
    n = Q.features(spark, sf_dir).select("image_id").distinct().count()
    return envelope.dummy_features(spark, n, 50).select("row", F.posexplode("values").alias("col", "v")).select("row", "col", F.round(F.col("v").cast("double"), 1).alias("v"))


def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelopes as files of JSON, read as a stream, routed, and written by next queue."""
    path = scratch(spark)
    _envelopes(spark, sf_dir).write.json(f"{path}/in")
    query = pipeline.start(pipeline.read(spark, f"{path}/in"), [lambda rows: rows], f"{path}/out", f"{path}/dead", f"{path}/state", once=True)
    query.awaitTermination()
    done = spark.read.schema(StructType([*ENVELOPE.fields, StructField("next_queue", StringType())])).json(f"{path}/out")
    return done.select("uuid", "next_queue", "errorCode", F.size("configuration").alias("left_over"))


def queue_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelopes published to a queue and its return queue, and the first taken from there as a stream."""
    path = scratch(spark)
    transport = queue.Transport(spark, f"{path}/broker", "features")
    coded = envelope.encode(_envelopes(spark, sf_dir))
    transport.publish(coded.withColumn("queue", F.when(F.pmod(F.col("uuid").cast("bigint"), F.lit(3)) == 0, F.lit("back")).otherwise(F.lit("features"))))
    taken = envelope.decode(transport.incoming()).select("uuid", F.size("configuration").alias("steps"))
    taken.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("uuid string, steps int").parquet(f"{path}/out")


QUERIES = {f.__name__: f for f in (
    covariance_matrix, pca_variance, project_batches, knn_by_expressions, base_file_round_trip, change_ratio, sample_without_replacement, sample_with_replacement, label_subset, pairs_same_class, pairs_two_classes, roulette_wheel, split_score_sc_with_error, best_threshold_sc_with_error,
    sparse_l2sq, kernel_by_name, norm_by_name, vector_rows, word_range, search_names, blob_round_trip, header_split, envelope_round_trip, malformed_messages, dead_letter_split, message_log, vector_file_round_trip, vector_file_lookup,
    codebook_file_round_trip, tree_assign_tcmp, tree_assign_tpc, tree_soft_words, normal_tail, forest_file_round_trip, kmeans_from_first, dummy_features, stream_route, queue_round_trip,
)}
