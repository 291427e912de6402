"""More of the reference's operators as queries over ``embeddings``, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sparse
from ..functions import vectors as V
from ..operators import codebook, kmeans, projection, search, trees, wide
from ..scratch import new_folder as scratch
from ..sources import envelope, queue, vector_file
from . import queries as Q
from .more import _envelopes, _values
from .more_oracles import BYTES, CELLS, _placed, drawn, lloyd
from .oracles import E, g, r6, some, total

K, VISITS = 5, 40
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- the kd-tree: words are the vectors with an even id, features those with an odd one


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = Q.embeddings(spark, sf_dir)
    words = rows.where("vec_id % 2 = 0").select(F.col("vec_id").cast("int").alias("word"), F.col("embedding").alias("center"))
    return rows.where("vec_id % 2 <> 0").select(F.col("vec_id").alias("feature_id"), F.col("embedding").alias("descriptor")), words


def knn_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = codebook.approximate_nearest(*_halves(spark, sf_dir), K, None)
    return codebook.long_form(near.drop("compared")).select("feature_id", "rank", "word", Q.r6(F.col("distance")).alias("distance"))


def knn_kd_tree_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each feature's K nearest words are found with VISITS words compared, and how many were."""
    features, words = _halves(spark, sf_dir)
    near = codebook.approximate_nearest(features, words, K, VISITS).withColumnRenamed("words", "near").drop("distances")
    found = codebook.nearest(near, words, K)
    return found.select("feature_id", F.size(F.array_intersect("near", "words")).alias("found"), "compared")


_distance = "list_sum(list_transform(list_transform(list_zip(f.embedding, w.embedding), lambda z: (z[1]-z[2])*(z[1]-z[2])), lambda v: v::DOUBLE))"
QUERIES |= {"knn_kd_tree": knn_kd_tree, "knn_kd_tree_limited": knn_kd_tree_limited}
ORACLES["knn_kd_tree"] = f"""SELECT feature_id, rank::INT AS rank, word, {r6('dist')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY dist, word) AS rank
FROM (SELECT f.vec_id AS feature_id, w.vec_id::INT AS word, {_distance} AS dist FROM {E} f JOIN {E} w ON f.vec_id % 2 <> 0 AND w.vec_id % 2 = 0)) WHERE rank <= {K}"""

# --- sparse vectors of dimension SPARSE: entry i of a vector at SPREAD * i + vec_id % 3

SPARSE, SPREAD, KEPT = 1_000_000, 15_013, 0.05


def _sparse(v: Column, key: Column, positive: bool) -> Column:
    entries = F.filter(F.transform(v, lambda x, i: F.struct((i * SPREAD + key % 3).cast("int").alias("id"), (F.abs(x) if positive else x).alias("x"))), lambda e: F.abs(e.x) >= F.lit(KEPT).cast("float"))
    return F.struct(F.lit(SPARSE).alias("dimension"), F.transform(entries, lambda e: e.id).alias("ids"), F.transform(entries, lambda e: e.x).alias("data"))


def _merge(f: Callable[[Column, Column], Column], positive: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = Q.pairs(spark, sf_dir).select("a_id", "b_id", _sparse(F.col("a"), F.col("a_id"), positive).alias("a"), _sparse(F.col("b"), F.col("b_id"), positive).alias("b"))
        return rows.select("a_id", "b_id", Q.r6(f(F.col("a"), F.col("b"))).alias("d"))

    return query


_entries = "SELECT vec_id, ((i - 1) * {s} + vec_id % 3)::INT AS id, {x} AS x FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM {e}) WHERE abs(v) >= {k}::FLOAT"


def _merge_sql(terms: str, result: str, positive: bool) -> str:
    """``terms``: of x, y; ``result``: of their list t in the order of ids."""
    entries = _entries.format(s=SPREAD, x="abs(v)" if positive else "v", e=E, k=KEPT)
    return f"""WITH e AS ({entries}), p AS (SELECT a.vec_id AS a_id, a.vec_id + 1 AS b_id FROM {E} a JOIN {E} b ON b.vec_id = a.vec_id + 1),
j AS (SELECT a_id, b_id, id, max(x) AS x, max(y) AS y FROM (SELECT a_id, b_id, id, x, NULL::FLOAT AS y FROM p JOIN e ON e.vec_id = a_id UNION ALL SELECT a_id, b_id, id, NULL::FLOAT, x FROM p JOIN e ON e.vec_id = b_id) GROUP BY ALL),
t AS (SELECT a_id, b_id, list({terms} ORDER BY id) AS t FROM (SELECT a_id, b_id, id, coalesce(x, 0::FLOAT) AS x, coalesce(y, 0::FLOAT) AS y FROM j) GROUP BY a_id, b_id)
SELECT a_id, b_id, {r6(result)} AS d FROM (SELECT a_id, b_id, coalesce(t, []::FLOAT[]) AS t FROM p LEFT JOIN t USING (a_id, b_id))"""


_per = "CASE WHEN x + y = 0 THEN 0::FLOAT ELSE ({} / (x + y))::FLOAT END"
for _name, _f, _positive, _terms, _result in (
    ("sparse_merge_l2sq", sparse.l2sq, False, "(x - y) * (x - y)", f"coalesce({total('t')}, 0)"),
    ("sparse_merge_l1", sparse.l1, False, "abs(x - y)", some(total("t", "FLOAT"))),
    ("sparse_merge_l2", sparse.l2, False, "(x - y) * (x - y)", some(f"sqrt({total('t', 'FLOAT')})::FLOAT")),
    ("sparse_merge_ln4", lambda a, b: sparse.ln(a, b, 4), False, "pow((x - y)::DOUBLE, 4)::FLOAT", some(f"pow({total('t', 'FLOAT')}::DOUBLE, 0.25)::FLOAT")),
    ("sparse_merge_x2", sparse.x2, True, _per.format("((x - y) * (x - y))"), some(total("t", "FLOAT"))),
    ("sparse_merge_dot", sparse.dot, False, "x * y", total("t", "FLOAT")),
    ("sparse_merge_intersection", sparse.intersection, True, _per.format("least(x, y)"), some(total("t", "FLOAT"))),
):
    QUERIES[_name], ORACLES[_name] = _merge(_f, _positive), _merge_sql(_terms, _result, _positive)

# --- the queue: the second half is published when the first has been taken, under names that sort before it


def queue_late_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    transport = queue.Transport(spark, f"{path}/broker", "features")
    coded = envelope.encode(_envelopes(spark, sf_dir)).withColumn("queue", F.lit("features"))
    for half, prefix in ((0, "b"), (1, "a")):
        transport.publish(coded.where(F.pmod(F.col("uuid").cast("bigint"), F.lit(2)) == half).withColumn("name", F.concat(F.lit(prefix), F.lpad("uuid", 20, "0"))))
        taken = envelope.decode(transport.incoming()).select("uuid", F.size("configuration").alias("steps"))
        taken.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("uuid string, steps int").parquet(f"{path}/out")


QUERIES["queue_late_messages"] = queue_late_messages
ORACLES["queue_late_messages"] = f"SELECT vec_id::VARCHAR AS uuid, (label % 4)::INT AS steps FROM {E}"

# --- what ranked search looks at


def search_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = Q.histograms(spark, sf_dir, 1).select(F.col("image_id").alias("id"), "word", "value")
    return search.work(base.where(F.col("id") % Q.QUERY_STEP == 0), base, "euclidean", 9.0, Q.TOP, 6)


QUERIES["search_work"] = search_work

# --- vector files: folders of ranges, one file written by all tasks, and the vectors of a table of ids

STEP = 7


def _written(spark: SparkSession, sf_dir: str, whole: bool) -> str:
    vector_file.register(spark)
    path = scratch(spark)
    vector = F.when(F.col("vec_id") % 2 == 0, V.sparse(Q.bytes_input(F.col("embedding")))).otherwise(V.vector(F.col("embedding")))
    write = vector_file.write_file if whole and vector_file.is_local(path) else vector_file.write
    write(Q.embeddings(spark, sf_dir).select("vec_id", vector.alias("vector")), path, 4)
    return path


def _vector_file(whole: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        back = spark.read.format("fvf").load(_written(spark, sf_dir, whole))
        return _values(back.select("vec_id", V.dense(F.col("vector")).alias("values")))

    return query


def vector_file_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the file of all vectors, every STEP-th in its place, the other places empty."""
    ids = Q.embeddings(spark, sf_dir).select((F.col("vec_id") * STEP).alias("vec_id"))
    rows = vector_file.selected(spark, _written(spark, sf_dir, True), ids)
    out = rows.select("vec_id", F.posexplode_outer(V.dense(F.col("vector"))).alias("dim", "val"))
    return out.select("vec_id", "dim", Q.r6(F.col("val")).alias("val"))


_held = _placed.format(f"CASE WHEN vec_id % 2 = 0 THEN {BYTES} ELSE embedding END")
QUERIES |= {"vector_file_ranges": _vector_file(False), "vector_file_one_file": _vector_file(True), "vector_file_selected": vector_file_selected}
ORACLES |= {k: CELLS.format(r6("val"), _held) for k in ("vector_file_ranges", "vector_file_one_file")}
ORACLES["vector_file_selected"] = f"""WITH h AS (SELECT * FROM {_held}) {CELLS.format(r6('val'), f'(SELECT * FROM h WHERE vec_id IN (SELECT vec_id * {STEP} FROM {E}))')}
UNION ALL SELECT vec_id, NULL::INT, NULL::DOUBLE FROM h WHERE vec_id NOT IN (SELECT vec_id * {STEP} FROM {E})"""

# --- random pairs, and the moments that a discriminative projection is made of

PAIRS, DRAW = 500, 11


def _pairs(same: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = Q.embeddings(spark, sf_dir).withColumn("own", F.col("vec_id"))
        return projection.random_pairs(rows, "own", "label", PAIRS, same, "vec_id", DRAW).select("pair", F.col("a").alias("a_id"), F.col("b").alias("b_id"))

    return query


def _moments(same: bool) -> Callable[[SparkSession, str], DataFrame]:
    """Second moments of the first four dimensions' differences."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = projection.random_pairs(Q.embeddings(spark, sf_dir), "embedding", "label", PAIRS, same, "vec_id", DRAW)
        d = pairs.select("pair", F.expr("transform(sequence(0, 3), i -> cast(a[i] as double) - cast(b[i] as double))").alias("d"))
        cells = d.select("pair", "d", F.posexplode("d").alias("i", "x")).select("i", "x", F.posexplode("d").alias("j", "y"))
        return cells.groupBy("i", "j").agg(Q.r6(F.avg(F.col("x") * F.col("y"))).alias("m"))

    return query


def _pairs_sql(same: bool) -> str:
    """p: pair, a, b (rows of embeddings)."""
    r = lambda of: f"('0x' || {drawn('pair', DRAW + of, 15)})::BIGINT"
    second = "start + (nth + 1 + r % (size - 1)) % size" if same else "(start + size + r % (total - size)) % total"
    return f"""WITH o AS (SELECT *, {drawn('vec_id', DRAW + 2)} AS draw, count(*) OVER (PARTITION BY label) AS size FROM {E} WHERE label IS NOT NULL),
g AS (SELECT *, row_number() OVER (ORDER BY substr(md5(label::VARCHAR), 1, 3), label, draw, vec_id) - 1 AS place, row_number() OVER (PARTITION BY label ORDER BY draw, vec_id) - 1 AS nth, count(*) OVER () AS total FROM o {'WHERE size > 1' if same else ''}),
w AS (SELECT *, place - nth AS start FROM g),
q AS (SELECT pair, {r(3)} AS f, {r(4)} AS r FROM range({PAIRS}) t(pair)),
x AS (SELECT pair, w.vec_id AS a_id, w.embedding AS a, {second} AS place FROM q JOIN w ON w.place = q.f % w.total {'' if same else 'WHERE size < total'}),
p AS (SELECT pair, a_id, w.vec_id AS b_id, a, w.embedding AS b FROM x JOIN w USING (place))"""


for _name, _same in (("same", True), ("two", False)):
    QUERIES |= {f"random_pairs_{_name}": _pairs(_same), f"pair_moments_{_name}": _moments(_same)}
    ORACLES[f"random_pairs_{_name}"] = f"{_pairs_sql(_same)} SELECT pair, a_id, b_id FROM p"
    ORACLES[f"pair_moments_{_name}"] = f"""{_pairs_sql(_same)} SELECT i::INT AS i, j::INT AS j, {r6('avg((a[i + 1]::DOUBLE - b[i + 1]::DOUBLE) * (a[j + 1]::DOUBLE - b[j + 1]::DOUBLE))')} AS m
FROM p, range(4) x(i), range(4) y(j) GROUP BY i, j"""

# --- growing trees: which of given tests each node takes, and how it scores, level by level

TRIES, LEVELS, DIMS = 4, 3, 64


def _given(kind: str) -> Callable[[int], list[dict]]:
    """The tests of the node with path p: a rule that SQL can follow."""

    def of(p: int) -> list[dict]:
        if kind == "TERC":
            return [{"dim1": (5 * p + 11 * t) % DIMS, "threshold": ((p + t) % 5 - 2) / 50} for t in range(TRIES)]
        if kind == "TCMP":
            return [{"dim1": (5 * p + 11 * t) % DIMS, "dim2": (3 * p + 7 * t + 1) % DIMS, "threshold": 0.0} for t in range(TRIES)]
        return [{"projection": [((7 * p + 13 * t + 29 * i) % 17 - 8) / 10 for i in range(DIMS)], "threshold": ((p + t) % 3 - 1) / 20} for t in range(TRIES)]

    return of


def _tree_tests(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = trees.chosen_tests(Q.embeddings(spark, sf_dir), kind, _given(kind), TRIES, LEVELS, column="embedding")
        rows = [tuple(n[c] for c in ("path", "test", "score", "left_rows", "right_rows")) for n in found]  # of the nodes
        return spark.createDataFrame(rows, "path int, test int, score double, left_rows bigint, right_rows bigint").withColumn("score", Q.r6(F.col("score")))

    return query


_at = "embedding[1 + (({}) % 64)]::DOUBLE"
_compared = {
    "TERC": (_at.format("5 * path + 11 * t"), "((path + t) % 5 - 2)::DOUBLE / 50"),
    "TCMP": (f"{_at.format('5 * path + 11 * t')} - {_at.format('3 * path + 7 * t + 1')}", "0::DOUBLE"),
    "TPC": ("list_sum(list_transform(range(64), lambda i: embedding[1 + i]::DOUBLE * (((7 * path + 13 * t + 29 * i) % 17 - 8)::DOUBLE / 10)))", "((path + t) % 3 - 1)::DOUBLE / 20"),
}


def _tree_tests_sql(kind: str) -> str:
    value, threshold = _compared[kind]
    parts = [f"a0 AS (SELECT vec_id, label, embedding, 1 AS path FROM {E} WHERE embedding IS NOT NULL AND label IS NOT NULL)"]
    for i in range(LEVELS):
        parts.append(f"""v{i} AS (SELECT path, t, label, vec_id, {value} <= {threshold} AS l FROM a{i}, range({TRIES}) x(t)),
c{i} AS (SELECT path, t, label, count(*) FILTER (l) AS l, count(*) FILTER (NOT l) AS r FROM v{i} GROUP BY path, t, label),
t{i} AS (SELECT *, sum(l) OVER (PARTITION BY path, t) AS nl, sum(r) OVER (PARTITION BY path, t) AS nr FROM c{i}),
s{i} AS (SELECT path, t, max(nl) AS nl, max(nr) AS nr, sum({g('(l + r)', '(nl + nr)')}) AS hc, sum({g('l', '(nl + nr)')} + {g('r', '(nl + nr)')}) AS hct, any_value({g('nl', '(nl + nr)')} + {g('nr', '(nl + nr)')}) AS ht FROM t{i} WHERE nl > 0 AND nr > 0 GROUP BY path, t),
b{i} AS (SELECT path, t, nl, nr, 2 * (hc + ht - hct) / (hc + ht) AS score FROM s{i} WHERE 2 * (hc + ht - hct) / (hc + ht) > 1e-6 QUALIFY row_number() OVER (PARTITION BY path ORDER BY 2 * (hc + ht - hct) / (hc + ht) DESC, t) = 1),
a{i + 1} AS (SELECT a.vec_id, a.label, a.embedding, (2 * a.path + (NOT v.l)::INT)::INT AS path FROM a{i} a JOIN b{i} b ON a.path = b.path JOIN v{i} v ON v.vec_id = a.vec_id AND v.path = b.path AND v.t = b.t)""")
    chosen = " UNION ALL ".join(f"SELECT path, t::INT AS test, {r6('score')} AS score, nl::BIGINT AS left_rows, nr::BIGINT AS right_rows FROM b{i}" for i in range(LEVELS))
    return f"WITH {', '.join(parts)} {chosen}"


for _kind in trees.KINDS:
    QUERIES[f"tree_tests_{_kind.lower()}"], ORACLES[f"tree_tests_{_kind.lower()}"] = _tree_tests(_kind), _tree_tests_sql(_kind)

# --- principal directions by the randomised range finder: dimension i of the embeddings times FALL ** i, so that variances fall

COMPONENTS, FALL, SQUARINGS = 3, 0.9, 12


def pca_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    falling = F.transform("embedding", lambda x, i: x.cast("double") * F.pow(F.lit(FALL), i.cast("double")))
    rows, variances = wide.pca(Q.embeddings(spark, sf_dir).select(falling.alias("v")), "v", COMPONENTS, steps=12)
    found = [(c, d, float(w), float(variances[c])) for c, row in enumerate(rows) for d, w in enumerate(row)]  # components x dimensions
    return spark.createDataFrame(found, "component int, dim int, weight double, variance double").select("component", "dim", Q.r6(F.col("weight")).alias("weight"), Q.r6(F.col("variance")).alias("variance"))


def _directions_sql() -> str:
    """Powers of the covariance by squaring, which leave the projector on its first direction; what that explains is taken
    off for the next one."""
    parts = [
        f"e AS MATERIALIZED (SELECT vec_id, i::INT AS i, x::DOUBLE * pow({FALL}::DOUBLE, i) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM {E}))",
        "m AS MATERIALIZED (SELECT i, avg(x) AS mean FROM e GROUP BY i)",
        "d AS MATERIALIZED (SELECT vec_id, i, x - mean AS x FROM e JOIN m USING (i))",
        "c0 AS MATERIALIZED (SELECT a.i, b.i AS j, avg(a.x * b.x) AS c FROM d a JOIN d b USING (vec_id) GROUP BY a.i, b.i)",
    ]
    for k in range(COMPONENTS):
        parts.append(f"p{k}_0 AS MATERIALIZED (SELECT i, j, c / (SELECT sum(c) FROM c{k} WHERE i = j) AS c FROM c{k})")
        for s in range(SQUARINGS):
            parts.append(f"s{k}_{s} AS MATERIALIZED (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM p{k}_{s} a JOIN p{k}_{s} b ON a.j = b.i GROUP BY a.i, b.j)")
            parts.append(f"p{k}_{s + 1} AS MATERIALIZED (SELECT i, j, c / (SELECT sum(c) FROM s{k}_{s} WHERE i = j) AS c FROM s{k}_{s})")
        last = f"p{k}_{SQUARINGS}"
        parts.append(f"w{k} AS MATERIALIZED (SELECT j AS i, c / sqrt(top) AS w FROM {last} JOIN (SELECT i, c AS top FROM {last} WHERE i = j ORDER BY c DESC, i LIMIT 1) USING (i))")
        parts.append(f"l{k} AS MATERIALIZED (SELECT sum(a.w * c * b.w) AS l FROM c{k} c JOIN w{k} a ON a.i = c.i JOIN w{k} b ON b.i = c.j)")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c.i, c.j, c - l * a.w * b.w AS c FROM c{k} c JOIN w{k} a ON a.i = c.i JOIN w{k} b ON b.i = c.j, l{k})")
    chosen = " UNION ALL ".join(f"SELECT {k} AS component, i AS dim, {r6('w')} AS weight, {r6('l')} AS variance FROM w{k}, l{k}" for k in range(COMPONENTS))
    return f"WITH {', '.join(parts)} {chosen}"


QUERIES["pca_directions"], ORACLES["pca_directions"] = pca_directions, _directions_sql()

# --- k-means whose rows keep distance bounds between steps: the same words, most distances skipped

BOUND_WORDS, BOUND_STEPS = 16, 3


def kmeans_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kmeans.trained(Q.features(spark, sf_dir), BOUND_WORDS, BOUND_STEPS, bounded=True)
    return out.select("word", F.posexplode("center").alias("dim", "c")).select("word", "dim", (F.round(F.col("c").cast("double"), 3) + F.lit(0.0)).alias("c"))


def kmeans_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each of six steps with 32 words: distances computed, and rows times words."""
    work: list = []
    kmeans.trained(Q.features(spark, sf_dir), 32, 6, bounded=True, work=work)
    return spark.createDataFrame([(i, *w) for i, w in enumerate(work)], "step int, compared bigint, possible bigint")


QUERIES |= {"kmeans_bounded": kmeans_bounded, "kmeans_work": kmeans_work}
ORACLES["kmeans_bounded"] = lloyd(BOUND_WORDS, BOUND_STEPS, f"{drawn('feature_id', 1)}, feature_id")
