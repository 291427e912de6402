"""The queries of ``visbag.plans.queries`` in DuckDB SQL, over the same tables."""

from __future__ import annotations

from .queries import CUT, K, PER_IMAGE, QUERY_STEP, REMOVED, SCALED, TOP, TREE, WEIGHTS, WORDS


def r6(x: str) -> str:
    return f"round(({x})::DOUBLE, 6) + 0.0"


E = "(SELECT * FROM embeddings WHERE vec_id IS NOT NULL)"
PAIRS = f"p AS (SELECT a.vec_id AS a_id, a.vec_id + 1 AS b_id, a.embedding AS a, b.embedding AS b FROM {E} a JOIN {E} b ON b.vec_id = a.vec_id + 1)"


def zipped(term: str, positive: bool = False) -> str:
    a, b = ("list_transform(a, lambda x: abs(x))", "list_transform(b, lambda x: abs(x))") if positive else ("a", "b")
    return f"list_transform(list_zip({a}, {b}), lambda z: {term})"


def total(x: str, kind: str = "DOUBLE") -> str:
    return f"list_reduce({x}, lambda s, v: s + v, 0::{kind})" if kind == "FLOAT" else f"list_sum(list_transform({x}, lambda v: v::DOUBLE))"


def some(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 1e-30 ELSE {x} END"


def bounded(x: str, most: float) -> str:
    return f"CASE WHEN {x} > {most} THEN {most + 1} ELSE {x} END"


L2 = total(zipped("(z[1]-z[2])*(z[1]-z[2])"))
L1 = total(zipped("abs(z[1]-z[2])"))
LR = total(zipped("pow(abs(z[1]-z[2])::DOUBLE, 3)"))
X2 = total(zipped("((z[1]-z[2])*(z[1]-z[2]))::DOUBLE / (z[1]+z[2])::DOUBLE", True))
PER = "CASE WHEN z[1]+z[2] = 0 THEN 0::FLOAT ELSE ({} / (z[1]+z[2]))::FLOAT END"
DISTANCES = {
    "dist_l2sq": L2,
    "dist_l2sq_bounded": bounded(L2, 2.0),
    "dist_l1_raw": L1,
    "dist_l1_bounded": bounded(L1, 9.0),
    "dist_lr": LR,
    "dist_lr_bounded": bounded(LR, 0.5),
    "dist_x2_raw": X2,
    "dist_x2_bounded": bounded(X2, 3.0),
    "dist_l1": some(total(zipped("abs(z[1]-z[2])"), "FLOAT")),
    "dist_l2": some(f"sqrt({total(zipped('(z[1]-z[2])*(z[1]-z[2])'), 'FLOAT')})::FLOAT"),
    "dist_ln4": some(f"pow({total(zipped('pow((z[1]-z[2])::DOUBLE, 4)::FLOAT'), 'FLOAT')}::DOUBLE, 0.25)::FLOAT"),
    "dist_x2": some(total(zipped(PER.format("((z[1]-z[2])*(z[1]-z[2]))"), True), "FLOAT")),
    "dot": total(zipped("z[1]*z[2]"), "FLOAT"),
    "hist_intersection": some(total(zipped(PER.format("least(z[1], z[2])"), True), "FLOAT")),
}
ORACLES = {name: f"WITH {PAIRS} SELECT a_id, b_id, {r6(x)} AS d FROM p" for name, x in DISTANCES.items()}

BOOK = f"""cells AS (SELECT (vec_id % {WORDS})::INT AS word, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM {E}),
cb AS (SELECT word, list(m ORDER BY dim) AS center FROM (SELECT word, dim, round(avg(v::DOUBLE), 6)::FLOAT AS m FROM cells GROUP BY ALL) GROUP BY word)"""
FEATURES = f"f AS (SELECT vec_id // {PER_IMAGE} AS image_id, vec_id AS feature_id, embedding AS d FROM {E})"
NEAR = "near AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY dist, word) AS rank FROM (SELECT feature_id, image_id, word, list_sum(list_transform(list_transform(list_zip(d, center), lambda z: (z[1]-z[2])*(z[1]-z[2])), lambda v: v::DOUBLE)) AS dist FROM f, cb))"
SIGMA = "sg AS (SELECT avg(m) AS s FROM (SELECT a.word, min(list_sum(list_transform(list_transform(list_zip(a.center, b.center), lambda z: (z[1]-z[2])*(z[1]-z[2])), lambda v: v::DOUBLE))) AS m FROM cb a JOIN cb b ON a.word <> b.word GROUP BY a.word))"


def soft(k: int) -> str:
    return f"""WITH {BOOK}, {FEATURES}, {NEAR}, {SIGMA},
wt AS (SELECT near.*, exp(-dist * dist / greatest(1e-30, 2 * s * s)) AS w FROM near, sg WHERE rank <= {k}),
nw AS (SELECT image_id, feature_id, rank, word + 1 AS word, w / greatest(sum(w) OVER (PARTITION BY feature_id), 1e-30) AS weight FROM wt),
h AS (SELECT image_id, word, sum(weight) AS value FROM nw GROUP BY ALL)"""


def ranking(mode: str, k: int) -> str:
    score = "max_by(abs(q.value - b.value), b.word)" if mode == "reference" else "sqrt(sum((q.value - b.value) * (q.value - b.value)))"
    return soft(k) + f""", hh AS (SELECT * FROM h WHERE value <> 0), q AS (SELECT * FROM hh WHERE image_id % {QUERY_STEP} = 0),
m AS (SELECT q.image_id AS query_id, b.image_id AS item_id, {score} AS score FROM q JOIN hh b ON q.word = b.word GROUP BY ALL),
ids AS (SELECT DISTINCT image_id FROM h),
sc AS (SELECT a.image_id AS query_id, b.image_id AS item_id, round(coalesce(score, {0.0 if mode == 'reference' else 9.0}), 6) + 0.0 AS score FROM ids a CROSS JOIN ids b LEFT JOIN m ON m.query_id = a.image_id AND m.item_id = b.image_id WHERE a.image_id % {QUERY_STEP} = 0),
rk AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id)::INT AS rank, item_id, score FROM sc QUALIFY rank <= {TOP})"""


ORACLES |= {
    "nn1_assign": f"WITH {BOOK}, {FEATURES}, {NEAR} SELECT feature_id, word, {r6('dist')} AS distance FROM near WHERE rank = 1",
    "knn_assign": f"WITH {BOOK}, {FEATURES}, {NEAR} SELECT feature_id, rank::INT AS rank, word, {r6('dist')} AS distance FROM near WHERE rank <= {K}",
    "avg_word_distance": f"WITH {BOOK}, {SIGMA} SELECT {r6('s')} AS avg_word_distance FROM sg",
    "soft_assign": soft(K) + f" SELECT feature_id, rank::INT AS rank, word, {r6('weight')} AS weight FROM nw",
    "bow_histogram": soft(K) + f" SELECT image_id, word, {r6('value')} AS value FROM h",
    "search_reference": ranking("reference", K) + " SELECT * FROM rk",
    "search_euclidean": ranking("euclidean", 1) + " SELECT * FROM rk",
    "search_no_overlap": ranking("reference", 1) + " SELECT * FROM rk",
    "search_result_list": ranking("reference", K) + " SELECT query_id, rank, 'http://foo/' || item_id AS url, round(score::FLOAT::DOUBLE, 4) AS score FROM rk",
    "url_build": f"WITH {FEATURES} SELECT DISTINCT image_id, 'http://foo/image' || image_id AS url FROM f",
    "base_parse": soft(K) + " SELECT 'image' || image_id AS name, word, floor(round(value, 6) * 1000)::DOUBLE AS value FROM h",
}

THIN = f"list_transform(embedding, lambda x: CASE WHEN abs(x::DOUBLE) < {CUT} THEN 0::FLOAT ELSE x END)"
BYTES = "list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 100)::FLOAT)"


def entries(values: str, where: str = "true") -> str:
    """vec_id, dim and val of an array built from e.embedding."""
    return f"SELECT vec_id, dim::INT AS dim, {r6('val')} AS val FROM (SELECT vec_id, unnest(x) AS val, generate_subscripts(x, 1) - 1 AS dim FROM (SELECT vec_id, {values} AS x FROM {E})) WHERE {where}"


_scales: dict[int, float] = {}
for _d, _s in SCALED:
    _scales[_d] = _scales.get(_d, 1.0) * _s
_factor = " ".join(f"WHEN {d} THEN {s}" for d, s in _scales.items())
L1_NORM, L2_NORM = "list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE)))", "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_kinds = " UNION ALL ".join(f"SELECT vec_id, '{k}' AS kind, {v} AS v FROM {E}" for k, v in (("float", "embedding"), ("thin", THIN), ("bytes", BYTES)))
_flat = f"flat AS (SELECT vec_id, unnest(embedding) AS val, generate_subscripts(embedding, 1) - 1 AS dim, label FROM {E})"
ORACLES |= {
    "to_sparse": f"SELECT vec_id, 64 AS dimension, dim, val FROM ({entries(THIN)}) WHERE val <> 0",
    "to_dense": entries(THIN),
    "optimize_encoding": f"WITH k AS ({_kinds}), c AS (SELECT vec_id, kind, len(list_filter(v, lambda x: NOT (x >= 0 AND x <= 255 AND x = floor(x)))) = 0 AS is_u8, len(v) AS n, len(list_filter(v, lambda x: x <> 0)) AS nz FROM k) SELECT vec_id, kind, is_u8, (n * CASE WHEN is_u8 THEN 1 ELSE 4 END)::INT AS dense_bytes, (nz * (CASE WHEN is_u8 THEN 1 ELSE 4 END + 4))::INT AS sparse_bytes, n * CASE WHEN is_u8 THEN 1 ELSE 4 END > nz * (CASE WHEN is_u8 THEN 1 ELSE 4 END + 4) AS is_sparse FROM c",
    "concat_sparse": f"WITH {PAIRS}, c AS (SELECT a_id, list_concat({THIN.replace('embedding', 'a')}, {THIN.replace('embedding', 'b')}) AS x FROM p), u AS (SELECT a_id, unnest(x) AS val, generate_subscripts(x, 1) - 1 AS dim FROM c) SELECT a_id, dim::INT AS dim, {r6('val')} AS val FROM u WHERE val <> 0",
    "concat_dense": f"WITH {PAIRS}, c AS (SELECT a_id, list_concat(a, b) AS x FROM p), u AS (SELECT a_id, unnest(x) AS val, generate_subscripts(x, 1) - 1 AS dim FROM c) SELECT a_id, dim::INT AS dim, {r6('val')} AS val FROM u",
    "nan_repair": f"SELECT vec_id, dim, CASE WHEN (vec_id + dim) % 17 = 0 THEN round(0.9::FLOAT::DOUBLE, 6) ELSE val END AS val FROM ({entries('embedding')})",
    "remove_dims": f"SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY dim) - 1)::INT AS dim, val FROM ({entries('embedding')}) WHERE dim NOT IN ({', '.join(map(str, REMOVED))})",
    "scale_dims": f"WITH {_flat} SELECT vec_id, dim::INT AS dim, {r6(f'(val::DOUBLE * CASE dim {_factor} ELSE 1.0 END)::FLOAT')} AS val FROM flat",
    "norm_l1": entries(f"list_transform(embedding, lambda x: (x::DOUBLE / {L1_NORM})::FLOAT)"),
    "norm_l2": entries(f"list_transform(embedding, lambda x: (x::DOUBLE * 2.0 / {L2_NORM})::FLOAT)"),
    "norm_stddev": f"WITH {_flat}, m AS (SELECT vec_id, avg(val::DOUBLE) AS m, avg(val::DOUBLE * val::DOUBLE) AS q FROM flat GROUP BY vec_id) SELECT vec_id, dim::INT AS dim, {r6('((val::DOUBLE - m) / sqrt(q - m * m))::FLOAT')} AS val FROM flat JOIN m USING (vec_id)",
    "dim_stats": f"WITH {_flat} SELECT dim::INT AS dim, {r6('avg(val::DOUBLE)')} AS mean, {r6('stddev_pop(val::DOUBLE)')} AS deviation FROM flat GROUP BY dim",
    "class_counts": f"SELECT label, count(*) AS n FROM {E} GROUP BY label",
    "second_moment_matrix": f"WITH {_flat} SELECT a.dim::INT AS i, b.dim::INT AS j, {r6('avg(a.val::DOUBLE * b.val::DOUBLE)')} AS m FROM flat a JOIN flat b USING (vec_id) GROUP BY ALL",
    "split_counts": f"WITH {_flat} SELECT dim AS node, label, count(*) FILTER (val <= 0) AS \"left\", count(*) FILTER (val > 0) AS \"right\" FROM flat GROUP BY ALL",
}
PROJECTED = f"w AS (SELECT * FROM (VALUES {', '.join(f'({i}, {w})' for i, w in enumerate(WEIGHTS))}) t(component, weights)), pr AS (SELECT vec_id, label, component, list_sum(list_transform(list_zip(weights, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS p FROM {E}, w)"
ORACLES |= {
    "project_linear": f"WITH {PROJECTED} SELECT vec_id, component, {r6('p')} AS p FROM pr",
    "projected_stats": f"WITH {PROJECTED} SELECT component, {r6('stddev_pop(p)')} AS deviation, {r6('avg(abs(p))')} AS mean_abs, {r6('avg(p)')} AS mean FROM pr GROUP BY component",
    "class_projected_std": f"WITH {PROJECTED}, c AS (SELECT label, sqrt(greatest(var_pop(p), 1e-10)) AS d FROM pr WHERE component = 0 GROUP BY label) SELECT {r6('avg(d)')} AS class_deviation FROM c",
}


def g(count: str, n: str) -> str:
    return f"(CASE WHEN {count} > 0 THEN -({count} / {n}::DOUBLE) * log2({count} / {n}::DOUBLE) ELSE 0 END)"


_split = f"WITH {_flat}, c AS (SELECT dim AS node, label, count(*) FILTER (val <= 0) AS l, count(*) FILTER (val > 0) AS r FROM flat GROUP BY ALL), t AS (SELECT *, sum(l) OVER (PARTITION BY node) AS nl, sum(r) OVER (PARTITION BY node) AS nr FROM c), s AS (SELECT node, sum({g('(l + r)', '(nl + nr)')}) AS hc, sum({g('l', '(nl + nr)')} + {g('r', '(nl + nr)')}) AS hct, any_value({g('nl', '(nl + nr)')} + {g('nr', '(nl + nr)')}) AS ht FROM t WHERE nl > 0 AND nr > 0 GROUP BY node)"
for _name, _x in (("sc", "2 * (hc + ht - hct) / (hc + ht)"), ("mi", "hc + ht - hct"), ("entropy", "hct")):
    ORACLES[f"split_score_{_name}"] = f"{_split} SELECT node, {r6(_x)} AS score FROM s"
_sorted = f"""WITH {_flat}, o AS (SELECT dim AS node, label, val, row_number() OVER (PARTITION BY dim ORDER BY val, label) AS i, row_number() OVER (PARTITION BY dim, label ORDER BY val) AS l, count(*) OVER (PARTITION BY dim) AS n, count(*) OVER (PARTITION BY dim, label) AS t, lead(val) OVER (PARTITION BY dim ORDER BY val, label) AS next FROM flat),
k AS (SELECT dim AS node, sum({g('c', 'n')}) AS hc FROM (SELECT dim, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY dim) AS n FROM flat GROUP BY dim, label) GROUP BY dim),
u AS (SELECT o.*, hc, hc + sum({g('l', 'n')} - {g('(l - 1)', 'n')} + {g('(t - l)', 'n')} - {g('(t - l + 1)', 'n')}) OVER (PARTITION BY node ORDER BY i ROWS UNBOUNDED PRECEDING) AS hct, {g('i', 'n')} + {g('(n - i)', 'n')} AS ht FROM o JOIN k USING (node))"""
for _name, _x, _last in (("sc", "2 * (hc + ht - hct) / (hc + ht)", "next IS NOT NULL"), ("mi", "hc + ht - hct", "next IS NOT NULL"), ("entropy", "hct", "true")):
    ORACLES[f"best_threshold_{_name}"] = f"{_sorted}, b AS (SELECT node, val, next, round({_x}, 12) AS score FROM u WHERE {_last} AND next IS DISTINCT FROM val) SELECT node, {r6('CASE WHEN next IS NULL THEN val::DOUBLE ELSE (val::DOUBLE + next) / 2 END')} AS threshold, {r6('score')} AS score FROM b WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, val) = 1"
ORACLES["best_threshold_mean"] = f"WITH {_flat} SELECT dim AS node, {r6('avg(val::DOUBLE)')} AS threshold, {r6('var_pop(val::DOUBLE)')} AS score FROM flat GROUP BY dim"
ORACLES["best_threshold_balanced"] = f"WITH {_flat}, o AS (SELECT dim AS node, val::DOUBLE AS val, row_number() OVER (PARTITION BY dim ORDER BY val) - 1 AS i, count(*) OVER (PARTITION BY dim) AS n FROM flat) SELECT node, {r6('(max(val) FILTER (i = least(n // 2, n - 1)) + max(val) FILTER (i = least(n // 2 + 1, n - 1))) / 2')} AS threshold, {r6('var_pop(val)')} AS score FROM o GROUP BY node"
_tree: dict[int, tuple] = {n: (d, t, left, right) for n, d, t, left, right in TREE}


def _case(node: int, leaves: list[int]) -> str:
    dim, threshold, *children = _tree[node]
    sides = []
    for child in children:
        if child is None:
            leaves[0] += 1
            sides.append(str(leaves[0] - 1))
        else:
            sides.append(_case(child, leaves))
    return f"CASE WHEN embedding[{dim + 1}] <= {threshold}::FLOAT THEN {sides[0]} ELSE {sides[1]} END"


ORACLES |= {
    "kmeans_step": f"WITH {BOOK}, {FEATURES}, {NEAR}, a AS (SELECT word, unnest(d) AS v, generate_subscripts(d, 1) - 1 AS dim FROM near JOIN f USING (feature_id) WHERE rank = 1) SELECT word, count(*) AS n, dim::INT AS dim, round(avg(v::DOUBLE)::FLOAT::DOUBLE, 5) + 0.0 AS c FROM a GROUP BY word, dim",
    "kmeans_lost_clusters": f"WITH {BOOK}, {FEATURES}, {NEAR}, w AS (SELECT word FROM cb UNION ALL SELECT word + {WORDS} FROM cb) SELECT word FROM w WHERE word NOT IN (SELECT word FROM near WHERE rank = 1)",
    "tree_assign": f"SELECT vec_id, ({_case(0, [0])})::INT AS word FROM {E}",
    "tree_assign_joined": f"SELECT vec_id, ({_case(0, [0])})::INT AS word FROM {E}",
    "route_next": f"SELECT vec_id::VARCHAR AS uuid, CASE label % 4 WHEN 2 THEN 'bow' WHEN 3 THEN 'bow' ELSE 'back' END AS next_queue, (CASE label % 4 WHEN 0 THEN 10 ELSE 0 END)::BIGINT AS errorCode, greatest(label % 4 - 1, 0)::INT AS left_over, least(label % 4, 1)::INT AS past FROM {E}",
}
