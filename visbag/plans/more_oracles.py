"""The queries of ``visbag.plans.more`` in DuckDB SQL, over the same tables."""

from __future__ import annotations

from .more import CLASSES, DRAWN, RANGE, SEED, TCMP_TREE, TPC_TREE
from .oracles import BOOK, BYTES, DISTANCES, FEATURES, L1_NORM, L2_NORM, NEAR, PAIRS, PROJECTED, SIGMA, THIN, E, _case, _flat, entries, g, r6, ranking, soft
from .queries import CUT, K, WEIGHTS


def drawn(key: str, seed: int, digits: int = 16) -> str:
    return f"substr(md5('{seed}:' || {key}), 1, {digits})"


def _leaves(tree: dict, node: int, test, words: list[int]) -> str:
    """Nested cases of a tree: node -> (left, right); leaves numbered left before right."""
    sides = []
    for child in tree[node]:
        if child is None:
            words[0] += 1
            sides.append(str(words[0] - 1))
        else:
            sides.append(_leaves(tree, child, test, words))
    return f"CASE WHEN {test(node)} THEN {sides[0]} ELSE {sides[1]} END"


def dot(weights: list[float]) -> str:
    return f"list_sum(list_transform(list_zip({weights}, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


_tcmp = {n: (a, b) for n, a, b, _, _ in TCMP_TREE}
_tpc = {n: (w, t, d) for n, w, t, d, _, _ in TPC_TREE}
TCMP = _leaves({n: (left, right) for n, _, _, left, right in TCMP_TREE}, 0, lambda n: f"embedding[{_tcmp[n][0] + 1}] <= embedding[{_tcmp[n][1] + 1}]", [0])
TPC = _leaves({n: (left, right) for n, _, _, _, left, right in TPC_TREE}, 0, lambda n: f"{dot(WEIGHTS[_tpc[n][0]])} <= {_tpc[n][1]}", [0])
TERC = _case(0, [0])
TAIL = "tt AS (SELECT list(t::FLOAT ORDER BY i) AS t FROM (SELECT i, sum(m) OVER (ORDER BY i DESC) AS t FROM (SELECT i, CASE WHEN i = 0 THEN 0.5 ELSE 1 END * exp(-pow(i / 499.0::DOUBLE * 5, 2) / 2) / 2.506628274::DOUBLE * (5 / 499.5::DOUBLE) AS m FROM range(500) r(i))))"


def tail(point: str) -> str:
    return f"coalesce(t[(floor(abs({point}) / 5 * 499 + 0.5) + 1)::BIGINT], 0)::DOUBLE"


def left(node: int) -> str:
    """The share that goes left of a projection node, from its value v<node>."""
    w, threshold, deviation = _tpc[node]
    return f"CASE WHEN v{node} <= 0 THEN 1 - {tail(f'v{node} / {deviation}')} ELSE {tail(f'v{node} / {deviation}')} END"


def h(a: str, b: str) -> str:
    return f"(CASE WHEN {a} > 0 THEN -({a}) / n::DOUBLE * log2(({a}) / ({b})::DOUBLE) ELSE 0 END)"


def steps(right: int) -> str:
    rest = f"({right} * n - nth)"
    return f"""WITH {_flat}, o AS (SELECT dim AS node, label, val::DOUBLE AS val, row_number() OVER (PARTITION BY dim ORDER BY val, label) - 1 AS nth, row_number() OVER (PARTITION BY dim, label ORDER BY val) - 1 AS l, count(*) OVER (PARTITION BY dim) AS n, count(*) OVER (PARTITION BY dim, label) AS t FROM flat),
st AS (SELECT *, {h('l', 'nth')} + {h('(t - l)', rest)} - {h('(l + 1)', '(nth + 1)')} - {h('(t - l - 1)', f'({rest} - 1)')} AS step FROM o)"""


def halves(a: str, b: str) -> str:
    return f"(CASE WHEN {a} > 0 AND {b} > 0 THEN -({a}) / n::DOUBLE * log2(({a}) / n::DOUBLE) - ({b}) / n::DOUBLE * log2(({b}) / n::DOUBLE) ELSE 0 END)"


MEAN = "(list_sum(list_transform(embedding, lambda y: y::DOUBLE)) / len(embedding))"
SPREAD = f"sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)) / len(embedding) - {MEAN} * {MEAN})"
CELLS = "SELECT vec_id, dim::INT AS dim, {} AS val FROM (SELECT vec_id, unnest(x) AS val, generate_subscripts(x, 1) - 1 AS dim FROM ({}))"
_placed = f"(SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, {{}} AS x FROM {E})"
_distance = "list_sum(list_transform(list_transform(list_zip(d, center), lambda z: (z[1]-z[2])*(z[1]-z[2])), lambda v: v::DOUBLE))"


def lloyd(words: int, iterations: int, order: str) -> str:
    """Steps of k-means from the first features in an order; the last centers are m<iterations - 1>."""
    out = f"WITH {FEATURES}, c0 AS (SELECT (row_number() OVER (ORDER BY {order}) - 1)::INT AS word, d AS center FROM f ORDER BY {order} LIMIT {words})"
    for i in range(iterations):
        out += f""", a{i} AS MATERIALIZED (SELECT feature_id, word FROM (SELECT feature_id, word, {_distance} AS dist FROM f, c{i}) QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY dist, word) = 1),
m{i} AS (SELECT word, dim, avg(v::DOUBLE)::FLOAT AS m FROM (SELECT word, unnest(d) AS v, generate_subscripts(d, 1) - 1 AS dim FROM a{i} JOIN f USING (feature_id)) GROUP BY ALL), c{i + 1} AS MATERIALIZED (SELECT word, list(m ORDER BY dim) AS center FROM m{i} GROUP BY word)"""
    return out + f" SELECT word, dim::INT AS dim, round(m::DOUBLE, 3) + 0.0 AS c FROM m{iterations - 1}"


_pairs = f"SELECT a.vec_id AS a_id, b.vec_id AS b_id FROM o a JOIN o b ON a.part = b.part AND b.i - a.i BETWEEN 1 AND 3"
_ordered = f"row_number() OVER (PARTITION BY {{0}} ORDER BY {drawn('vec_id', SEED + 2)}, vec_id) AS i FROM {E} WHERE label IS NOT NULL"

ORACLES = {
    "covariance_matrix": f"WITH {_flat} SELECT a.dim::INT AS i, b.dim::INT AS j, {r6('avg(a.val::DOUBLE * b.val::DOUBLE) - avg(a.val::DOUBLE) * avg(b.val::DOUBLE)')} AS c FROM flat a JOIN flat b USING (vec_id) GROUP BY ALL",
    "change_ratio": f"WITH {BOOK}, {FEATURES}, {NEAR}, even AS (SELECT * FROM near WHERE word % 2 = 0 QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY dist, word) = 1) SELECT {r6('avg((a.word <> b.word)::INT)')} AS changed FROM near a JOIN even b USING (feature_id) WHERE a.rank = 1",
    "sample_without_replacement": f"SELECT vec_id AS feature_id FROM {E} ORDER BY {drawn('vec_id', SEED)}, vec_id LIMIT {DRAWN}",
    "sample_with_replacement": f"WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY {drawn('vec_id', 0, 2)}, vec_id) - 1 AS number, count(*) OVER () AS total FROM {E}), d AS (SELECT draw, ('0x' || {drawn('draw', SEED, 12)})::BIGINT % (SELECT max(total) FROM n) AS number FROM range({10 * DRAWN}) r(draw)) SELECT draw, vec_id AS feature_id FROM d JOIN n USING (number)",
    "label_subset": f"SELECT vec_id, label FROM {E} WHERE label IN (SELECT label FROM (SELECT DISTINCT label FROM {E} WHERE label IS NOT NULL) ORDER BY {drawn('label', SEED)}, label LIMIT {CLASSES})",
    "pairs_same_class": f"WITH o AS (SELECT vec_id, label AS part, {_ordered.format('label')}) {_pairs}",
    "pairs_two_classes": f"WITH o AS (SELECT vec_id, label, {drawn('vec_id', SEED + 1, 2)} AS part, {_ordered.format(drawn('vec_id', SEED + 1, 2))}) {_pairs} WHERE a.label <> b.label",
    "roulette_wheel": f"WITH {PROJECTED}, w0 AS (SELECT component AS id, pow(greatest(round(avg(p), 9), 0), 2) AS s FROM pr GROUP BY component ORDER BY component LIMIT 3), wheel AS (SELECT id, sum(s) OVER (ORDER BY id) AS upto, sum(s) OVER () AS total FROM w0) SELECT vec_id, id AS choice FROM {E} LEFT JOIN wheel ON upto >= vec_id * 7919 % 1000 / 1000.0::DOUBLE * total QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY upto, id) = 1",
    "split_score_sc_with_error": f"{steps(2)}, s AS (SELECT node, any_value(n) AS n, sum(step) FILTER (val <= 0) AS i, count(*) FILTER (val <= 0) AS l FROM st GROUP BY node) SELECT node, CASE WHEN l > 0 AND l < n THEN {r6('2 * i / ' + halves('l', '(2 * n - l)'))} END AS score FROM s",
    "best_threshold_sc_with_error": f"{steps(1)}, k AS (SELECT node, sum({g('c', 'n')}) AS hc FROM (SELECT dim AS node, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY dim) AS n FROM flat GROUP BY dim, label) GROUP BY node), u AS (SELECT *, sum(step) OVER (PARTITION BY node ORDER BY nth ROWS UNBOUNDED PRECEDING) AS i, lead(val) OVER (PARTITION BY node ORDER BY nth) AS next, {halves('(nth + 1)', '(n - nth - 1)')} AS ht FROM st), b AS (SELECT *, round(2 * i / (hc + ht), 12) AS score FROM u JOIN k USING (node)) SELECT node, {r6('coalesce((val + next) / 2, val)')} AS threshold, {r6('score')} AS score FROM b WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, nth) = 1",
    "sparse_l2sq": f"WITH {PAIRS} SELECT a_id, b_id, {r6(f'list_sum(list_transform(list_zip({THIN.replace("embedding", "a")}, {THIN.replace("embedding", "b")}), lambda z: ((z[1]-z[2])*(z[1]-z[2]))::DOUBLE))')} AS d FROM p",
    "kernel_by_name": f"WITH p AS (SELECT a_id, b_id, list_transform(a, lambda x: abs(x)) AS a, list_transform(b, lambda x: abs(x)) AS b FROM (WITH {PAIRS} SELECT * FROM p)) SELECT a_id, b_id, CASE a_id % 4 {' '.join(f'WHEN {k} THEN {r6(DISTANCES[n])}' for k, n in enumerate(('dist_l1', 'dist_l2', 'dot', 'dist_x2')))} END AS d FROM p",
    "norm_by_name": entries(f"list_transform(embedding, lambda x: CASE vec_id % 3 WHEN 0 THEN (x::DOUBLE / {L1_NORM.replace('lambda x: abs(x', 'lambda y: abs(y')})::FLOAT WHEN 1 THEN (x::DOUBLE / {L2_NORM.replace('lambda x: x::DOUBLE * x', 'lambda y: y::DOUBLE * y')})::FLOAT ELSE ((x::DOUBLE - {MEAN}) / {SPREAD})::FLOAT END)"),
    "vector_rows": f"SELECT vec_id, 64 AS dimension, true AS dense, 64 AS n, len(list_filter(embedding, lambda x: abs(x::DOUBLE) >= {CUT}))::INT AS sparse_n FROM {E}",
    "word_range": soft(K) + f" SELECT image_id, word, {r6('value')} AS value FROM h WHERE word <= {RANGE}",
    "search_names": ranking("reference", 1) + " SELECT query_id, rank, 'http://foo/image' || item_id AS url FROM rk",
    "blob_round_trip": entries("embedding"),
    "header_split": f"SELECT vec_id, {', '.join(f'{r6(f"embedding[{i + 1}]")} AS {c}' for i, c in enumerate(('x', 'y', 'size', 'angle', 'response', 'octave')))}, 58 AS n FROM {E}",
    "envelope_round_trip": f"SELECT vec_id::VARCHAR AS uuid, (label % 4)::INT AS steps, 'back' AS returnQueue FROM {E} WHERE vec_id % 5 <> 0",
    "malformed_messages": f"SELECT vec_id % 4 = 1 AS malformed, count(*) AS n FROM {E} GROUP BY 1",
    "dead_letter_split": f"SELECT vec_id::VARCHAR AS uuid, label % 4 = 0 AND vec_id % 3 = 0 AS dead FROM {E}",
    "message_log": f"SELECT vec_id::VARCHAR AS uuid, (CASE WHEN vec_id % 6 = 0 THEN 10 ELSE 0 END)::BIGINT AS errorCode, CASE WHEN vec_id % 6 = 0 THEN 'no features' ELSE '' END AS messages FROM {E}",
    "vector_file_round_trip": CELLS.format(r6("val"), _placed.format(f"CASE WHEN vec_id % 2 = 0 THEN {BYTES} ELSE embedding END")),
    "vector_file_lookup": CELLS.format(r6("val"), _placed.format("embedding")) + " WHERE vec_id IN (3, 4, 5, 7, 200)",
    "codebook_file_round_trip": f"WITH {BOOK}, {SIGMA} SELECT word, dim::INT AS dim, {r6('val')} AS val, {r6('s')} AS average FROM (SELECT word, unnest(center) AS val, generate_subscripts(center, 1) - 1 AS dim FROM cb), sg",
    "tree_assign_tcmp": f"SELECT vec_id, ({TCMP})::INT AS word FROM {E}",
    "tree_assign_tpc": f"SELECT vec_id, ({TPC})::INT AS word FROM {E}",
    "tree_soft_words": f"""WITH {TAIL}, v AS (SELECT vec_id, t, {', '.join(f'{dot(WEIGHTS[w])} - ({th}) AS v{n}' for n, (w, th, _) in _tpc.items())} FROM {E}, tt),
s AS (SELECT vec_id, {', '.join(f'{left(n)} AS s{n}' for n in _tpc)} FROM v)
SELECT vec_id, word, round(weight, 5) AS weight FROM (SELECT vec_id, unnest([0, 1, 2, 3]) AS word, unnest([s0 * s1, s0 * (1 - s1), (1 - s0) * s2, (1 - s0) * (1 - s2)]) AS weight FROM s) WHERE weight > 0""",
    "normal_tail": f"WITH {TAIL} SELECT vec_id, round({tail('(embedding[1]::DOUBLE * 10)')}, 5) AS tail FROM {E}, tt",
    "forest_file_round_trip": " UNION ALL ".join(f"SELECT vec_id, '{k}' AS kind, ({x})::INT AS word FROM {E}" for k, x in (("TERC", TERC), ("TCMP", TCMP), ("TPC", TPC))),
    "kmeans_from_first": lloyd(8, 2, "feature_id"),
    "kmeans_train": lloyd(16, 3, f"{drawn('feature_id', 1)}, feature_id"),
    "pca_variance": f"WITH {_flat}, v AS (SELECT dim, var_pop(val::DOUBLE) AS v FROM flat GROUP BY dim) SELECT {r6('sum(v)')} AS total, true AS falling FROM v",
    "project_batches": f"WITH {PROJECTED} SELECT vec_id, component, round(p::FLOAT::DOUBLE, 4) + 0.0 AS p FROM pr",
    "knn_by_expressions": f"WITH {BOOK}, {FEATURES}, {NEAR} SELECT feature_id, rank::INT AS rank, word, {r6('dist')} AS distance FROM near WHERE rank <= 3",
    "base_file_round_trip": soft(1) + " SELECT 'image' || image_id AS name, word, floor(round(value, 6) * 1000)::DOUBLE AS value FROM h",
    "dummy_features": f"SELECT (i // 50)::INT AS row, (i % 50)::INT AS col, round((i * 3.1415926::DOUBLE)::FLOAT::DOUBLE, 1) AS v FROM range((SELECT count(DISTINCT vec_id // 10) * 50 FROM {E})) r(i)",
    "queue_round_trip": f"SELECT vec_id::VARCHAR AS uuid, (label % 4)::INT AS steps FROM {E} WHERE vec_id % 3 <> 0",
    "stream_route": f"SELECT vec_id::VARCHAR AS uuid, CASE label % 4 WHEN 2 THEN 'bow' WHEN 3 THEN 'bow' ELSE 'back' END AS next_queue, (CASE label % 4 WHEN 0 THEN 10 ELSE 0 END)::BIGINT AS errorCode, greatest(label % 4 - 1, 0)::INT AS left_over FROM {E}",
}
