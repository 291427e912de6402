"""The contracts that SQL can express, in DuckDB SQL over the whole tables."""

from __future__ import annotations

import string

from .curriculum import SCHEDULES
from .licenses import SPELLINGS, TEXTS
from .sharding import ROUNDS, SEED, bucket_sql, mix_sql

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SPACED = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, {ALNUM}) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOWER}, {ALNUM}) AS w FROM benchmark),
c AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM c)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, item, i, dw.n FROM dw JOIN bw USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, least(len(w), 1)))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY a"""

SUBSTRING = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS owner FROM x GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM x JOIN f USING (k) WHERE owner < doc_id),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM u ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _words(text: str, statements: bool) -> str:
    """The canonical words of a text, as a list, by list functions: each word by itself, pairs by position."""
    lines = f"string_split(lower({text}), chr(10))"
    if not statements:
        lines = f"list_filter({lines}, lambda x: NOT regexp_matches(x, '^[^a-z0-9]*((copyright|[(]c[)]|©).*([(]c[)]|©|<year>|[12][0-9][0-9][0-9]|yyyy)|all rights reserved[^a-z0-9]*$)'))"
    return f"list_filter(string_split_regex(array_to_string({lines}, chr(10)), '[\\x09-\\x0D !-/:-@\\[-`{{-~©«»“”‘’–—…]+'), lambda x: x <> '')"


_one = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SPELLINGS.items() if " " not in k) + "}"
_two = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SPELLINGS.items() if " " in k) + "}"


def _digest(source: str, columns: str, text: str, statements: bool) -> str:
    """``columns`` of ``source`` and the digest of ``text``; null for null."""
    spelt = f"SELECT {columns}, {text} AS t, list_transform({_words(text, statements)}, lambda x: coalesce({_one}[x], x)) AS w FROM {source}"
    paired = f"SELECT {columns}, t, w, [{_two}[w[i] || ' ' || w[i + 1]] for i in range(1, len(w) + 1)] AS p FROM ({spelt})"
    return f"SELECT {columns}, CASE WHEN t IS NOT NULL THEN sha256(array_to_string([coalesce(p[i], w[i]) for i in range(1, len(w) + 1) if i = 1 OR p[i - 1] IS NULL], ' ')) END AS digest FROM ({paired})"


_known = "(" + " UNION ALL ".join("SELECT '{}' AS license_id, '{}' AS text".format(k, v.replace("'", "''")) for k, v in TEXTS.items()) + ")"
LICENSE = f"""WITH k AS ({_digest(_known, 'license_id', 'text', False)}), k2 AS ({_digest(_known, 'license_id', 'text', True)}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents),
ld AS ({_digest("(SELECT * FROM l WHERE regexp_matches(lower(text), 'licen|permission|warrant'))", 'doc_id', 'text', False)}),
found AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM ld JOIN k USING (digest) GROUP BY doc_id),
d AS ({_digest("documents", "doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines", "text", False).replace("SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, CASE", "SELECT doc_id, n_lines, CASE").replace("SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, t, w", "SELECT doc_id, n_lines, t, w")}),
d2 AS ({_digest("documents", 'doc_id', 'text', True)})
SELECT d.doc_id, d.digest, coalesce(k.license_id, k2.license_id) AS license_id, n_lines, coalesce(ids, '') AS line_licenses
FROM d LEFT JOIN d2 ON d2.doc_id = d.doc_id LEFT JOIN k ON k.digest = d.digest LEFT JOIN k2 ON k2.digest = d2.digest LEFT JOIN found ON found.doc_id = d.doc_id"""


_rounds = "SELECT *, x // b AS l0, x % b AS r0 FROM {0}"
for _i in range(1, ROUNDS + 1):
    _l, _r = f"l{_i - 1}", f"r{_i - 1}"
    _step = f"({_l} + {mix_sql(_r, str(_i + SEED))}) % a AS l{_i}, {_r} AS r{_i}" if _i % 2 else f"{_l} AS l{_i}, ({_r} + {mix_sql(_l, str(_i + SEED))}) % b AS r{_i}"
    _rounds = f"SELECT *, {_step} FROM ({_rounds})"
_kept = "doc_id, size, crc, row, n, a, b"
SHARDS = f"""WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8)::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v FROM range(256) r(i))),
bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bs FROM documents),
c AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(bs, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM bytes, t),
o AS (SELECT doc_id, size, crc, row_number() OVER (ORDER BY {bucket_sql('doc_id', 'crc')}, doc_id NULLS FIRST, crc, size) - 1 AS row, count(*) OVER () AS n FROM c),
g AS (SELECT *, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b FROM o),
walk AS (SELECT {_kept}, (l{ROUNDS} * b + r{ROUNDS})::BIGINT AS x FROM ({_rounds.format('(SELECT *, row AS x FROM g)')})
UNION ALL SELECT {_kept}, (l{ROUNDS} * b + r{ROUNDS})::BIGINT AS x FROM ({_rounds.format('(SELECT * FROM walk WHERE x >= n)')}))
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (x % 24)::INT AS shard, (x // 24)::BIGINT AS slot, NULL::INT AS grown_shard FROM walk WHERE x < n"""

CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8)::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v FROM range(256) r(i)))"


def crc_of_decimal(number: str) -> str:
    """SQL over CRC_TABLE: the CRC-32 of an integer's decimal form."""
    codes = f"list_transform(string_split({number}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295)"


TRIE = f"""WITH {CRC_TABLE},
own AS (SELECT conv_id, list({{'k': md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'z': length(coalesce(text, ''))::BIGINT}}
  ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS x FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, x, conv_id - conv_id % 100 AS base, ({crc_of_decimal('conv_id')} % 6)::BIGINT AS h FROM own, crc_table),
whole AS (SELECT h.conv_id, list_concat(CASE WHEN b.x IS NULL THEN h.x[1:0] ELSE b.x[1:h] END, h.x[h + 1:]) AS x FROM h LEFT JOIN own b ON b.conv_id = h.base),
p AS (SELECT conv_id, x, d, array_to_string(list_transform(x[1:d], lambda y: y.k), '') AS k FROM (SELECT conv_id, x, unnest(generate_series(0, len(x))) AS d FROM whole)),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, arg_min(x[d].z, conv_id) AS z, max(len(x)) > d AS inner_,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(x) = d), '') AS ends FROM p GROUP BY d, k),
up AS (SELECT p.d, p.k, count(*) FILTER (NOT v.inner_) AS n_leaves, sum((v.n - 1) * coalesce(v.z, 0))::BIGINT AS saved FROM n v JOIN p ON p.conv_id = v.conv_id AND p.d <= v.d GROUP BY p.d, p.k),
c AS (SELECT v.conv_id, v.d, u.conv_id AS parent FROM n v JOIN p ON p.conv_id = v.conv_id AND p.d = v.d - 1 JOIN n u ON u.d = p.d AND u.k = p.k),
m AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM c GROUP BY parent, d)
SELECT n.conv_id, n.d AS depth, c.parent AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved AS saved_tokens, sha256(ends) AS ends_sha256
FROM n JOIN up USING (d, k) LEFT JOIN c ON c.conv_id = n.conv_id AND c.d = n.d LEFT JOIN m ON m.conv_id = n.conv_id AND m.d = n.d"""

_knots = "CASE weight " + " ".join(f"WHEN {w} THEN {[float(x) for x in f]}::DOUBLE[]" for w, f in SCHEDULES.items()) + " END"
MIXTURE = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {SPACED}))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS i FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM o),
t AS (SELECT *, least((3 * source_size)::DOUBLE, (SELECT arg_min(level, i) FROM l WHERE level * weight <= 3 * source_size) * weight) AS target FROM l),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget, {_knots} AS f,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, list_transform(range(1, len(f)), lambda i: list_sum(list_transform(range(1, i + 1), lambda j: (f[j] + f[j + 1]) / 2))) AS ends, start / greatest(budget, 1)::DOUBLE AS share FROM q),
g AS (SELECT *, share * ends[-1] AS r, least(len(ends) - 1, len(list_filter(ends, lambda x: x <= share * ends[-1]))) AS i FROM e),
y AS (SELECT *, r - CASE WHEN i = 0 THEN 0 ELSE ends[i] END AS over FROM g)
SELECT doc_id, size, source_size, target, list_sum(list_transform([0, 1, 2], lambda k: greatest(0, least(size, budget - k * source_size - start))))::BIGINT AS taken,
  CASE WHEN size > 0 AND start < budget THEN round((i + coalesce(2 * over / nullif(f[i + 1] + sqrt(greatest(0, f[i + 1] * f[i + 1] + 2 * (f[i + 2] - f[i + 1]) * over)), 0), 0)) / len(ends), 6) END AS first_position FROM y"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_levels = """{0} AS (SELECT tree, 0 AS level, nth, digest FROM {1}
  UNION ALL SELECT tree, level + 1, nth // 16, sha256(string_agg(digest, '' ORDER BY nth)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {0}) WHERE n > 1 GROUP BY tree, level, nth // 16)"""
_sides = """SELECT tree, level, nth, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, nth // 16 ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|'
  || coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, nth // 16 ORDER BY nth ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS sides FROM {0}"""
_tops = "SELECT tree, digest, level FROM {0} QUALIFY row_number() OVER (PARTITION BY tree ORDER BY level DESC) = 1"
MANIFEST = f"""WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {crc_of_decimal('doc_id')} % 5 = 0 THEN {_leaf(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} END AS changed FROM documents, crc_table),
a AS (SELECT *, leaf AS digest, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth FROM d),
{_levels.format('v', 'a')}, tops AS ({_tops.format('v')}),
s AS (SELECT 'all' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS nth FROM tops),
{_levels.format('u', 's')}, root AS ({_tops.format('u')}),
vs AS ({_sides.format('v')}), us AS ({_sides.format('u')}),
steps AS (SELECT a.tree, a.nth, 0 AS part, vs.level, vs.sides FROM a JOIN tops ON tops.tree = a.tree JOIN vs ON vs.tree = a.tree AND vs.level < tops.level AND vs.nth = a.nth // (16 ** vs.level)::BIGINT
  UNION ALL SELECT a.tree, a.nth, 1, us.level, us.sides FROM a JOIN s ON s.name = a.tree, root JOIN us ON us.level < root.level AND us.nth = s.nth // (16 ** us.level)::BIGINT),
paths AS (SELECT tree, nth, list(sides ORDER BY part, level) AS path FROM steps GROUP BY tree, nth),
found AS (SELECT doc_id, leaf, s.digest AS subroot, root.digest AS root, coalesce(changed, leaf) AS tried, coalesce(path, []::VARCHAR[]) AS path
  FROM a JOIN s ON s.name = a.tree CROSS JOIN root LEFT JOIN paths ON paths.tree = a.tree AND paths.nth = a.nth),
f AS (SELECT *, list_reduce(path, lambda n, x: sha256(split_part(x, '|', 1) || n || split_part(x, '|', 2)), tried) AS folded_root FROM found)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"""

ORACLES = {"op2_decontamination": DECONTAMINATION, "op3_jaccard_join": JACCARD, "op6_substring_dedup": SUBSTRING, "op8_license_scan": LICENSE, "op9_feistel_shards": SHARDS, "op11_conversation_trie": TRIE, "op12_curriculum": MIXTURE, "op13_merkle_manifest": MANIFEST}
