"""The operators against plain versions, over small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import base64
import json
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import brute
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from visbag.llm import byte_bpe, components, decontaminate, fm_index, gru, html_extract, jaccard, language_model, licenses, quality, sharding, substring
from visbag.llm.queries import ORACLES, QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def corpus() -> list[tuple]:
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "É", "x.", "the", "THE"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(200), text(40)
    rows = [(i, text(rng.randint(1, 120))) for i in range(40)]
    rows += [(100 + i, " ".join(w if rng.random() > 0.01 else "edited" for w in base.split())) for i in range(25)]
    rows += [(200 + i, base) for i in range(5)] + [(300 + i, text(30) + "\n" + passage + "\t" + text(20)) for i in range(6)]
    rows += [(400, ""), (401, None), (402, "one"), (403, "one"), (404, "two words"), (405, " \n\t "), (406, text(9000)), (407, "a" * 70_000), (408, "tail  spaces   x   ")]
    rows += [(409, passage), (410, "ÀÉ \x1f unit\x00nul")]
    return rows


def frame(spark, rows, more=()):
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in [*rows, *more]], names)


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def table(spark, docs):
    return frame(spark, docs).withColumns({c: F.lit(1) for c in ("score", "chunk", "kept", "class", "n", "row", "bucket", "spans", "held")}).repartition(3)


def by_id(df, *names):
    return {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}


EMPTY = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_decontamination(spark, docs, table):
    items = [(1, docs[3][1]), (2, "one"), (3, None), (4, ""), (5, docs[45][1].upper()), (6, "two words"), (None, "w1 w2"), (7, "absent thing")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = brute.contamination(docs, [("" if i is None else i, t) for i, t in items if t])
    for block in (1 << 20, 300):  # one block, several
        found = decontaminate.judged(decontaminate.contamination(table, bench, block_bytes=block))
        got = by_id(found.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("s"), "contaminated"), "n_words", "n_hit", "n", "s", "contaminated")
        assert got == want
    assert decontaminate.contamination(spark.createDataFrame([], EMPTY), bench).count() == 0
    none = decontaminate.judged(decontaminate.contamination(table, bench.limit(0)))
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)


def test_fm_index_against_search():
    rng = np.random.default_rng(3)
    for sigma, n in ((2, 400), (30, 3000), (5, 1)):
        text = rng.integers(0, sigma + 1, n)
        index = fm_index.FMIndex(text, sigma)
        assert np.array_equal(np.sort(fm_index.suffix_array(text)), np.arange(n))
        for size in (1, 2, 3, 7):
            phrases = rng.integers(1, sigma + 1, (30, size))
            low, high = index.find(phrases)
            for p, a, b in zip(phrases, low, high):
                want = [i for i in range(n - size + 1) if np.array_equal(text[i : i + size], p)]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_jaccard_join(spark, docs, table, monkeypatch):
    want = brute.components(docs)
    for options in ({}, {"family": 2500, "members": 4, "pivots": 2}):  # families whole, then in blocks
        assert by_id(jaccard.joined(table, **options), "n_shingles", "component_id") == want
    monkeypatch.setattr(jaccard, "LIST", 3)  # long lists
    assert by_id(jaccard.joined(table), "n_shingles", "component_id") == want
    twice = jaccard.joined(frame(spark, docs, [docs[0], (None, docs[0][1]), (None, None)]))
    assert twice.count() == len(docs) + 3 and twice.where("doc_id = 0 and component_id = 0").count() == 2
    assert jaccard.joined(spark.createDataFrame([], EMPTY)).count() == 0


def test_jaccard_threshold(spark):
    """Exactly nine tenths links, less does not."""
    words = [f"u{i}" for i in range(40)]
    a = " ".join(words)
    rows = [(1, a), (2, " ".join(words[:-2]))]  # 38 and 36 shingles: 36 of 38
    rows += [(10, " ".join(f"v{i}" for i in range(22))), (11, " ".join(f"v{i}" for i in range(20)))]  # 20 and 18: 18 of 20
    rows += [(20, " ".join(f"z{i}" for i in range(21))), (21, " ".join(f"z{i}" for i in range(19)))]  # 19 and 17: 17 of 19
    got = by_id(jaccard.joined(frame(spark, rows)), "component_id")
    assert got == {1: (1,), 2: (1,), 10: (10,), 11: (10,), 20: (20,), 21: (21,)}


def test_jaccard_smallest_sets(spark):
    """A set of 9 within a set of 10 links, at either end of the text; one of 8 within one of 9 does not."""
    rows = []
    for at, n in ((0, 12), (10, 11)):
        words = [f"s{at}_{i}" for i in range(n)]
        rows += [(at, " ".join(words)), (at + 1, " ".join(words[:-1])), (at + 2, " ".join(words[1:]))]
    got = by_id(jaccard.joined(frame(spark, rows)), "n_shingles", "component_id")
    assert got == {0: (10, 0), 1: (9, 0), 2: (9, 0), 10: (9, 10), 11: (8, 11), 12: (8, 12)} == brute.components(rows)
    kept = {r.doc_id for r in corpus_pipeline.without_near_copies(spark, frame(spark, rows), "").collect()}
    assert kept == {c for _, c in brute.components(rows, 5, 4, 5).values()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 101 + i) for i in range(50)] + [(200 + i, 201 + i) for i in range(20)]
    union = components.Union()
    for a, b in edges:
        union.join(a, b)
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()}
    assert got == {n: union.root(n) for e in edges if e[0] != e[1] for n in e}


def test_byte_bpe(spark, docs, table):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.encoded(table, PATH, PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    for d, t in docs:
        ids = whole.encode_ordinary(t or "")
        assert got[d] == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or ""))
    real = byte_bpe.encoded(table, PATH, PATTERN, digests=False).where("doc_id = 408").first()
    assert bytes(real.decoded).decode() == docs[-3][1] and [int(x) for x in real.ids.split()] == whole.encode_ordinary(docs[-3][1])
    assert byte_bpe.encoded(spark.createDataFrame([], EMPTY), PATH, PATTERN).count() == 0


def test_stitching(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 50)
    monkeypatch.setattr(byte_bpe, "OVERLAP", 12)
    known, rng = byte_bpe.Pieces(PATH, PATTERN), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", " ", "  ", "\n", "'s", "7", "!", "bcd", "x" * 30, " " * 25]) for _ in range(rng.randrange(1, 120)))
        chunks = [(at, [at + x for x in known.ends(part)]) for at, part in byte_bpe.cut(text)]
        assert byte_bpe.stitched(text, chunks, known.ends) == known.ends(text)


def test_language_model(spark, docs, table):
    held = table.withColumn("held_out", F.col("doc_id") % 7 == 2)
    tokens = {d: [*brute.spaced(brute.lower(t or "")), None] for d, t in docs}
    count = Counter(w for d, t in tokens.items() if d % 7 != 2 for w in t)
    n, v = sum(count.values()), len(count)
    got = language_model.scored(held, chunk_bytes=20_000).collect()
    assert len(got) == len(docs)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9) and r.score < 0
    assert language_model.scored(spark.createDataFrame([], "doc_id bigint, text string, held_out boolean")).count() == 0
    unlearned = language_model.scored(frame(spark, docs[:3]).withColumn("held_out", F.lit(True))).collect()
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in unlearned)


def test_model_gradients_and_mass():
    rng = np.random.default_rng(0)
    m = gru.Model(40)
    x, t, fresh, h = rng.integers(0, 40, (6, 5)), rng.integers(-1, 41, (6, 5)), rng.random((6, 5)) < 0.3, rng.standard_normal((5, gru.HIDDEN)).astype(np.float32)
    grads = {n: np.zeros(s, np.float32) for n, s in m.shapes.items()}
    m.window(x, t, fresh, h, grads)
    loss = lambda: -float(m.window(x, t, fresh, h, None)[0].astype(np.float64).sum())
    for name in m.shapes:
        p = getattr(m, name)
        i = (x[2, 1], 3) if name == "inputs" else tuple(0 for _ in p.shape)
        old = p[i]
        p[i] = old + 1e-2
        up = loss()
        p[i] = old - 1e-2
        slope, p[i] = (up - loss()) / 2e-2, old
        assert abs(slope - grads[name][i]) < 5e-3
    one = np.zeros((1, 1), np.int64)
    total = sum(math.exp(m.window(one, np.array([[s]]), one == 0, h[:1], None)[0][0, 0]) for s in range(-1, 41))
    assert abs(total - 1) < 1e-4


def test_learning_uses_every_token():
    """Fewer tokens than a step, and those after the last whole step, change the model for the better."""
    lengths = [24] * 10 + [gru.STEP // gru.STREAMS * 3] * 600
    for count in (10, len(lengths)):
        first = np.concatenate([[0], np.cumsum(lengths[:count])])
        symbols = np.arange(first[-1]) % 5
        m, steps = gru.Model(20), []
        before, whole = m.log_probabilities(symbols, symbols, first).sum(), m.window
        m.window = lambda x, *rest: (steps.append(m.flat.copy()), whole(x, *rest))[1]
        assert m.learn(symbols, symbols, first) == len(symbols)
        m.window = whole
        assert not np.array_equal(m.flat, steps[-1])  # the last window is applied
        assert m.log_probabilities(symbols, symbols, first).sum() > before


def test_vocabulary_grows_and_groups_learn():
    """Sizes grow with the training text; other words have output classes whose weights depend on what came before."""
    small, large = language_model.sizes(10**6), language_model.sizes(30 * 10**9)
    assert small[0] >= 255 and large[0] > 100 * small[0] and large[1] > 4 * small[1]
    m = gru.Model(40, groups=4, width=8)
    one, h = np.zeros((1, 1), np.int64), np.random.default_rng(0).standard_normal((1, gru.HIDDEN)).astype(np.float32)
    assert abs(sum(math.exp(m.window(one, np.array([[s]]), one == 0, h, None)[0][0, 0]) for s in range(-4, 41)) - 1) < 1e-4
    m, symbols = gru.Model(2, groups=2), np.tile([1, -1, 2, -2, 2, -2, 1, -1], 6000)
    tails, first = np.where(symbols == -2, 1, 0), np.arange(0, len(symbols) + 1, 80)
    for _ in range(6):
        m.learn(symbols, tails, first)
    log_p = lambda *s: m.log_probabilities(np.array(s), np.where(np.array(s) == -2, 1, 0), np.array([0, len(s)]))[-1]
    assert log_p(1, -1) > log_p(2, -1) + 1 and log_p(2, -2) > log_p(1, -2) + 1


def test_windows_keep_documents_whole():
    """Scores do not depend on how documents are laid out in streams."""
    rng = np.random.default_rng(1)
    m = gru.Model(20)
    lengths = [1, 90, 3, 40, 1, 7]
    symbols, tails = rng.integers(-1, 21, sum(lengths)), rng.integers(0, gru.TAILS, sum(lengths))
    first = np.concatenate([[0], np.cumsum(lengths)])
    together = m.log_probabilities(symbols, tails, first)
    for a, b in zip(first, first[1:]):
        assert np.allclose(together[a:b], m.log_probabilities(symbols[a:b], tails[a:b], np.array([0, b - a])), atol=1e-5)


def test_substring_dedup(spark, docs, table, monkeypatch):
    want = brute.removals(docs)
    check = lambda df: by_id(df.withColumn("s", F.sha2(F.encode("kept", "UTF-8"), 256)), "n_words", "n_removed", "s")
    assert check(substring.deduplicated(table)) == want
    assert check(substring.deduplicated(table, chunk_bytes=4000)) == want
    monkeypatch.setattr(substring, "SALT", 2)
    monkeypatch.setattr(substring, "BLOCK_WORDS", 50)
    assert check(substring.deduplicated(table, chunk_bytes=4000)) == want
    null = substring.deduplicated(frame(spark, docs, [docs[50], (None, docs[50][1])])).where("doc_id is null").first()
    assert null.n_removed == null.n_words
    assert substring.deduplicated(spark.createDataFrame([], EMPTY)).count() == 0


def test_suffix_automaton():
    rng = random.Random(5)
    for _ in range(200):
        known = [[rng.choice("abc") for _ in range(rng.randrange(1, 14))] for _ in range(3)]
        query = [rng.choice("abc") for _ in range(20)]
        automaton = substring.Automaton()
        for k in known:
            automaton.add(k)
        parts = {tuple(k[i : i + 3]) for k in known for i in range(len(k) - 2)}
        want = {j for i in range(len(query) - 2) if tuple(query[i : i + 3]) in parts for j in range(i, i + 3)}
        assert {j for a, b in automaton.spans(query, 3) for j in range(a, b)} == want


def test_quality(spark, sf, table, docs):
    held = [r for r in QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").collect()]
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    assert all(r.held_out == (brute.remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in held)
    judged = [r.predicted == labels[r.doc_id] for r in held if r.held_out and r.doc_id in labels]
    assert len(judged) > 50 and sum(judged) / len(judged) > 0.95
    some = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 7), (5, 1), (6, 0), (5, 1)], "doc_id bigint, quality int")
    assert quality.scored(table.select("doc_id", "text"), quality.fit(table, some)).count() == len(docs)
    assert quality.fit(table, some.limit(0)).score(np.zeros((2, quality.SIZE))).tolist() == [0.5, 0.5]


def test_license_scan(spark):
    mit = licenses.TEXTS["MIT"].replace("<year> <holder>", "2020 Ann Author").replace("sublicense", "sub-licence").upper()
    rows = [(1, mit), (2, licenses.TEXTS["MIT"] + " more"), (3, None), (4, ""), (5, "text\nReleased under the MIT licence!\nmore"), (1, mit)]
    got = {(r.doc_id, r.license_id, r.line_licenses, r.n_lines) for r in licenses.scanned(frame(spark, rows)).collect()}
    assert (1, "MIT", "", mit.count("\n") + 1) in got and (3, None, "", 0) in got and (4, None, "", 1) in got and (5, None, "MIT-notice", 3) in got
    assert not any(i == 2 and x for i, x, _, _ in got)
    assert licenses.scanned(spark.createDataFrame([], EMPTY)).count() == 0
    assert "Python" not in licenses.scanned(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()


def test_license_scan_long_texts(spark):
    """Whole texts of long licences are found, in capitals and with other spaces within lines too."""
    names = ["Apache-2.0-text", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0"]
    texts = json.loads((Path(licenses.__file__).parent / "license_texts.json").read_text("utf-8"))
    rows = [(i, texts[n].upper().replace(" ", "  ")) for i, n in enumerate(names)] + [(100, texts["MPL-2.0"] + " more")]
    assert by_id(licenses.scanned(frame(spark, rows)), "license_id") == {i: (n,) for i, n in enumerate(names)} | {100: (None,)}


def test_sharding(spark, docs, table):
    rows = docs + [docs[0], docs[0], (None, "x"), (None, None)]
    got = sharding.shuffled_shards(frame(spark, rows), 7).collect()
    assert sorted(r.row for r in got) == list(range(len(rows)))
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert all((r.shard, r.slot) == sharding.shard_and_slot(r.row, len(rows), 7) for r in got)
    texts: dict = {}
    for d, t in rows:
        texts.setdefault(d, set()).add((zlib.crc32((t or "").encode()), len((t or "").encode()) + 8))
    assert all((r.text_crc32, r.size) in texts[r.doc_id] for r in got)
    again = sharding.shuffled_shards(frame(spark, rows).repartition(9, "text"), 7).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.shuffled_shards(spark.createDataFrame([], EMPTY)).count() == 0
    for n in (1, 2, 3, 10, 1000):
        assert len({sharding.shard_and_slot(i, n, 3) for i in range(n)}) == n


def test_html_extraction(spark):
    menu = "<div><span>Home</span> <span>About us</span></div>"
    pages = [(i, f"https://a.org/{i}", f"<html><body>{menu}<article><h1>Title {i}</h1><div>Read our paper edition</div><p><b>First &amp; {i}<br>line\n two<p>Second&nbsp;&lt;p&gt; {i}</p><aside>x</aside><div class='comments'>nice</div><script>var a='</p><p>no';</script></article><footer>f</footer>") for i in range(12)]
    pages += [(50 + i, f"http://b.org/{i}", f"<body>{menu}<p>Text {i} of b<table><tr><td>cell {i}<td>other {i}</table><form>in</form>") for i in range(12)]
    pages += [(90, None, None), (91, "x", ""), (92, "http://c.org", "plain <i>text</i> &copy; <unclosed"), (93, "http://c.org", "<p>a</p>" * 3), (0, "https://a.org/0", pages[0][2])]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extracted(df, chunk_bytes=2000).collect()}
    assert got[3] == "Title 3\n\nFirst & 3 line two\n\nSecond <p> 3"
    assert got[52] == "Text 2 of b\n\ncell 2\n\nother 2"
    assert got[90] == got[91] == "" and got[92] == "plain text © <unclosed" and got[93] == "a\n\na\n\na"
    assert html_extract.extracted(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "http://d.org/", "<article><p>same</p></article>") for i in range(30)], "page_id bigint, url string, html string")
    assert {r.text for r in html_extract.extracted(copies).collect()} == {"same"}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(d, t) for d, t in docs.select("doc_id", "text").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if k == 4:
            break
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        got = sorted((r.doc_id, r.text) for r in out.collect())
        if k == 0:
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            model = quality.fit(spark.createDataFrame([(d, t) for d, t in rows if brute.remainder(d, 5)], "doc_id bigint, text string"), labels)
            score = {d: model.score(quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])))[0] for d, t in rows}
            assert [d for d, _ in got] == sorted(d for d, _ in rows if score[d] >= corpus_pipeline.LEAST_SCORE)
        if k == 1:
            want = brute.components(rows, 5, 4, 5)
            assert got == sorted((d, t) for d, t in rows if want[d][1] == d)
        if k == 2:
            want = brute.removals(rows)
            assert [d for d, _ in got] == sorted(d for d, _ in rows)
            assert all(brute.sha(" ".join(brute.spaced(t))) == want[d][2] for d, t in got)
        if k == 3:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            want = brute.contamination(rows, items)
            assert got == sorted((d, t) for d, t in rows if not want[d][4])
        docs, rows = spark.createDataFrame(out.collect(), docs.schema), got
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks(PATH), special_tokens={})
    want = {d: encoding.encode_ordinary(t or "") for d, t in rows}
    tokens = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert len(tokens) == len(rows) and all([int(x) for x in tokens[d].ids.split()] == ids and tokens[d].n_tokens == len(ids) for d, ids in want.items())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, sf, name):
    import oracle

    assert oracle.difference(spark, QUERIES[name], ORACLES[name], sf) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, sf, name):
    if name.startswith("op11"):  # a row a node
        assert QUERIES[name](spark, sf).where("depth = 0").count() == 1
        return
    kind = "embeddings" if name.startswith("op10") else "pages" if name.startswith("op1_") else "documents"
    assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{kind}.parquet").count()
