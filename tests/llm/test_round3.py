"""The trie of conversations, the curriculum and the Merkle manifest against plain versions."""

from __future__ import annotations

import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from visbag.llm import curriculum, merkle, trie

TURNS = "conv_id bigint, turn bigint, role string, text string"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def conversations(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 400), n):
        turns = [(rng.choice("ab"), rng.choice(["", "x", "é🙂", "longer"])) for _ in range(rng.randint(1, 9))]
        rows += [(c, i if i or rng.random() < 0.8 else None, *t) for i, t in enumerate(turns)]
    for c in (500, 501, 502, 507, 611):  # copies, and one that goes on
        rows += [(c, i, "user", f"turn {i}") for i in range(30 + (c == 507))]
    rows += [(700, 0, None, None), (701, 3, "", ""), (None, 1, "user", "no one's"), (800, None, "user", "t" * 50_000)]
    return rows


@pytest.mark.parametrize("block", [1, 2, 7, 16384])
def test_trie(spark, block):
    rows = conversations(block, 60)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).withColumns({"key": F.lit(1), "l": F.lit("x"), "part": F.lit(3)})
    got = trie.trie(df, block)
    assert got.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute.trie(rows), key=repr)


def test_trie_of_few(spark):
    for rows in ([], [(100, 1, "a", "b")], [(5, None, None, None)], [(1, 0, "a", "x"), (2, 0, "a", "x"), (3, 0, "a", "x")]):
        assert sorted(map(tuple, trie.trie(spark.createDataFrame(rows, TURNS), 2).collect())) == sorted(brute.trie(rows))


def test_trie_repeated_rows_and_ties(spark):
    """Repeated rows are turns each; turns of one number come in an order of their digests, whatever the rows' order."""
    rows = [(1, 0, "a", "x"), (1, 0, "a", "x"), (1, 0, "b", "y"), (9, 0, "b", "y"), (9, 0, "a", "x"), (9, 0, "a", "x")]
    one, other = (trie.trie(spark.createDataFrame(r, TURNS), 3).collect() for r in (rows, rows[::-1]))
    assert sorted(map(tuple, one)) == sorted(map(tuple, other)) and max(r.n_convs for r in one) == 2


def documents(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = lambda: " ".join(rng.choice(["Word", "É", "x", "ABC", "\t"]) for _ in range(rng.randint(0, 30)))
    rows = [(i, words(), rng.choice(["en", None]), rng.choice(["hot"] * 6 + ["b", "É", "", None, "z🙂", "～"]), rng.randint(0, 9)) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "A", None, None, None), (3, "Again", "en", "hot", 1), (3, "Again", "en", "hot", 1), (-7, "Neg", "en", "alone", 5), (10_001, "long " * 40_000, "en", "hot", 2)]
    return rows


@pytest.mark.parametrize("n, height", [(0, 3), (40, 1), (600, 1), (700, 2), (300, 3)])
def test_merkle(spark, n, height):
    rows = documents(n, n)
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("tree", "nth", "digest", "total", "block")}).repartition(3)
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.manifest(df, bad, merkle.lower_cased(F.col("text")), height=height, proofs=True).collect()
    want = brute.merkle([(d, s, lang, c, t) for d, t, lang, s, c in rows])
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
    assert {r.verified for r in got} == ({True, False} if n else {True})
    for r in got:
        assert brute.sha("".join(r.proof)) == r.proof_sha256


def test_merkle_of_one_row_or_none(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    row = (1, "Text", "en", "s", 4)
    (got,) = merkle.manifest(spark.createDataFrame([row], DOCS)).collect()
    assert got.leaf == got.subroot == got.root and got.verified and got.proof_sha256 == brute.sha("")


def test_traversal_keeps_little():
    """Runs and stacks hold (arity + arity) nodes a level at most, and each step does one update a level."""
    leaves = [merkle.H(str(i)) for i in range(3**5 - 7)]
    seen = list((list(a), list(b)) for a, b in merkle.traversal(leaves, 5, 3))
    for i, (left, right) in enumerate(seen):
        node = leaves[i]
        for a, b in zip(left, right):
            node = merkle.H(a, node, b)
        assert node == merkle.H(*merkle.Treehash(leaves, 4, 0, 3).all())
    t = merkle.Treehash(leaves, 4, 0, 3)
    while t.at < t.end:
        t.update()
        assert sum(map(len, t.stack)) <= 3 * 5


@pytest.mark.parametrize("n", [0, 30, 400])
def test_curriculum(spark, n):
    rows = documents(n + 1, n)
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("size", "bucket", "draw", "weight", "copies")})
    plan = curriculum.scheduled(df)
    got = plan.collect()
    sizes, targets = brute.mixture([(d, s, t) for d, t, _, s, _ in rows])
    assert len(got) == len(rows) and sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    taken: dict = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 3 * r.size
        assert r.taken == sum(p.words for p in r.passes) and all(0 <= p.position < 1 for p in r.passes)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, curriculum.scheduled(df.repartition(5)).collect()))
    order = [r.position for r in curriculum.in_order(plan).collect()]
    assert order == sorted(order) and len(order) == sum(len(r.passes) for r in got)


def test_curriculum_follows_the_schedule(spark):
    """By each time, a source has given what the integral of its schedule asks for."""
    rows = [(i, " ".join(["w"] * 10), "en", "abc"[i % 3], 1) for i in range(3000)]
    plan = curriculum.scheduled(spark.createDataFrame(rows, DOCS))
    passes = [(r.source, p.position, p.words, r.target) for r in plan.collect() for p in r.passes]
    for source, weight in zip("abc", (5, 2, 1)):
        f, own = curriculum.SCHEDULES[weight], [p for p in passes if p[0] == source]
        for t in (0.1, 0.25, 0.5, 0.8):
            steps = 20_000
            value = lambda x, f=f: f[0] + (f[1] - f[0]) * 2 * x if x < 0.5 else f[1] + (f[2] - f[1]) * (2 * x - 1)
            share = sum(value((i + 0.5) / steps) for i in range(int(steps * t))) / sum(value((i + 0.5) / steps) for i in range(steps))
            assert sum(p[2] for p in own if p[1] < t) / own[0][3] == pytest.approx(share, abs=0.01)


def test_inverse_of_flat_pieces(spark):
    """Times without demand are passed over; a schedule may begin or end with none."""
    got = lambda u, f: spark.sql(f"SELECT {curriculum.inverted_sql(f'{u}D', f)} AS t").first().t
    assert got(0, "array(0D, 0D, 2D, 0D, 0D)") == pytest.approx(0.25) and got(0.5, "array(0D, 0D, 2D, 0D, 0D)") == pytest.approx(0.5)
    assert got(0.25, "array(1D, 1D)") == pytest.approx(0.25) and got(0.999999, "array(0D, 1D)") == pytest.approx(1, abs=1e-5)


def test_checksum_is_the_contracts(spark):
    assert spark.sql("SELECT crc32(cast('-7' AS binary)) AS c").first().c == zlib.crc32(b"-7")


def test_stages_leave_the_tables_of_other_queries(spark, sf):
    """A join built before the pipeline's stages and read after them, twice; the stages' own join leaves no table."""
    from pathlib import Path

    import corpus_pipeline
    from visbag.llm import common, jaccard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    join = jaccard.joined(docs)
    folders = lambda: {p.name for p in Path(common._tables(spark).removeprefix("file://")).parent.glob("passing-*")}
    kept = corpus_pipeline.without_near_copies(spark, docs, sf)
    other = corpus_pipeline.without_near_copies(spark, docs.where("doc_id < 100"), sf)
    assert folders() == set()
    third = corpus_pipeline.without_repeated_passages(spark, docs, sf)
    assert third.count() == docs.count() == join.count() and join.where("component_id is null").count() == 0
    assert 0 < other.count() < kept.count() < docs.count()
    with pytest.raises(ZeroDivisionError):
        with common.passing(spark):
            common.materialised(docs.select("doc_id"))
            1 / 0
    assert folders() == set() and kept.count() > 0
