"""The Jaccard join at its edges: filters, frequent shingles, null ids, other ratios."""

from __future__ import annotations

import random

import brute
import numpy as np
from test_operators import by_id, frame

from visbag.llm import jaccard
from visbag.llm.jaccard import Join


def near_copies(seed: int, n: int, words: int, edit: float) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(80)]
    rows, sources = [], [[rng.choice(vocabulary) for _ in range(rng.randint(words // 2, words))] for _ in range(6)]
    for i in range(n):
        base = rng.choice(sources)
        text = [w if rng.random() > edit else rng.choice(vocabulary) for w in base]
        rows.append((i, " ".join(text[rng.randint(0, 3) : len(text) - rng.randint(0, 3)])))
    return rows


def test_links_by_ratio(spark, monkeypatch):
    join = Join(5, 4, 5)
    rows = near_copies(join.words, 120, 60, 0.02) + [(500, None), (501, "a b"), (502, "a  B"), (503, "")]
    want = brute.components(rows, join.words, join.over, join.under)
    table = frame(spark, rows).repartition(5)
    assert by_id(jaccard.joined(table, join), "n_shingles", "component_id") == want
    monkeypatch.setattr(jaccard, "LIST", -1)  # every shingle counts as frequent: all lists are chained
    monkeypatch.setattr(jaccard.math, "sqrt", lambda x: 0.0)
    assert by_id(jaccard.joined(table, join, family=500, members=8), "n_shingles", "component_id") == want


def test_filters_lose_no_link():
    rng = np.random.default_rng(2)
    join, rank = Join(), rng.permutation(1 << 16)
    for _ in range(60):
        n = int(rng.integers(9, 120))
        x = rng.choice(2**62, n, replace=False).astype(np.uint64)
        y = x.copy()
        change = int(rng.integers(0, n // 9 + 1))
        y[:change] = rng.choice(2**62, change, replace=False).astype(np.uint64)
        y = y[int(rng.integers(0, 2)) :]
        both = len(np.intersect1d(x, y))
        entries = []
        for k, z in enumerate((x, y)):
            z = z[np.lexsort((z, rank[(z % np.uint64(1 << 16)).astype(np.int64)]))]
            p = join.prefix_length(len(z))
            entries.append((z[:p], np.full(p, k), np.arange(p, dtype=np.int32), np.full(p, len(z), np.int32), jaccard.signatures(z, p)))
        lists = jaccard.Lists(join, *(np.concatenate(e) for e in zip(*entries)))
        sketches = [jaccard.sketch(z) for k, z in enumerate((x, y)) for _ in entries[k][0]]
        if 100 * both >= 90 * (len(x) + len(y) - both) and len(y) >= join.least:
            assert jaccard.partnered(lists).sum() >= 2 and len(jaccard.forest(lists, sketches)[0]) == 1
    # unrelated sets that share one rare shingle fall to the suffix filter
    x, y = (np.concatenate([[np.uint64(5)], rng.choice(2**62, 199, replace=False).astype(np.uint64)]) for _ in range(2))
    entries = [(z[:1], np.full(1, k), np.zeros(1, np.int32), np.full(1, 200, np.int32), jaccard.signatures(z, 1)) for k, z in enumerate((x, y))]
    assert not jaccard.partnered(jaccard.Lists(join, *(np.concatenate(e) for e in zip(*entries)))).any()


def test_chains_cover_intervals():
    # a task's chain 100 .. 150 is sent by its ends; another task's entry of 125 lies within it
    sizes, places = np.array([100, 150, 125, 200], np.int32), np.array([jaccard.OPENS, jaccard.ENDS, jaccard.ALONE, jaccard.ALONE], np.int32)
    lists = jaccard.Lists(Join(), np.full(4, 7, np.uint64), np.arange(4), places, sizes, np.zeros(4, np.uint64))
    assert {frozenset(x) for x in zip(*(lists.class_[k].tolist() for k in lists.chain()))} == {frozenset((0, 2)), frozenset((2, 1))}


def test_null_ids_carry_links(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = words[:54], words[2:56], words[4:58]  # a - b and b - c link, a - c do not
    rows = [(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c)), (None, "alone in all"), (None, None), (-3, "one of its own"), (2, "another text")]
    assert brute.components([(1, rows[0][1]), (2, rows[2][1])])[2][1] == 2
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.joined(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(False, 1, 52, 1), (True, 0, 52, 1), (False, 2, 52, 1), (True, 0, 1, None), (True, 0, 0, None), (False, -3, 2, -3), (False, 2, 1, 2)], key=str)
