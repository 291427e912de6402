"""Substring dedup at its edges."""

from __future__ import annotations

import brute
from test_operators import by_id, frame

from visbag.llm import substring


def test_substring_extreme_ids(spark):
    low, high, text = -(2**63), 2**63 - 1, [" ".join(f"{k}{i}" for i in range(20)) for k in "abcdef"]
    rows = [(-5, text[0]), (1, text[0]), (low, text[1]), (high, text[1]), (-1, text[2]), (0, text[2] + " more"), (2, text[4])]
    got = by_id(substring.deduplicated(frame(spark, rows)), "n_words", "n_removed", "kept")
    assert {d: (n, r, brute.sha(t)) for d, (n, r, t) in got.items()} == brute.removals(rows) and got[1][1] == 20
    # the largest bigint owns before a null; nulls own nothing
    found = substring.deduplicated(frame(spark, [(high, text[3]), (None, text[3]), (None, text[5]), (None, text[5])])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in found) == [(False, 0), (True, 0), (True, 0), (True, 20)]
