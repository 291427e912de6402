"""The discriminant against a plain one, and decontamination's windows against a plain count."""

from __future__ import annotations

import math
import random

import brute
import numpy as np
from test_operators import by_id, frame

from visbag.llm import decontaminate, quality


def test_discriminant_against_plain(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["good", "Words", "a", "!!!", "BUY", "x1"][: 4 if i % 2 else 6]) for _ in range(rng.randint(3, 60)))) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, quality int")
    got = by_id(quality.scored(frame(spark, rows).select("doc_id", "text", "lang").withColumnRenamed("lang", "score"), quality.fit(frame(spark, rows), labels)), "score")
    x = {}
    for i, t in rows:
        data = t.encode()
        x[i] = quality.statistics(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    groups = [np.array([x[i] for i in range(100) if i % 2 == k]) for k in (0, 1)]
    cov = [np.cov(g, rowvar=False, bias=True) for g in groups]
    pooled = np.diag(sum(len(g) * np.diag(c) for g, c in zip(groups, cov)) / 100) + quality.RIDGE * np.eye(quality.SIZE)
    cov = [(1 - quality.SHRINKAGE) * c + quality.SHRINKAGE * pooled for c in cov]
    for i, _ in rows:
        log = []
        for g, c in zip(groups, cov):
            d = x[i] - g.mean(0)
            log.append(-0.5 * d @ np.linalg.solve(c, d) - 0.5 * np.linalg.slogdet(c)[1])
        assert math.isclose(got[i][0], 1 / (1 + math.exp(min(700, log[0] - log[1]))), rel_tol=1e-6, abs_tol=1e-9)


def test_windows_of_many_items(spark):
    rng = random.Random(8)
    words = [f"b{i}" for i in range(30)]
    items = [(str(i % 25), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 12, 13, 14, 40])))) for i in range(60)] + [("z", None)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(20)) + " " + (rng.choice(items[:60])[1] or "")) for i in range(40)]
    want = brute.contamination(docs, items)
    found = decontaminate.judged(decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id string, text string"), block_bytes=700)).collect()
    for r in found:
        hit = sum(s["to"] - s["from"] for s in r.spans)
        assert (r.n_words, hit, len(r["items"]), brute.sha(",".join(sorted(r["items"]))), r.contaminated) == want[r.doc_id]
