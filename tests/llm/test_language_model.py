"""The language model's score, token by token, and what it gains over the base on held-out texts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from visbag.llm import gru, language_model
from visbag.llm.queries import QUERIES


def plain(m: gru.Model, symbols: list[int], tails: list[int]) -> list[float]:
    """Natural log probabilities of one document's symbols, a token at a time, in double precision."""
    h, before, out = np.zeros(gru.HIDDEN), 0, []
    w = {n: getattr(m, n).astype(np.float64) for n in m.shapes}
    for s, tail in zip(symbols, tails):
        a = w["inputs"][before]
        zr = 1 / (1 + np.exp(-(a[: 2 * gru.HIDDEN] + h @ w["gates"])))
        z, r = zr[: gru.HIDDEN], zr[gru.HIDDEN :]
        new = np.tanh(a[2 * gru.HIDDEN :] + (r * h) @ w["state"])
        h = z * h + (1 - z) * new
        logits = h @ w["class_w"] + w["class_b"]
        c = m.classes - 1 - s if s < 0 else s // m.width
        p = logits[c] - np.log(np.exp(logits).sum())
        if s >= 0:
            inner = h @ w["word_w"][c] + w["word_b"][c]
            p += inner[s % m.width] - np.log(np.exp(inner).sum())
        out.append(p)
        before = m.words + 1 + tail if s < 0 else s
    return out


def test_scores_token_by_token():
    rng = np.random.default_rng(3)
    m = gru.Model(60, groups=4, width=8)
    m.begin_at(np.arange(61) + 1, [5, 6, 7, 8])
    lengths = [3, 2500, 1, 40, 700]
    symbols = rng.integers(-4, 61, sum(lengths))
    tails, first = np.where(symbols < 0, -1 - symbols, 0), np.concatenate([[0], np.cumsum(lengths)])
    m.learn(symbols, tails, first)  # documents longer than a segment too
    got = m.log_probabilities(symbols, tails, first)
    for a, b in zip(first, first[1:]):
        assert np.allclose(got[a:b], plain(m, symbols[a:b].tolist(), tails[a:b].tolist()), atol=2e-3)


def test_held_out_gain(spark):
    rows = QUERIES["op5_lm_score"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert rows.score / rows.n > rows.base / rows.n + 0.05  # log10 a token
    print("held out, log10 a token:", rows.base / rows.n, rows.score / rows.n)


def test_segments_keep_what_came_before():
    m = gru.Model(5)
    symbols, first = np.arange(1, 3001) % 5 + 1, np.array([0, 3000])
    seen = np.concatenate([x.reshape(-1)[v.reshape(-1)] for x, _, _, _, _, v in m._windows(symbols, symbols * 0, first, 1000)])
    assert sorted(seen.tolist()) == sorted([0, *symbols[:-1].tolist()])
    fresh = sum(int(f[v].sum()) for _, _, f, _, _, v in m._windows(symbols, symbols * 0, first, 1000))
    assert fresh == 3 and language_model.KNOWN > 0 and math.isfinite(m.size)


def test_sums_of_runs():
    rng = np.random.default_rng(2)
    for most, keys in ((70_000, rng.integers(0, 70_000, 3000)), (40, np.minimum(rng.integers(0, 60, 3000), 40)), (3, np.zeros(1, np.int64)), (9, np.repeat(np.arange(9), gru.MANY + 1))):
        rows = rng.standard_normal((len(keys), 5)).astype(np.float32)
        order = gru._sorted(keys, most)
        assert (order == np.argsort(keys, kind="stable")).all()
        start = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        want = [rows[keys == k].astype(np.float64).sum(0) for k in np.unique(keys)]
        assert np.allclose(gru._sums(rows, order, start), want, atol=1e-3)


def test_gradients_are_those_of_the_probabilities():
    rng = np.random.default_rng(6)
    m = gru.Model(30, groups=4, width=8)
    m.load(m.flat + rng.standard_normal(m.size).astype(np.float32) * 0.2)
    symbols = rng.integers(-4, 31, 20)
    tails = np.where(symbols < 0, -1 - symbols, 0)
    x = np.concatenate([[0], np.where(symbols < 0, m.words + 1 + tails, symbols)[:-1]])
    grads = {n: np.zeros(s, np.float32) for n, s in m.shapes.items()}
    m.window(x[:, None], symbols[:, None], (np.arange(20) == 0)[:, None], np.zeros((1, gru.HIDDEN), np.float32), grads)
    for name in m.shapes:
        own, flat = getattr(m, name).reshape(-1), grads[name].reshape(-1)
        for i in np.argsort(-np.abs(flat))[:4].tolist():
            was, loss = own[i], []
            for d in (1e-2, -1e-2):
                own[i] = was + np.float32(d)
                loss.append(-sum(plain(m, symbols.tolist(), tails.tolist())))
            own[i] = was
            assert math.isclose(flat[i], (loss[0] - loss[1]) / 2e-2, rel_tol=0.02, abs_tol=1e-3), (name, i)
