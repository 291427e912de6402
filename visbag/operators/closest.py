"""The nearest words of rows, exact, by matrix products.

A product of matrices gives all squared distances of a tile of rows and words with a bounded error; only the words that
it cannot rule out are compared by differences, and these distances alone decide. Memory is that of a tile, however many
rows and words there are. Rows or words that are not finite, or so large that squares overflow, are compared in full.
"""

from __future__ import annotations

import numpy as np

ROWS, WORDS, PAIRS, LARGEST, SQUARED_BYTES = 512, 4096, 1 << 16, 1e37, 8 << 20


def squared(a: np.ndarray, centers: np.ndarray, rows: int = 64) -> np.ndarray:
    """Squared L2 distances: float differences and products, double sums."""
    out = np.empty((len(a), len(centers)))
    width = max(1, SQUARED_BYTES // (4 * rows * max(1, a.shape[1])))
    for i in range(0, len(a), rows):
        for j in range(0, len(centers), width):
            d = a[i : i + rows, None, :] - centers[None, j : j + width]
            out[i : i + rows, j : j + width] = np.square(d, out=d).sum(2, dtype=np.float64)
    return out


def best(words: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of each row; ties go to the smaller word."""
    k = min(k, dist.shape[1])
    order = np.lexsort((np.broadcast_to(words, dist.shape), dist), axis=1)[:, :k]
    return np.take_along_axis(np.broadcast_to(words, dist.shape), order, 1), np.take_along_axis(dist, order, 1)


def norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", a, a, dtype=np.float64))


def plain(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` products of matrices serve for."""
    with np.errstate(invalid="ignore", over="ignore"):
        largest = max((float(norms(centers[j : j + WORDS]).max()) for j in range(0, len(centers), WORDS)), default=0.0)
        if not np.isfinite(largest):  # the largest of some numbers and NaN may be either
            return np.zeros(len(x), bool)
        return np.square(norms(x) + largest) < LARGEST if np.isfinite(centers).all() else np.zeros(len(x), bool)


def closer(x: np.ndarray, words: np.ndarray, centers: np.ndarray, word: np.ndarray, dist: np.ndarray, bound: np.ndarray | None = None) -> None:
    """Puts what is nearer among ``words`` into ``word`` and ``dist`` (rows x k: the nearest so far, nearest first, where
    there are fewer infinite); ``bound``: distances beyond which no word counts."""
    for i in range(0, len(x), ROWS):
        a, at = x[i : i + ROWS], slice(i, i + ROWS)
        length, left = norms(a), np.column_stack([-2 * a, np.ones(len(a), np.float32)])
        for j in range(0, len(words), WORDS):
            c = centers[j : j + WORDS]
            size = norms(c)
            # error of the product and of the distances that decide, each at most half of it
            error = 2 * (x.shape[1] + 8) * 2.0**-24 * np.square(length + size.max()) + x.shape[1] * 1e-36
            near = left @ np.column_stack([c, np.square(size).astype(np.float32)]).T
            most = dist[at, -1] if bound is None else np.minimum(dist[at, -1], bound[at])
            limit = most + error - np.square(length)
            k = word.shape[1]
            if k <= len(c) and np.isinf(limit).any():
                limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * error)
            row, col = np.divmod(np.flatnonzero(near <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]), len(c))
            if len(row):
                d = np.concatenate([_apart(a[row[p : p + PAIRS]], c[col[p : p + PAIRS]]) for p in range(0, len(row), PAIRS)])
                _merged(word[at], dist[at], row, words[j : j + WORDS][col], d)


def _apart(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The distance of each row of ``a`` from that of ``c``, rounded as by ``squared``."""
    d = a - c
    return np.square(d, out=d).astype(np.float64).sum(1)


def _merged(word: np.ndarray, dist: np.ndarray, row: np.ndarray, w: np.ndarray, d: np.ndarray) -> None:
    k, rows = word.shape[1], np.unique(row)
    row, w, d = np.concatenate([np.repeat(rows, k), row]), np.concatenate([word[rows].reshape(-1), w]), np.concatenate([dist[rows].reshape(-1), d])
    order = np.lexsort((w, d, row))
    row, w, d = row[order], w[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    kept = rank < k
    word[row[kept], rank[kept]], dist[row[kept], rank[kept]] = w[kept], d[kept]


def closest(words: np.ndarray, centers: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """words and squared distances of the k nearest of each row (fewer: those there are), nearest first, ties by word."""
    k = min(k, len(words))
    word, dist = np.full((len(x), k), np.iinfo(np.int64).max), np.full((len(x), k), np.inf)
    serves = plain(x, centers)
    if serves.all():
        closer(x, words, centers, word, dist)
        return word, dist
    if serves.any():
        w, d = word[serves], dist[serves]
        closer(x[serves], words, centers, w, d)
        word[serves], dist[serves] = w, d
    rest, rows = np.flatnonzero(~serves), max(1, ROWS * WORDS // max(1, len(words)))
    for i in range(0, len(rest), rows):
        at = rest[i : i + rows]
        word[at], dist[at] = best(words, squared(x[at], centers), k)
    return word, dist
