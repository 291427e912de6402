"""Nearest words by a kd-tree with a limit on the words compared: best bin first, for a batch of features at once.

The tree is flat arrays: each node has the box of its words, inner ones a dimension (of the largest variance) and a cut
(the median), leaves a range of at most LEAF words. A search takes, again and again, the branch whose box is nearest to
the feature, goes down to a leaf, leaving the other sides as branches, and compares the leaf's words. It ends when no
branch can hold a nearer word or when the limit is reached. All features of a batch take their steps together.

Without a limit the search is exact: SEEDS words compared as above bound the distance of the k-th nearest, and the
features that a box of at most BOX words can then hold a nearer word for are compared with the box's words together, by
a product of matrices (``closest``). In many dimensions boxes rule little out; nearly all words are compared then.
"""

from __future__ import annotations

import numpy as np

from .closest import closer, plain

LEAF, ROWS, PENDING = 8, 256, 128
SEEDS, BOX = 40, 512


class KdTree:
    def __init__(self, words: np.ndarray, centers: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(words))
        nodes: list[tuple[int, int]] = [(0, len(words))]
        dims, cuts, left = [], [], []
        low, high = [], []
        at = 0
        while at < len(nodes):
            begin, end = nodes[at]
            part = centers[order[begin:end]]
            low.append(part.min(0))
            high.append(part.max(0))
            dim = int(part.var(0).argmax())
            if end - begin <= leaf or low[-1][dim] == high[-1][dim]:  # equal words are not told apart: a leaf of any size
                dims.append(-1)
                cuts.append(0.0)
                left.append(-1)
            else:
                middle = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(part[:, dim], middle)]
                dims.append(dim)
                cuts.append(centers[order[begin + middle], dim])
                left.append(len(nodes))
                nodes += [(begin, begin + middle), (begin + middle, end)]
            at += 1
        self.words, self.centers = words[order], centers[order]
        self.begin, self.end = np.array(nodes).T
        self.dim, self.cut, self.left = np.array(dims), np.array(cuts, np.float32), np.array(left)
        self.low, self.high = np.array(low, np.float32), np.array(high, np.float32)
        # the boxes that are compared whole: parts of all words
        small, inner = self.end - self.begin <= BOX, np.flatnonzero(self.dim >= 0)
        above = np.full(len(nodes), -1)
        above[self.left[inner]] = above[self.left[inner] + 1] = inner
        self.boxes = np.flatnonzero((small | (self.dim < 0)) & ((above < 0) | ~small[above]))

    def __len__(self) -> int:
        return len(self.words)

    def box(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distance to each node's box, rounded as those to its words: never more than the least of them."""
        d = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        return np.square(d, out=d).sum(1, dtype=np.float64)

    def search(self, features: np.ndarray, k: int, visits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """words and squared distances of the k nearest (fewer: those there are), nearest first, ties by word, and the
        number of words compared. At least k words are compared whatever the limit."""
        k = min(k, len(self))
        if visits is None and plain(features, self.centers).all():
            parts = [self._whole(features[i : i + 2 * ROWS], k) for i in range(0, len(features), 2 * ROWS)]
        else:
            limit = len(self) if visits is None else max(visits, k)
            parts = [self._search(features[i : i + ROWS], k, limit) for i in range(0, len(features), ROWS)]
        return tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros((0, k), np.int64), np.zeros((0, k)), np.zeros(0, np.int64))

    def _whole(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bound = self._search(x, k, max(SEEDS, k))[1][:, -1]
        word, dist = np.full((len(x), k), np.iinfo(np.int64).max), np.full((len(x), k), np.inf)
        compared = np.zeros(len(x), np.int64)
        for node in self.boxes.tolist():
            there = np.flatnonzero(self.box(x, np.array([node])) <= np.minimum(bound, dist[:, -1]))
            if len(there):
                part = slice(self.begin[node], self.end[node])
                w, d = word[there], dist[there]
                closer(x[there], self.words[part], self.centers[part], w, d, bound[there])
                word[there], dist[there] = w, d
                compared[there] += part.stop - part.start
        return word, dist, compared

    def _search(self, x: np.ndarray, k: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(x)
        word, dist = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.inf)
        compared, used = np.zeros(n, np.int64), np.ones(n, np.int64)
        bound, branch = np.full((n, PENDING), np.inf), np.zeros((n, PENDING), np.int64)
        bound[:, 0] = 0
        while True:
            best = bound.argmin(1)
            go = np.flatnonzero((bound[np.arange(n), best] <= dist[:, -1]) & np.isfinite(bound[np.arange(n), best]) & (compared < limit))
            if not len(go):
                return word, dist, compared
            node = branch[go, best[go]]
            bound[go, best[go]] = np.inf
            inner = np.arange(len(go))
            while len(inner := inner[self.dim[node[inner]] >= 0]):
                rows, at = go[inner], node[inner]
                right = x[rows, self.dim[at]] >= self.cut[at]
                if used[rows].max() == bound.shape[1]:
                    bound, branch, used = self._kept(bound, branch, dist[:, -1])
                other = self.left[at] + ~right
                bound[rows, used[rows]], branch[rows, used[rows]] = self.box(x[rows], other), other
                used[rows] += 1
                node[inner] = self.left[at] + right
            begin, many = self.begin[node], self.end[node] - self.begin[node]
            for first in range(0, int(many.max()), LEAF):  # leaves of equal words may be long
                at = begin[:, None] + first + np.arange(min(LEAF, int(many.max()) - first))
                there = at < self.end[node][:, None]
                at = np.minimum(at, len(self) - 1)
                d = x[go][:, None, :] - self.centers[at]
                d = np.where(there, np.square(d, out=d).sum(2, dtype=np.float64), np.inf)
                w = np.where(there, self.words[at], np.iinfo(np.int64).max)
                all_w, all_d = np.concatenate([word[go], w], 1), np.concatenate([dist[go], d], 1)
                order = np.lexsort((all_w, all_d), axis=1)[:, :k]
                word[go], dist[go] = np.take_along_axis(all_w, order, 1), np.take_along_axis(all_d, order, 1)
            compared[go] += many

    @staticmethod
    def _kept(bound: np.ndarray, branch: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Branches that can still hold a nearer word, in front, with room for as many again."""
        bound = np.where(bound <= most[:, None], bound, np.inf)
        order = np.argsort(bound, axis=1)
        bound, branch = np.take_along_axis(bound, order, 1), np.take_along_axis(branch, order, 1)
        used = np.isfinite(bound).sum(1)
        width = max(PENDING, 2 * int(used.max()))
        room = width - bound.shape[1]
        if room > 0:
            bound, branch = np.pad(bound, ((0, 0), (0, room)), constant_values=np.inf), np.pad(branch, ((0, 0), (0, room)))
        return bound[:, :width], branch[:, :width], used
