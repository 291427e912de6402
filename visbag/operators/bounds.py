"""Assignment between the steps of k-means with triangle-inequality bounds, so that most distances are never computed.

A row keeps its word, an upper bound of the distance to it, and a lower bound of the distance to every other word. When
words move, bounds move by as much; a row whose upper bound is below its lower bound, or below half of the distance from
its word to the nearest other word, keeps its word unseen; next its own distance is computed, and only where that does
not settle it the distances to all words. Bounds count as met only beyond the rounding of the distances, so the words
are those that ``codebook.nearest_word`` gives, ties included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codebook import _matrix, squared

ROUNDING, CELLS = 1e-6, 1 << 20


class Step:
    """Words before (None at first) and after a step: what bounds need to know of them. Ids in rising order."""

    def __init__(self, ids: np.ndarray, centers: np.ndarray, before: np.ndarray | None):
        self.ids, self.centers = ids, centers
        self.norm = float(np.sqrt((centers.astype(np.float64) ** 2).sum(1)).max())
        self.half = np.full(len(ids), np.inf)
        for i in range(0, len(ids), part := max(1, CELLS // len(ids))):
            d = squared(centers[i : i + part], centers)
            d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
            self.half[i : i + part] = np.sqrt(d.min(1)) / 2
        if before is None:
            return
        self.moved = np.sqrt(((centers.astype(np.float64) - before) ** 2).sum(1))
        most = int(self.moved.argmax())
        self.others = np.full(len(ids), self.moved[most])  # how far any other word has moved at most
        self.others[most] = np.delete(self.moved, most).max(initial=0.0)

    def sure(self, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        bound = np.maximum(lower, self.half[at])
        return upper + ROUNDING * (self.norm + upper) < bound * (1 - ROUNDING)

    def assigned(self, x: np.ndarray, at: np.ndarray | None, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Places of the words, bounds, and how many distances were computed."""
        compared, rest = 0, np.arange(len(x))
        if at is None:
            at, upper, lower = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x))
        else:
            upper, lower = upper + self.moved[at], np.maximum(lower - self.others[at], 0)
            rest = np.flatnonzero(~self.sure(at, upper, lower))
            d = x[rest] - self.centers[at[rest]]
            upper[rest] = np.sqrt(np.square(d, out=d).sum(1, dtype=np.float64))
            compared += len(rest)
            rest = rest[~self.sure(at[rest], upper[rest], lower[rest])]
        for i in range(0, len(rest), part := max(1, CELLS // len(self.ids))):
            own = rest[i : i + part]
            d = squared(x[own], self.centers)
            at[own] = d.argmin(1)  # the first of equals is the smaller word
            k = np.arange(len(own))
            upper[own] = np.sqrt(d[k, at[own]])
            d[k, at[own]] = np.inf
            lower[own] = np.sqrt(d.min(1))
        return at, upper, lower, compared + len(rest) * len(self.ids)


def assigned(rows: DataFrame, step: Step, descriptor: str = "descriptor") -> DataFrame:
    """``rows`` with word, upper, lower and compared (distances computed in this step). Rows that have a word from the step
    before bring their bounds; null descriptors have a null word."""
    first = "word" not in rows.columns
    keep = [c for c in rows.columns if c not in ("word", "upper", "lower", "compared")]
    kinds = {"word": "int", "upper": "double", "lower": "double", "compared": "bigint"}
    schema = rows.select(*keep).withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()}).schema

    def run(batches):
        for batch in batches:
            valid = batch.column(descriptor).is_valid().to_numpy(zero_copy_only=False)
            there = pa.array(np.flatnonzero(valid))
            word, upper, lower, compared = np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            if len(there):
                own = [batch.column(c).take(there).to_numpy(zero_copy_only=False).copy() for c in ("word", "upper", "lower")] if not first else [None, np.zeros(0), np.zeros(0)]
                at = None if first else np.searchsorted(step.ids, own[0])
                at, up, low, n = step.assigned(_matrix(batch.column(descriptor).take(there)), at, own[1], own[2])
                word[valid], upper[valid], lower[valid] = step.ids[at], up, low
                compared[np.flatnonzero(valid)[0]] = n  # the batch's number, in its first row
            none = ~valid
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(word, pa.int32(), mask=none), pa.array(upper, mask=none), pa.array(lower, mask=none), pa.array(compared, mask=none)], [*keep, *kinds])

    return rows.mapInArrow(run, schema)
