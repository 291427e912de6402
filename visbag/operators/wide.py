"""Principal components of wide vectors: a randomised range finder with tall-skinny QR, never a dim x dim matrix.

Subspace iteration: a task sums X'(XQ) over its rows (dim x rank numbers), the driver makes the sum orthonormal again.
The last pass keeps XQ's triangular factor (a QR a block, stacked with the factor so far and reduced again, within a task
and then over the tasks) beside (XQ)'X; rank x dim numbers and the factor give directions and variances. Task results are
added in two levels, so that no group holds one of each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import projection

OVERSAMPLE, STEPS, PARTS, BLOCK = 10, 8, 64, 1 << 20
_PARTIAL = "what int, part int, v array<double>"
_SCHEMA = pa.schema([("what", pa.int32()), ("part", pa.int32()), ("v", pa.list_(pa.float64()))])
SUM, FACTOR = 0, 1


def _blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The vectors as double, about BLOCK numbers at a time."""
    c, at = batch.column(0), 0
    while at < len(c):
        step = max(1, BLOCK // max(1, len(c[at])))
        own = c.slice(at, step)
        yield own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
        at += step


def _factor(rows: np.ndarray) -> np.ndarray:
    """The triangular factor, square also if there are fewer rows than columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def _reduced(rows: DataFrame, of, rank: int) -> dict[int, np.ndarray]:
    """``of`` of each batch: arrays to add (SUM) and rows to factor (FACTOR, with ``rank`` columns), reduced over all rows."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in _blocks(batch):
                for what, v in of(x).items():
                    if what == FACTOR:
                        total[what] = _factor(np.vstack([total[what], v]) if what in total else v)
                    else:
                        total[what] = total[what] + v if what in total else v
        part = TaskContext.get().partitionId() % PARTS
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([part] * len(total), pa.int32()), pa.array([v.reshape(-1).tolist() for v in total.values()], _SCHEMA.field("v").type)], schema=_SCHEMA)

    def merged(table: pa.Table) -> pa.Table:
        vs = (x.values.to_numpy() for x in table.column("v"))
        if table.column("what")[0].as_py() == FACTOR:
            v = _factor(np.vstack([x.reshape(-1, rank) for x in vs])).reshape(-1)
        else:
            v = sum(vs)
        return pa.table([table.column("what")[:1], table.column("part")[:1], pa.array([v.tolist()], _SCHEMA.field("v").type)], schema=_SCHEMA)

    parts = rows.mapInArrow(run, _PARTIAL).groupBy("what", "part").applyInArrow(merged, _PARTIAL)
    return {r.what: np.array(r.v) for r in parts.groupBy("what").applyInArrow(merged, _PARTIAL).collect()}  # two rows at most


def pca(features: DataFrame, column: str, n: int, oversample: int = OVERSAMPLE, steps: int = STEPS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` principal directions (rows; the entry of the largest size is positive) and their variances.

    ``steps`` + 2 passes with dim x (n + oversample) numbers a task. The error of a direction falls by the ratio of the
    variance after the (n + oversample)-th to its own with each step; with n + oversample >= dim it is exact. Null vectors
    are left out; without rows there are no directions.
    """
    rows = features.where(F.col(column).isNotNull()).select(column)
    first = _reduced(rows, lambda x: {SUM: np.concatenate([[len(x)], x.sum(0)])}, 1).get(SUM)
    if first is None:
        return np.zeros((0, 0)), np.zeros(0)
    count, mean = first[0], first[1:] / first[0]
    dims = len(mean)
    rank = min(dims, n + oversample)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, rank)))[0]

    def across(x, q):
        x = x - mean
        return x, x @ q

    for _ in range(steps if rank < dims else 0):
        q_ = q

        def product(x, q=q_):
            x, y = across(x, q)
            return {SUM: x.T @ y}

        q = np.linalg.qr(_reduced(rows, product, rank)[SUM].reshape(dims, rank))[0]

    def last(x, q=q):
        x, y = across(x, q)
        return {SUM: y.T @ x, FACTOR: y}

    found = _reduced(rows, last, rank)
    r, w = found[FACTOR].reshape(rank, rank), found[SUM].reshape(rank, dims)
    b = np.linalg.pinv(r.T, rcond=1e-12) @ w  # rows of the orthonormal factor times X
    _, sizes, directions = np.linalg.svd(b, full_matrices=False)
    directions = directions[:n]
    sign = np.sign(directions[np.arange(len(directions)), np.abs(directions).argmax(1)])
    return directions * sign[:, None], sizes[:n] ** 2 / count


def ldp(features: DataFrame, column: str, label: str, n: int, inside: int, key: str = "feature_id", seed: int = 1, **options) -> tuple[np.ndarray, np.ndarray]:
    """``projection.ldp`` within the first ``inside`` principal directions: its moments are inside x inside numbers."""
    first, _ = pca(features, column, max(n, inside), seed=seed)
    rows, values = projection.ldp(projection.applied(features, first, column), column, label, n, key=key, seed=seed, **options)
    whole = rows @ first
    return whole / np.linalg.norm(whole, axis=1, keepdims=True), values
