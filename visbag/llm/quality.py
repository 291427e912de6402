"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics are counts over the bytes and words of the whole text (shares of symbols, capitals, repeated words and
so on), most of them as log(share + floor). Each class is a Gaussian whose covariance is shrunk towards the pooled
diagonal; the score is the posterior of label 1 from the difference of the two log densities, both Mahalanobis
terms by a Cholesky factor computed once at fitting time.

Fitting needs the labelled rows' moments only (class counts, sums, sums of products): summed in Spark over all
labelled rows, 2 x 90 numbers reach the driver. Scoring is a narrow pass. Null and empty texts have the statistics
of an empty text and get a score like any other; rows without labels or with labels other than 0 and 1 are not
learned from; without both classes the score is the share of label 1 (0.5 without labels). Repeated rows each count and
are each scored; a column of the name of the score is replaced, others pass through. Statistics are joined to labels, not
texts: the statistics of unlabelled rows cost less than a shuffle of the labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, released, sums
from .words import SPACED_LOWER, Words, text_slices

SHRINKAGE, RIDGE = 0.05, 1e-3
_CODE = np.zeros(256, np.uint8)  # classes of bytes
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b"!", b"|", b"\n", b" ", b".,;:'", b"\"#$%&()*+-/<=>?@[\\]^_`{}~", range(128, 256)), 1):
    _CODE[list(_bytes)] = _k
SIZE = 12


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of SIZE transformed statistics for each text."""
    code, n = _CODE[data], np.maximum(np.diff(offsets), 1)
    share = {k: sums(code == k, offsets) for k in range(1, 11)}
    words = Words(data, offsets, SPACED_LOWER)
    count, long = words.counts, words.end - words.start
    again = np.zeros(len(words), bool)
    again[1:] = words.hash[1:] == words.hash[:-1]
    again[words.first[:-1][count > 0]] = False
    w = np.maximum(count, 1)
    letters = np.maximum(share[1] + share[2] + share[10], 1)
    length = sums(long, words.first) / w
    return np.column_stack([
        np.log1p(count),
        np.log(share[1] / letters + 0.01),
        np.log(share[9] / n + 0.002),
        np.log(share[4] / n + 0.002),
        np.log(share[5] / n + 0.002),
        np.log(sums(again, words.first) / w + 0.005),
        np.log(share[3] / n + 0.005),
        length,
        np.log(sums(long.astype(np.float64) ** 2, words.first) / w - length**2 + 0.1),
        np.log(share[8] / w + 0.01),
        np.log(share[6] / w + 0.01),
        np.log(np.minimum(share[7] / w, 2) + 0.05),
    ])


def _statistics_of(batch: pa.RecordBatch) -> np.ndarray:
    parts = [statistics(data, offsets) for _, _, data, offsets in text_slices(batch, "text")]
    return np.concatenate(parts) if parts else np.zeros((0, SIZE))


@dataclass
class Discriminant:
    prior: float
    means: np.ndarray | None = None
    factors: tuple | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        log = []
        for mean, (inverse, half_log_det) in zip(self.means, self.factors):
            log.append(-0.5 * np.square((x - mean) @ inverse.T).sum(1) - half_log_det)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(np.clip(log[0] - log[1] - np.log(self.prior / (1 - self.prior)), -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """From every row of ``docs`` with a 0/1 label; a doc_id with several labels counts once for each."""
    features = columns(docs, doc_id="bigint", text="string").mapInArrow(_features, "doc_id bigint, x array<double>")
    marked = columns(labels, doc_id="bigint", **{label: "int"}).where(f"doc_id is not null and `{label}` in (0, 1)").select("doc_id", F.col(label).alias("y"))
    moments = features.where("doc_id is not null").join(marked, "doc_id").select("y", "x").mapInArrow(_moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    m = SIZE + 1
    total = np.zeros((2, m * m))
    for r in moments:
        total[r.y, r.i] = r.v
    total = total.reshape(2, m, m)
    n = total[:, 0, 0]
    if n.min() < 2:
        return Discriminant(float((n[1] + 1) / (n.sum() + 2)) if n.sum() else 0.5)
    means = total[:, 0, 1:] / n[:, None]
    cov = total[:, 1:, 1:] / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.diag(np.diag((cov * n[:, None, None]).sum(0) / n.sum())) + RIDGE * np.eye(SIZE)
    factors = []
    for c in cov:
        lower = np.linalg.cholesky((1 - SHRINKAGE) * c + SHRINKAGE * pooled)
        factors.append((np.linalg.inv(lower), float(np.log(np.diag(lower)).sum())))
    return Discriminant(float(n[1] / n.sum()), means, tuple(factors))


def _features(batches):
    released()
    for batch in batches:
        x = _statistics_of(batch)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(np.arange(0, x.size + 1, SIZE, dtype=np.int32), x.reshape(-1))], ["doc_id", "x"])


def _moments(batches):
    total = np.zeros((2, (SIZE + 1) ** 2))
    for batch in batches:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        x = np.column_stack([np.ones(len(y)), batch.column("x").flatten().to_numpy().reshape(len(y), SIZE)])
        for k in (0, 1):
            total[k] += (x[y == k].T @ x[y == k]).reshape(-1)
    size = total.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], size), pa.int32()), pa.array(np.tile(np.arange(size), 2), pa.int32()), pa.array(total.reshape(-1))], ["y", "i", "v"])


def scored(docs: DataFrame, model: Discriminant, column: str = "score") -> DataFrame:
    """``docs`` with the column ``column``: 0 to 1, higher where label 1 is likelier. Other columns pass through."""
    docs = docs.drop(column)
    schema = docs.select("*", F.lit(0.0).alias(column)).schema

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(_statistics_of(batch)))], [*batch.schema.names, column])
        released()

    return docs.mapInArrow(run, schema)
