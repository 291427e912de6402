"""Assignment of features to codebook words: exact and approximate nearest neighbours, the average word distance.

A codebook (word, center, with an optional projection before it) is small by nature; it goes to the tasks in blocks
of at most BLOCK_BYTES, each a narrow pass over the features that merges the best words so far. No row is made for a
pair of feature and word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .closest import best as _best  # noqa: F401
from .closest import closest, squared  # noqa: F401
from .kdtree import KdTree

BLOCK_BYTES, NEIGHBOURS, AVERAGED, VISITS = 64 << 20, 32, 10_000, 200
RESULTS = {"words": "array<int>", "distances": "array<double>", "compared": "bigint"}


def blocks(codebook: DataFrame, block_bytes: int = BLOCK_BYTES):
    """(words, centers) in blocks of bounded size, by word."""
    size = codebook.agg(F.count("*"), F.max(F.size("center"))).first()
    if not size[0]:
        return
    per = max(1, block_bytes // (4 * max(1, size[1] or 1)))
    if size[0] <= per:
        parts = [codebook]
    else:
        n = -(-size[0] // per) * 2
        parts = [codebook.where(F.pmod(F.xxhash64("word"), F.lit(n)) == k) for k in range(n)]
    for part in parts:
        rows = sorted(part.select("word", "center").collect(), key=lambda r: r.word)
        if rows:
            yield np.array([r.word for r in rows], np.int64), np.array([r.center for r in rows], np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float32, copy=False)


def nearest(features: DataFrame, codebook: DataFrame, k: int = NEIGHBOURS, descriptor: str = "descriptor", exclude: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``features`` with ``words`` and ``distances``: the k nearest words and squared L2 distances, nearest first.

    k beyond the number of words gives all of them. ``exclude`` names a column whose word is left out. Null
    descriptors get null arrays.
    """
    out = _passes(features, codebook, k + bool(exclude), descriptor, block_bytes, lambda words, centers: lambda x, k: closest(words, centers, x, k))
    if exclude:
        both = F.slice(F.filter(F.arrays_zip("words", "distances"), lambda s: s.words != F.col(exclude)), 1, k)
        out = out.withColumns({"words": F.transform(both, lambda s: s.words), "distances": F.transform(both, lambda s: s.distances)})
    return out.select(*features.columns, "words", "distances")


def approximate_nearest(features: DataFrame, codebook: DataFrame, k: int, visits: int | None = VISITS, descriptor: str = "descriptor", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``features`` with ``words`` and ``distances`` as ``nearest`` gives them, by a kd-tree that compares at most
    ``visits`` words (a leaf more; k at least) with a feature in each block of the codebook, and ``compared``, the number
    of them. Without a limit the result is exact."""

    def searched(words, centers):
        tree = KdTree(words, centers)
        return lambda x, k: tree.search(x, k, visits)

    return _passes(features, codebook, k, descriptor, block_bytes, searched, compared=True)


def _passes(features: DataFrame, codebook: DataFrame, k: int, descriptor: str, block_bytes: int, searcher, compared: bool = False) -> DataFrame:
    """A pass for each block of the codebook; ``searcher`` makes of a block what finds the k nearest words of a matrix's
    rows: words, distances and, if ``compared``, words compared. These are added to the columns of ``features``, which
    must not have them yet."""
    added = RESULTS if compared else {c: t for c, t in RESULTS.items() if c != "compared"}
    if taken := sorted({c.lower() for c in features.columns} & added.keys()):
        raise ValueError(f"features have columns of the result: {', '.join(taken)}")
    out, found = features, False
    for words, centers in blocks(codebook, block_bytes):
        if found:  # each pass's result is written, so that the driver and the plan hold one block at a time
            out = written(out)
        out = _pass(out, features.columns, added, searcher(words, centers), k, descriptor, found)
        found = True
    if not found:
        out = out.withColumns({c: (F.lit(0) if c == "compared" else F.array()).cast(t) for c, t in added.items()})
    return out


def _lists(values: np.ndarray, there: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """A list for each row that is there, from a matrix of theirs; null for the others."""
    sizes = np.zeros(rows + 1, np.int32)
    sizes[there + 1] = values.shape[1] if len(there) else 0
    missing = np.ones(rows, bool)
    missing[there] = False
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(values.reshape(-1), kind), mask=pa.array(missing))


def _pass(features: DataFrame, keep: list[str], added: dict[str, str], search, k: int, descriptor: str, more: bool) -> DataFrame:
    schema = features.select(*keep).withColumns({c: F.lit(None).cast(t) for c, t in added.items()}).schema

    def run(batches):
        for batch in batches:
            column = batch.column(descriptor)
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            w, d, n = np.zeros((0, 0), np.int64), np.zeros((0, 0)), [np.zeros(0, np.int64)]
            if len(there):
                w, d, *n = search(_matrix(column.take(pa.array(there))), k)
                if more:
                    old_w, old_d = (batch.column(c).take(pa.array(there)).flatten().to_numpy().reshape(len(there), -1) for c in ("words", "distances"))
                    all_w, all_d = np.concatenate([old_w, w], 1), np.concatenate([old_d, d], 1)
                    order = np.lexsort((all_w, all_d), axis=1)[:, :k]
                    w, d = np.take_along_axis(all_w, order, 1), np.take_along_axis(all_d, order, 1)
                    if "compared" in added:
                        n = [n[0] + batch.column("compared").take(pa.array(there)).to_numpy()]
            found = [_lists(w, there, len(column), pa.int32()), _lists(d, there, len(column), pa.float64())]
            if "compared" in added:
                compared = np.zeros(len(column), np.int64)
                compared[there] = n[0]
                found.append(pa.array(compared, mask=~np.isin(np.arange(len(column)), there)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [*keep, *added])

    return features.mapInArrow(run, schema)


def long_form(assigned: DataFrame) -> DataFrame:
    """A row for each neighbour: the other columns, rank (1-based), word, distance."""
    keep = [c for c in assigned.columns if c not in ("words", "distances")]
    return assigned.select(*keep, F.posexplode(F.arrays_zip("words", "distances")).alias("at", "pair")).select(*keep, (F.col("at") + 1).alias("rank"), F.col("pair.words").alias("word"), F.col("pair.distances").alias("distance"))


def nearest_word(features: DataFrame, codebook: DataFrame, descriptor: str = "descriptor") -> DataFrame:
    """``features`` with word and distance of the nearest word; the smaller word wins ties."""
    out = nearest(features, codebook, 1, descriptor)
    return out.select(*features.columns, F.get("words", F.lit(0)).alias("word"), F.get("distances", F.lit(0)).alias("distance"))


def nearest_join(features: DataFrame, codebook: DataFrame, k: int, key: str = "feature_id") -> DataFrame:
    """The same by built-in expressions alone, for a codebook of checked size: key, rank, word, distance."""
    from ..functions.distance import l2sq

    if codebook.count() > AVERAGED:
        raise ValueError("use nearest() for a codebook of this size")
    pairs = features.select(key, "descriptor").join(F.broadcast(codebook)).select(key, "word", l2sq(F.col("descriptor"), F.col("center")).alias("distance"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance", "word"))).where(F.col("rank") <= k)


def average_word_distance(codebook: DataFrame, estimate: int = AVERAGED, seed: int = 1) -> DataFrame:
    """One row, avg_word_distance: mean squared distance of words to their nearest other word, over at most
    ``estimate`` words drawn without replacement (all of them if there are fewer)."""
    drawn = codebook.orderBy(F.xxhash64("word", F.lit(seed)), "word").limit(estimate).select(F.col("word").alias("own"), F.col("center").alias("descriptor"))
    return nearest(drawn, codebook, 1, exclude="own").agg(F.avg(F.get("distances", F.lit(0))).alias("avg_word_distance"))
