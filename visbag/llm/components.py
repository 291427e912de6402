"""Connected components by alternating large-star and small-star rounds over edge tables.

Each round is two aggregations with joins, written to the shared folder, so no lineage grows and nothing but a
count and a checksum reaches the driver. Tasks first replace their edges by a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised

FOREST_EDGES, SALTS = 200_000, 8
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Union:
    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        if x not in parent:
            return x
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.parent[y] = x
        return True


def forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the task's edges, in pieces that fit in memory."""
    union = Union()

    def edges():
        pairs = [(union.root(x), x) for x in list(union.parent)]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], schema=_EDGES)

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            union.join(a, b)
        if len(union.parent) >= FOREST_EDGES:
            yield edges()
            union = Union()
    yield edges()


def _salted(edges: DataFrame, node: str, other: str, found: DataFrame) -> DataFrame:
    """``edges`` joined to ``found`` (a row for each ``node``); the edges of one node are dealt over SALTS tasks."""
    found = found.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS))).join(found, [node, "salt"]).drop("salt")


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (a, b)."""
    edges = materialised(edges.select("a", "b").where("a <> b").mapInArrow(forest, "a bigint, b bigint"))
    before = None
    while True:
        # large star: a node's larger neighbours move to its least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _salted(both.where("b > a"), "a", "b", least).where("b <> m").select(F.col("m").alias("a"), "b").distinct()
        # small star: a node and its smaller neighbours move to the least of them; edges are (smaller, larger)
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = _salted(large, "b", "a", down).selectExpr("m as a", "case when a = m then b else a end as b").where("a <> b").distinct()
        edges = materialised(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.selectExpr("b as node", "a as root").unionByName(edges.selectExpr("a as node", "a as root").distinct())
