"""Merkle manifest of a dataset: a hash tree over each source, one over the sources, and a proof for every row.

A row's leaf is the SHA-256 of its fields, each written as `-` (null) or as its UTF-8 byte count, `:`, value. Leaves of a
source ascend by doc_id (null first; equal ones by leaf); every ARITY consecutive nodes (fewer at the end, even one)
become the SHA-256 of their hex digests, until one is left, the source's subroot. Subroots in the order of the sources
(null first, bytewise) give the root in the same way.

1. Leaves are computed by Spark's functions and kept as narrow rows; texts are never shuffled.
2. Range partitions by (source, doc_id, leaf) number a source's leaves; counts of (partition, source) carry the numbers
   over the partitions, so that a source of any size spreads over many of them. Rows that are equal in all of it are told
   apart by where they were read, so they spread too.
3. Aligned blocks of SPAN = ARITY ** HEIGHT leaves meet in one row. Their tops are the leaves of a tree SPAN times
   smaller, in blocks again, until every source has one block: a job for each HEIGHT levels.
4. Paths come down the same way: a block gets the path from its top to the root, once for all its leaves, and a traversal
   advances the authentication path from leaf to leaf. On every level it keeps the run of nodes that holds the leaf's
   ancestor, and a treehash, a stack of unfinished runs, that takes one leaf a step and so has the next run ready when the
   present one is used up: memory in proportion to the number of levels, constant work a leaf and level.

An empty table gives an empty result; a null doc_id is never tampered with; repeated rows are leaves each; columns other
than those of the leaf are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, materialised, tasks_for

ARITY, HEIGHT = 16, 3
FIELDS = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}
PER_TASK = 500_000


def H(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def height_of(nodes: int, arity: int = ARITY) -> int:
    """Levels above so many nodes of a tree."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // arity), levels + 1
    return levels


class Treehash:
    """Builds the run of nodes of ``level`` above the leaves from ``at`` on; ``update`` takes one leaf."""

    def __init__(self, leaves: list[str], level: int, at: int, arity: int):
        self.leaves, self.arity, self.at = leaves, arity, at
        self.end = min(at + arity ** (level + 1), len(leaves))
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def update(self) -> None:
        if self.at < self.end:
            self.stack[0].append(self.leaves[self.at])
            self.at += 1
            for lower, upper in zip(self.stack, self.stack[1:]):
                if len(lower) < self.arity and self.at < self.end:
                    break
                if lower:
                    upper.append(H(*lower))
                    lower.clear()

    def all(self) -> list[str]:
        while self.at < self.end:
            self.update()
        return self.stack[-1]


def traversal(leaves: list[str], height: int, arity: int = ARITY) -> Iterator[tuple[list[str], list[str]]]:
    """For each leaf of a block: what stands left and right of its ancestor on every level below the block's top."""
    spans = [arity ** (level + 1) for level in range(height)]
    runs = [Treehash(leaves, level, 0, arity).all() for level in range(height)]
    coming = [Treehash(leaves, level, spans[level], arity) for level in range(height)]
    left, right = [""] * height, [""] * height
    for i in range(len(leaves)):
        for level in range(height):
            if i % (spans[level] // arity):
                break  # neither this level's node nor those above have changed
            if i and i % spans[level] == 0:
                runs[level] = coming[level].all()
                coming[level] = Treehash(leaves, level, i + spans[level], arity)
            j = i // (spans[level] // arity) % arity
            left[level], right[level] = "".join(runs[level][:j]), "".join(runs[level][j + 1 :])
        yield left, right
        for t in coming:
            t.update()


def leaf(text: Column) -> Column:
    """The leaf's digest (binary) of a row whose text is ``text``."""
    values = [F.col(c).cast("string") if c != "text" else text for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (narrow, with ``tree``), with ``nth``, the gapless number in its tree by ``order``, and ``total``, the
    tree's rows."""
    many = tasks_for(rows.sparkSession, rows.count(), PER_TASK)
    spread = rows.withColumn("read_at", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(many, "tree", *order, "read_at").sortWithinPartitions("tree", *order, "read_at").drop("read_at")
    ordered = materialised(ordered.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.expr("shiftright(at, 33)"))
    parts = ordered.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", "tree", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("total"))
    return ordered.join(parts, ["part", "tree"]).withColumn("nth", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def blocks(nodes: DataFrame, span: int, *payload: str) -> DataFrame:
    """tree, block, total, nodes: arrays of up to ``span`` consecutive (nth, digest, payload)."""
    packed = F.array_sort(F.collect_list(F.struct("nth", "digest", *payload))).alias("nodes")
    return materialised(nodes.groupBy("tree", F.expr(f"nth div {span}").alias("block"), "total").agg(packed))


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[list[str]]:
    """The hex digests of each row's nodes."""
    column = batch.column("nodes")
    values = column.flatten().field(name)
    ends = column.offsets.to_pylist()
    base = ends[0]
    for a, b in zip(ends, ends[1:]):
        yield [v and v.hex() for v in values[a - base : b - base].to_pylist()]


def _height(total: int, span: int, arity: int, height: int) -> int:
    return height if total > span else height_of(total, arity)


def tops(packed: DataFrame, arity: int, height: int) -> DataFrame:
    """The tops of blocks as nodes: tree, nth, digest, total."""
    span = arity**height

    def top(batches):
        for batch in batches:
            out = []
            for leaves, total in zip(_lists(batch, "digest"), batch.column("total").to_pylist()):
                h = _height(total, span, arity, height)
                out.append(bytes.fromhex(H(*Treehash(leaves, h - 1, 0, arity).all()) if h else leaves[0]))
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array(out, pa.binary()), batch.column("total")], ["tree", "nth", "digest", "total"])

    found = packed.mapInArrow(top, "tree string, nth bigint, digest binary, total bigint")
    return found.withColumn("total", F.expr(f"(total + {span - 1}) div {span}"))


def climbed(nodes: DataFrame, arity: int, height: int, *payload: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of all levels, from the leaves up, and the top of each tree (tree, digest)."""
    levels = [blocks(nodes, arity**height, *payload)]
    while True:
        upper = materialised(tops(levels[-1], arity, height))
        if not upper.where("nth > 0").limit(1).count():
            return levels, upper.select("tree", "digest")
        levels.append(blocks(upper, arity**height))


def descended(packed: DataFrame, above: DataFrame, arity: int, height: int) -> DataFrame:
    """tree, nth, subroot, root, path of each node in the blocks; ``above`` has these for the blocks' tops (nth: block).
    A path holds, level by level, the digests left of the ancestor, a bar, and those right of it."""
    span = arity**height

    def nodes(batches):
        for batch in batches:
            many = batch.column("nodes").value_lengths().to_pylist()
            for row, leaves in enumerate(_lists(batch, "digest")):
                tree, subroot, root, up = (batch.column(c)[row].as_py() for c in ("tree", "subroot", "root", "path"))
                h = _height(batch.column("total")[row].as_py(), span, arity, height)
                paths = [[f"{a}|{b}" for a, b in zip(left, right)] + up for left, right in traversal(leaves, h, arity)]
                n, first = many[row], batch.column("block")[row].as_py() * span
                yield pa.RecordBatch.from_pydict({"tree": [tree] * n, "nth": list(range(first, first + n)), "subroot": [subroot] * n, "root": [root] * n, "path": paths})

    joined = packed.join(above.withColumnRenamed("nth", "block"), ["tree", "block"])
    return joined.mapInArrow(nodes, "tree string, nth bigint, subroot string, root string, path array<string>")


def proved(packed: DataFrame, above: DataFrame, arity: int, height: int, proofs: bool) -> DataFrame:
    """The manifest's rows of the leaves' blocks."""
    span = arity**height

    def leaves_(batches):
        for batch in batches:
            ids = batch.column("nodes").flatten().field("doc_id")
            at = 0
            for row, (leaves, changed) in enumerate(zip(_lists(batch, "digest"), _lists(batch, "changed"))):
                subroot, root, up = (batch.column(c)[row].as_py() for c in ("subroot", "root", "path"))
                h, n = _height(batch.column("total")[row].as_py(), span, arity, height), len(leaves)
                upper = [x.split("|") for x in up]
                shared = "".join(a + b for a, b in upper)
                digests, folded, siblings = [], [], []
                for mine, other, (left, right) in zip(leaves, changed, traversal(leaves, h, arity)):
                    own = "".join(a + b for a, b in zip(left, right))
                    node = other or mine
                    for a, b in zip(left, right):
                        node = H(a, node, b)
                    for a, b in upper:
                        node = H(a, node, b)
                    digests.append(H(own, shared))
                    folded.append(node)
                    if proofs:
                        whole = own + shared
                        siblings.append([whole[i : i + 64] for i in range(0, len(whole), 64)])
                out = {"doc_id": ids[at : at + n], "leaf": leaves, "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": digests, "folded_root": folded, "verified": [x == root for x in folded]}
                at += n
                yield pa.RecordBatch.from_pydict(out | ({"proof": siblings} if proofs else {}))

    joined = packed.join(above.withColumnRenamed("nth", "block"), ["tree", "block"])
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return joined.mapInArrow(leaves_, schema + ", proof array<string>" * proofs)


def manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None, arity: int = ARITY, height: int = HEIGHT, proofs: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row, and with ``proofs`` the siblings.

    Rows where ``tampered`` holds have ``changed`` for their text when their proof is tried: folded_root is what the
    proof gives for the leaf that such a row has then, verified whether that is the root."""
    rows = columns(docs, **FIELDS)
    other = F.when(tampered, leaf(changed)) if tampered is not None else F.lit(None).cast("binary")
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    narrow = materialised(rows.select(tree.alias("tree"), "doc_id", leaf(F.col("text")).alias("digest"), other.alias("changed")))
    levels, subroots = climbed(numbered(narrow, "doc_id", "digest"), arity, height, "doc_id", "changed")
    sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top_levels, roots = climbed(numbered(sources, "name"), arity, height, "name")
    above = roots.select("tree", F.lit(0).cast("bigint").alias("nth"), F.lit("").alias("subroot"), F.lower(F.hex("digest")).alias("root"), F.array().cast("array<string>").alias("path"))
    for packed in reversed(top_levels):
        above = descended(packed, above, arity, height)
    names = top_levels[0].select(F.explode("nodes").alias("x")).select("x.nth", F.col("x.name").alias("tree"), F.lower(F.hex("x.digest")).alias("subroot"))
    above = materialised(above.drop("tree", "subroot").join(names, "nth").withColumn("nth", F.lit(0).cast("bigint")))
    for packed in reversed(levels[1:]):
        above = materialised(descended(packed, above, arity, height))
    return proved(levels[0], above, arity, height, proofs)


def lower_cased(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
