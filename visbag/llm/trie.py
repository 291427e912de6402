"""The prefix trie of conversations, read off the sorted conversations.

Conversations are rebuilt first: the first h turns of conversation c - c % GROUP (h: a checksum of c), then c's own turns
after its first h. A node of depth d is a distinct sequence of first d turns; its members start with it.

1. A turn is a digest of its role and text, 16 bytes; a conversation's key is the digests of its turns in a row, so that
   bytewise order is an order of the trie, prefixes first. Equal conversations are one row with their number and smallest
   id; the digest of their ids streams through a task, which holds one state of SHA-256, not the ids.
2. Range partitions sort the keys. Each partition's stream is cut in blocks; a block has the LCP (turns in common with
   the one before) of its keys and running sums, a packed row each. Block heads (least LCP, smallest id, sums) are all
   that comes to the driver: HEAD_BYTES for BLOCK conversations.
3. The LCP array's Cartesian tree has a node for every LCP value and the interval between its nearest smaller values.
   A block finds these by a stack; where they are in another block, the minima of blocks tell in which, and that block's
   chain of minima from its end (or beginning) where: an as-of window over (block, side), one request for equal ones.
4. Positions with equal LCP in an interval are one node, merged in their block, then by (interval's begin, depth). The
   depths between a node and its parent, and a conversation's turns beyond what it shares, are nodes with the same
   members. What a subtree sums to is a difference of running sums: for saved tokens, an interval's
   sum((copies - 1) * W(length)) + sum(W(LCP)) - (members - 1) * W(depth - 1), with W the code points of first turns.

Turns are ordered by number (null first), then by digest; null roles and texts are empty. Rows without conv_id belong to
no conversation and are left out; an empty table has no node. Repeated rows are turns each; other columns are ignored.
A conversation's digests and lengths (24 bytes a turn) meet in one row of one task, its texts never do; a row can hold
some 80 million turns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, materialised, packed, tasks_for, unpacked

GROUP, MOST_HEAD, DIGEST, BLOCK, HEAD_BYTES = 100, 6, 16, 16384, 72
NONE = hashlib.sha256(b"").digest()
LAST = np.iinfo(np.int64).max
#: A step of an interval's side is: position, LCP, these sums, smallest id from there to the block's end (or from the
#: block's beginning), length of the sequence.
SUMS = ("members", "weighted", "shared", "leaves")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, key (digests of the rebuilt turns in a row), sizes (code points of each turn)."""
    rows = columns(turns, conv_id="bigint", turn="bigint", role="string", text="string").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)
    narrow = rows.select("conv_id", "turn", digest.alias("digest"), F.char_length(text).cast("bigint").alias("size"))
    own = narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("t"))
    own = own.select("conv_id", F.expr("transform(t, x -> struct(x.digest, x.size))").alias("t"))
    own = materialised(own.withColumn("base", F.expr(f"conv_id - conv_id % {GROUP}")).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD).cast("int")))
    heads = own.where("conv_id = base").select("base", F.slice("t", 1, MOST_HEAD - 1).alias("head"))
    t = F.expr("concat(slice(coalesce(head, slice(t, 1, 0)), 1, h), slice(t, h + 1, greatest(size(t) - h, 0)))")
    whole = own.join(heads, "base", "left").select("conv_id", t.alias("t"))
    # digests are of one length, so that their hexadecimal forms in a row are that of the key
    return whole.select("conv_id", F.unhex(F.array_join(F.expr("transform(t, x -> hex(x.digest))"), "")).alias("key"), F.expr("transform(t, x -> x.size)").alias("sizes"))


def ids_digest(members: DataFrame) -> DataFrame:
    """name, ends: for rows (name, conv_id), SHA-256 of a name's decimal ids, ascending, with commas between. A task holds
    the state of one name at a time; a name's ids go through one task, since the digest is of one text."""

    def digests(batches):
        name, state, out = None, None, []
        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != name:
                    if name is not None:
                        out.append((name, state.digest()))
                    name, state = n, hashlib.sha256(str(c).encode())
                else:
                    state.update(b",%d" % c)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["name", "ends"])
                out = []
        if name is not None:
            out.append((name, state.digest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["name", "ends"])

    return members.select("name", "conv_id").repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(digests, "name binary, ends binary")


def sequences(conversations: DataFrame) -> DataFrame:
    """The distinct keys: key, sizes, copies, least (smallest conv_id), ends."""
    named = conversations.withColumn("name", F.unhex(F.sha2("key", 256)))
    distinct = named.groupBy("name", "key", "sizes").agg(F.count("*").alias("copies"), F.min("conv_id").alias("least"))
    return distinct.join(ids_digest(named), "name").select("key", "sizes", "copies", "least", "ends")


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return (int(x.argmax()) if x.any() else n) // DIGEST


class Block:
    """Consecutive sorted sequences. ``lcp[0]`` is taken from ``first_lcp``."""

    def __init__(self, row: dict, first_lcp: int):
        self.lcp, self.length, self.copies, self.least, self.sizes = (unpacked(row[c]).astype(np.int64) for c in ("lcp", "length", "copies", "least", "sizes"))
        self.ends = row["ends"]
        self.lcp[0] = first_lcp
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.total = np.concatenate([[0], np.cumsum(self.sizes)])

    def __len__(self) -> int:
        return len(self.lcp)

    def upto(self, turns: np.ndarray) -> np.ndarray:
        """W: the code points of each sequence's first ``turns`` turns (none for -1)."""
        return self.total[self.start[:-1] + np.maximum(turns, 0)] - self.total[self.start[:-1]]

    def sums(self, next_lcp: int) -> dict[str, np.ndarray]:
        """For each position what it adds to the running sums."""
        after = np.append(self.lcp[1:], next_lcp)
        return {"members": self.copies, "weighted": (self.copies - 1) * self.upto(self.length), "shared": self.upto(self.lcp), "leaves": (after < self.length).astype(np.int64)}


class Heads:
    """What is known of all blocks, in order: arrays of one number a block."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r["part"], r["nth"]))
        self.of = {(r["part"], r["nth"]): i for i, r in enumerate(rows)}
        column = lambda c: np.array([r[c] for r in rows], np.int64)
        self.first_lcp, self.least = column("first_lcp"), column("least")
        self.lcp = np.minimum(column("inner_lcp"), self.first_lcp)
        after = np.append(self.first_lcp[1:], -1)
        added = {"pos": column("n"), "members": column("members"), "weighted": column("weighted"), "shared": column("inner_shared") + column("first_shared"), "leaves": column("inner_leaves") + (after < column("last_len"))}
        self.before = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in added.items()}
        self.next_lcp = after

    def find(self, block: int, value: int, side: int) -> int:
        """The nearest block before (side 0) or after (1) that has an LCP under ``value``; -1 or the number of blocks if none."""
        step, i = (1, block + 1) if side else (-1, block - 1)
        width = 1024
        while 0 <= i < len(self.lcp):
            part = self.lcp[i : i + width] if side else self.lcp[max(0, i - width + 1) : i + 1][::-1]
            if (hit := part < value).any():
                return i + step * int(hit.argmax())
            i += step * width
        return len(self.lcp) if side else -1

    def least_between(self, a: int, b: int) -> int:
        """The smallest id of the blocks a .. b - 1."""
        return int(self.least[a:b].min()) if a < b else LAST


def _nearest(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the nearest one with a smaller value to the left (-1: none here) and right (length: none)."""
    n, stack = len(lcp), []
    left, right = np.full(n, -1), np.full(n, n)
    for i, v in enumerate(lcp.tolist()):
        while stack and lcp[stack[-1]] > v:
            right[stack.pop()] = i
        j = stack[-1] if stack else -1
        left[i] = left[j] if j >= 0 and lcp[j] == v else j
        stack.append(i)
    return left, right


def blocks_of(sorted_: DataFrame, size: int) -> DataFrame:
    """Packed rows of up to ``size`` sequences of a partition, in its order."""

    def cut(batches):
        part, nth, held, before = None, 0, [], b""

        def block():
            keys = [r[0] for r in held]
            lcp = [-1] + [common_turns(a, b) for a, b in zip(keys, keys[1:])]
            sizes = [s for r in held for s in r[1]]
            arrays = {"lcp": lcp, "length": [len(k) // DIGEST for k in keys], "copies": [r[2] for r in held], "least": [r[3] for r in held], "sizes": sizes}
            row = {k: packed(np.array(v, np.int64)) for k, v in arrays.items()}
            b = Block(row | {"ends": b""}, 0)
            sums = b.sums(LAST)
            head = {"n": len(b), "inner_lcp": min(lcp[1:], default=LAST), "smallest": int(b.least.min()), "last_len": int(b.length[-1]), "members": int(b.copies.sum()), "weighted": int(sums["weighted"].sum()), "inner_shared": int(sums["shared"][1:].sum()), "inner_leaves": int(sums["leaves"].sum())}
            row |= head | {"part": part, "nth": nth, "ends": b"".join(r[4] for r in held), "first_key": keys[0], "last_key": keys[-1], "first_sizes": list(held[0][1])}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for key, sizes, copies, least, ends, part in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((key, sizes, copies, least, ends))
                if len(held) == size:
                    yield block()
                    nth, held = nth + 1, []
        if held:
            yield block()

    names = "lcp length copies least sizes ends first_key last_key"
    numbers = "part nth n inner_lcp smallest last_len members weighted inner_shared inner_leaves"
    schema = pa.schema([(c, pa.binary()) for c in names.split()] + [(c, pa.int64()) for c in numbers.split()] + [("first_sizes", pa.list_(pa.int64()))])
    ddl = ", ".join([f"{c} binary" for c in names.split()] + [f"{c} bigint" for c in numbers.split()] + ["first_sizes array<bigint>"])
    rows = sorted_.select("key", "sizes", "copies", "least", "ends", F.spark_partition_id().cast("bigint").alias("part"))
    return materialised(rows.mapInArrow(cut, ddl))


def heads_of(blocks: DataFrame) -> Heads:
    """The heads, with what each block's first key has in common with the last one of the block before."""
    narrow = blocks.select("part", "nth", "n", "inner_lcp", F.col("smallest").alias("least"), "last_len", "members", "weighted", "inner_shared", "inner_leaves", "first_key", "last_key", "first_sizes")
    numbers = {(r["part"], r["nth"]): i for i, r in enumerate(sorted(blocks.select("part", "nth").collect()))}
    spark = blocks.sparkSession
    if not numbers:
        return Heads([])
    # a row a block
    order = spark.createDataFrame([(p, n, i) for (p, n), i in numbers.items()], "part bigint, nth bigint, i bigint")
    narrow = narrow.join(order, ["part", "nth"])
    before = narrow.select((F.col("i") + 1).alias("i"), F.col("last_key").alias("key_before"))

    def first(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["first_lcp"] = -1 if r["key_before"] is None else common_turns(r["key_before"], r["first_key"])
                r["first_shared"] = sum(r["first_sizes"][: max(r["first_lcp"], 0)])
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema)

    schema = pa.schema([(c, pa.int64()) for c in "part nth n inner_lcp least last_len members weighted inner_shared inner_leaves first_lcp first_shared".split()])
    return Heads(narrow.join(before, "i", "left").mapInArrow(first, ", ".join(f"{c} bigint" for c in schema.names)).collect())


ASK = pa.schema([("target", pa.int64()), ("side", pa.int64()), ("value", pa.int64()), ("asker", pa.int64()), ("step", pa.list_(pa.int64())), ("ends", pa.binary())])


def _rows_of(batches, heads: Heads):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            at = heads.of[row["part"], row["nth"]]
            yield at, Block(row, int(heads.first_lcp[at])), row


def _upto(b: Block, heads: Heads, at: int) -> dict[str, list[int]]:
    """Running sums over all blocks, before each position of this one (and at its end)."""
    return {k: np.cumsum(np.concatenate([[heads.before[k][at]], v])).tolist() for k, v in b.sums(int(heads.next_lcp[at])).items()}


def _left_step(b: Block, upto: dict, at: int, j: int, heads: Heads) -> list[int]:
    """Of an interval's first position: the sums before it (what it shares with the position before is not the interval's)."""
    return [int(heads.before["pos"][at]) + j, int(b.lcp[j]), upto["members"][j], upto["weighted"][j], upto["shared"][j + 1], upto["leaves"][j], 0, int(b.length[j])]


def _right_step(b: Block, upto: dict, at: int, j: int, heads: Heads) -> list[int]:
    """Of the position after an interval: the sums before it."""
    return [int(heads.before["pos"][at]) + j, int(b.lcp[j]), *(upto[k][j] for k in SUMS)]


def exchanged(blocks: DataFrame, heads: Heads) -> DataFrame:
    """asker, side, value, step, ends: for each block, what it asks of others, answered.

    A left step is the position itself; a right one tells of the position before it (its own lcp apart)."""

    def messages(batches):
        for at, b, _ in _rows_of(batches, heads):
            out = {c: [] for c in ASK.names}

            def put(target, side, value, asker=None, step=None, ends=None):
                for k, v in zip(ASK.names, (target, side, value, asker, step, ends)):
                    out[k].append(v)

            upto = _upto(b, heads, at)
            left, right = _nearest(b.lcp)
            for side, ask in ((0, np.unique(b.lcp[left < 0])), (1, np.unique(b.lcp[right == len(b)]))):
                for v in ask.tolist():
                    to = heads.find(at, v, side)
                    if 0 <= to < len(heads.lcp):
                        put(to, side, v, at)
            # minima from the end: for requests from blocks after this one; a step holds for values over its LCP
            lowest, least = LAST, LAST
            for j in range(len(b) - 1, -1, -1):
                least = min(least, int(b.least[j]))
                if b.lcp[j] < lowest:
                    lowest = int(b.lcp[j])
                    put(at, 0, lowest + 1, None, [*_left_step(b, upto, at, j, heads)[:6], least, int(b.length[j])], b.ends[32 * j : 32 * j + 32])
            lowest, least = LAST, LAST
            for j in range(len(b)):
                if b.lcp[j] < lowest:
                    lowest = int(b.lcp[j])
                    put(at, 1, lowest + 1, None, [*_right_step(b, upto, at, j, heads), least, 0], b"")
                least = min(least, int(b.least[j]))
            yield pa.RecordBatch.from_pydict(out, ASK)

    ddl = "target bigint, side bigint, value bigint, asker bigint, step array<bigint>, ends binary"
    rows = materialised(blocks.drop("first_key", "last_key", "first_sizes").mapInArrow(messages, ddl))
    # of a target's steps the one with the greatest value that is not over the request's; equal requests get one answer
    asked = rows.where("asker is not null").select("target", "side", "value").distinct()
    known = rows.where("asker is null").select("target", "side", "value", F.struct("step", "ends").alias("known"))
    order = Window.partitionBy("target", "side").orderBy("value", F.col("known").isNull())
    answers = known.unionByName(asked.withColumn("known", F.lit(None).cast("struct<step: array<bigint>, ends: binary>")))
    answers = answers.withColumn("found", F.last("known", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    answers = answers.where("known is null").select("target", "side", "value", "found.step", "found.ends")
    return rows.where("asker is not null").select("target", "side", "value", "asker").join(answers, ["target", "side", "value"]).drop("target")


NODE = "l bigint, depth bigint, top bigint, parent_pos bigint, conv_id bigint, n_convs bigint, n_children bigint, first_child bigint, n_leaves bigint, saved bigint, w array<bigint>, ends binary"


def nodes_of(blocks: DataFrame, answers: DataFrame, heads: Heads) -> tuple[DataFrame, DataFrame]:
    """Nodes (begin of the interval, depth; ``top``: the parent's depth; ``w``: W of the depths top .. depth - 1), one a
    block and node; and the smallest member of each position's node."""
    order = blocks.sparkSession.createDataFrame([(p, n, i) for (p, n), i in heads.of.items()], "part bigint, nth bigint, asker bigint")
    got = answers.groupBy("asker").agg(F.collect_list(F.struct("side", "value", "step", "ends")).alias("answers"))
    rows = blocks.drop("first_key", "last_key", "first_sizes").join(order, ["part", "nth"]).join(got, "asker", "left")
    fields = [x.split() for x in NODE.split(", ")]
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    schema = pa.schema([(n, kinds[t]) for n, t in fields] + [("pos", pa.int64())])

    def found(batches):
        for at, b, row in _rows_of(batches, heads):
            yield from _nodes(at, b, {(a["side"], a["value"]): (a["step"], a["ends"]) for a in row["answers"] or []}, heads, schema)

    all_ = materialised(rows.mapInArrow(found, NODE + ", pos bigint"))
    return all_.where("pos is null").drop("pos"), all_.where("pos is not null").select("pos", "conv_id")


def _nodes(at: int, b: Block, answers: dict, heads: Heads, schema: pa.Schema):
    n, base, blocks = len(b), int(heads.before["pos"][at]), len(heads.lcp)
    upto = _upto(b, heads, at)
    left, right = _nearest(b.lcp)
    lcp, length, least = b.lcp.tolist(), b.length.tolist(), b.least.tolist()
    smallest = _range_min(b.least)
    out = {c: [] for c in schema.names}

    def put(**values):
        for k in schema.names:
            out[k].append(values.get(k))

    def interval(j):
        """The steps at both sides of j's interval, the digest of its first sequence's ids, its smallest id."""
        v, l, r = lcp[j], int(left[j]), int(right[j])
        low = high = LAST
        if l >= 0:
            before, ends = _left_step(b, upto, at, l, heads), b.ends[32 * l : 32 * l + 32]
        else:
            before, ends = answers[0, v]
            low = min(before[6], heads.least_between(heads.find(at, v, 0) + 1, at))
        if r < n:
            after = _right_step(b, upto, at, r, heads)
        elif (block := heads.find(at, v, 1)) == blocks:
            after, high = [int(heads.before["pos"][-1]), -1, *(int(heads.before[k][-1]) for k in SUMS)], heads.least_between(at + 1, blocks)
        else:
            after, _ = answers[1, v]
            high = min(after[6], heads.least_between(at + 1, block))
        return before, after, ends, min(smallest(max(l, 0), r), low, high)

    def codes(j, top, depth):
        """W of the depths top .. depth - 1 of sequence j; 0 above the root."""
        first, start = int(b.total[b.start[j]]), int(b.start[j])
        return [0] * (top < 0) + [x - first for x in b.total[start + max(top, 0) : start + depth].tolist()]

    whole: dict[tuple, list] = {}
    for j in range(n):
        if lcp[j] >= 0:
            key = (int(left[j]), lcp[j])
            node = whole[key] if key in whole else whole.setdefault(key, [j, interval(j), 0])
            node[2] += length[j] > lcp[j]  # another child begins here, unless the sequence ends at the node
            put(pos=base + j, conv_id=node[1][3])
    for (_, d), (j, (before, after, ends, smallest_id), children) in whole.items():
        top, parent = (before[1], before[0]) if before[1] >= after[1] else (after[1], after[0])
        members, weighted, shared, leaves = (y - x for x, y in zip(before[2:6], after[2:6]))
        put(l=before[0], depth=d, top=top, parent_pos=parent, conv_id=smallest_id, n_convs=members, n_children=children, first_child=int(before[7] > d), n_leaves=leaves, saved=weighted + shared, w=codes(j, top, d), ends=ends if before[7] == d else NONE)
    for j, following in enumerate([*lcp[1:], int(heads.next_lcp[at])]):
        top = max(lcp[j], following)
        if length[j] > top:  # turns that this sequence shares with no other
            copies, w = int(b.copies[j]), codes(j, top, length[j] + 1)
            put(l=base + j, depth=length[j], top=top, parent_pos=base + j + (lcp[j] < following), conv_id=least[j], n_convs=copies, n_children=0, first_child=0, n_leaves=1, saved=(copies - 1) * w[-1], w=w[:-1], ends=b.ends[32 * j : 32 * j + 32])
    yield pa.RecordBatch.from_pydict(out, schema)


def _range_min(values: np.ndarray):
    table = [values]
    while (1 << len(table)) <= len(values):
        h = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-h], table[-1][h:]))

    def of(a: int, b: int) -> int:
        k = (b - a).bit_length() - 1
        return int(min(table[k][a], table[k][b - (1 << k)]))

    return of


def trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of
    every node of the trie of the rebuilt conversations."""
    distinct = materialised(sequences(rebuilt(turns)))
    many = tasks_for(distinct.sparkSession, distinct.count(), 8 * BLOCK)
    blocks = blocks_of(distinct.repartitionByRange(many, "key").sortWithinPartitions("key"), block)
    heads = heads_of(blocks)
    found, positions = nodes_of(blocks, exchanged(blocks, heads), heads)
    same = ("top", "parent_pos", "conv_id", "n_convs", "first_child", "n_leaves", "saved", "w", "ends")
    merged = found.groupBy("l", "depth").agg(F.sum("n_children").alias("n_children"), *(F.first(c).alias(c) for c in same))
    parents = positions.select(F.col("pos").alias("parent_pos"), F.col("conv_id").alias("above"))
    merged = merged.withColumn("parent_pos", F.when(F.col("top") >= 0, F.col("parent_pos"))).join(parents, "parent_pos", "left")
    each = merged.select("*", F.posexplode("w").alias("nth", "before")).withColumn("at", F.expr("top + 1 + nth"))
    last = F.col("at") == F.col("depth")
    return each.select(
        "conv_id", F.col("at").alias("depth"), F.when(F.col("nth") > 0, F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children") + F.col("first_child")).otherwise(F.lit(1)).cast("bigint").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"), F.lower(F.hex(F.when(last, F.col("ends")).otherwise(F.lit(NONE)))).alias("ends_sha256"),
    )
