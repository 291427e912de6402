"""Substring dedup: suffix automata of reference shards, matching statistics of the documents streamed through them.

A window is WINDOW consecutive words of one document. A word goes if a window over it also starts in a document
with a smaller doc_id. Every recurring window has an owner, the smallest doc_id that holds it.

1. Documents are dealt into chunks by a hash of the row. A chunk sends the distinct hashes of its windows, packed
   by bucket of the hash, with each one's first document and number of documents.
2. A bucket knows, for each of its hashes, the owner and the number of documents, and answers each chunk for the
   hashes it sent, in their order.
3. A chunk cuts its texts into passages: windows it owns and others repeat (reference), windows owned by others
   (to be looked for). Both go to the owner's reference shard. Frequent passages are salted: with n documents, the
   reference goes to about n / SALT parts of the shard and each passage to be looked for to one of them.
4. A shard builds the suffix automaton of its reference passages (a block of at most BLOCK_WORDS at a time),
   streams the passages to be looked for, and reports the maximal spans whose matching length reaches WINDOW.
   Within a reference passage every window belongs to that owner, so a match is one in a smaller doc_id.
5. A chunk removes its spans' words.

Automata go to the passages that can match them rather than to all documents: with a broadcast of every shard to
every document, the work would grow with the square of the corpus. The hashes (64 bits) only route; removal is
decided by the words themselves. Chunks, buckets, shards and salts have bounded size whatever is frequent.

A doc_id may be any bigint. A null one counts as larger than any other, equal ones (null ones too) as not smaller than
each other; null and empty texts have no words; repeated rows are handled each (rows equal in doc_id and text meet in
one chunk). Columns named in ``keep`` pass through, others are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, prepared, released, unpacked
from .words import SPACED, Words, mixed, run_hashes, text_slices

WINDOW, CHUNK_BYTES, BUCKET_WINDOWS, SALT, BLOCK_WORDS = 13, 4 << 20, 1_500_000, 32, 120_000
LAST = np.iinfo(np.int64).max


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.go, self.link, self.size = [{}], [-1], [0]

    def _state(self, go: dict, link: int, size: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.size.append(size)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of size[p] + 1 on p's ``word``: q itself, or a copy that takes q's shorter contexts."""
        go, link, size = self.go, self.link, self.size
        if size[q] == size[p] + 1:
            return q
        copy = self._state(dict(go[q]), link[q], size[p] + 1)
        link[q] = copy
        while p >= 0 and go[p].get(word) == q:
            go[p][word] = copy
            p = link[p]
        return copy

    def add(self, words: list) -> None:
        go, link, size, last = self.go, self.link, self.size, 0
        for word in words:
            q = go[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
                continue
            new, p = self._state({}, 0, size[last] + 1), last
            while p >= 0 and word not in go[p]:
                go[p][word] = new
                p = link[p]
            if p >= 0:
                link[new] = self._split(p, word, go[p][word])
            last = new

    def spans(self, words: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans of ``words`` covered by matches of at least ``least`` words."""
        go, link, size, state, length, out = self.go, self.link, self.size, 0, 0, []
        for i, word in enumerate(words):
            to = go[state].get(word)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = go[state].get(word)
            if to is None:
                continue
            state, length = to, length + 1
            if length >= least:
                if out and i - least + 1 <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((i - least + 1, i + 1))
        return out


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a chunk in a fixed order: by doc_id (nulls last) and text."""
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))


def bucket_cuts(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's part of the sorted hashes begins."""
    inner = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(distinct, inner), [len(distinct)]])


class Chunk:
    """The windows of a chunk's ordered rows: hash, row, place of the first word in the chunk; ``order`` sorts the
    hashes, ``fresh`` marks the first of equal ones. Bytes and words of a slice are made again where needed."""

    def __init__(self, table: pa.Table, window: int):
        self.table, self.window = ordered(table), window
        hashes, docs, places, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        for a, _, data, offsets in text_slices(self.table, "text"):
            words = Words(data, offsets, SPACED)
            doc, h = words.doc, run_hashes(words.hash, window)
            inside = np.flatnonzero(doc[: len(h)] == doc[window - 1 :]) if len(h) else places[0]
            hashes.append(h[inside])
            docs.append((doc[inside] + a).astype(np.int32))
            places.append(inside + base)
            base += len(words)
        self.hash, self.doc, self.place = map(np.concatenate, (hashes, docs, places))
        self.order = np.argsort(self.hash, kind="stable").astype(np.int32)
        self.fresh = np.ones(len(self.order), bool)
        sorted_ = self.hash[self.order]
        self.fresh[1:] = sorted_[1:] != sorted_[:-1]
        self.distinct = sorted_[self.fresh]
        self.hash = None

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """doc_id of each row (0 for null) and whether it is there."""
        column = self.table.column("doc_id")
        return pc.fill_null(column, 0).to_numpy(), pc.is_valid(column).to_numpy()

    def requests(self, chunk: int, bits: int) -> pa.Table:
        """By bucket: hashes, the first row of each as a place in ``doc_ids`` (one past its end: null), rows of each."""
        start, doc = np.flatnonzero(self.fresh), self.doc[self.order]
        other = self.fresh.copy()
        other[1:] |= doc[1:] != doc[:-1]
        many = np.minimum(np.add.reduceat(other, start, dtype=np.int64), 65535).astype(np.uint16) if len(start) else np.zeros(0, np.uint16)
        first, cuts = doc[start], bucket_cuts(self.distinct, bits)
        ids, valid = self.ids()
        rows: dict[str, list] = {"bucket": [], "chunk": [], "hashes": [], "first": [], "many": [], "doc_ids": []}
        for b in range(len(cuts) - 1):
            part = slice(cuts[b], cuts[b + 1])
            if part.start < part.stop:
                used, at = np.unique(first[part], return_inverse=True)  # rows are in order of doc_id, nulls last
                named = used[valid[used]]
                for k, v in (("bucket", b), ("chunk", chunk), ("hashes", packed(self.distinct[part])), ("first", packed(np.minimum(at, len(named)).astype(np.uint32))), ("many", packed(many[part])), ("doc_ids", packed(np.diff(ids[named], prepend=0)))):
                    rows[k].append(v)
        return pa.table(rows, pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), *((k, pa.binary()) for k in ("hashes", "first", "many", "doc_ids"))]))

    def passages(self, chunk: int, bits: int, replies: pa.Table, shards: int) -> pa.Table:
        owner, owned, salts = np.zeros(len(self.distinct), np.int64), np.zeros(len(self.distinct), bool), np.zeros(len(self.distinct), np.uint8)
        cuts = bucket_cuts(self.distinct, bits)
        for bucket, at, owners, salt in zip(*(replies.column(c).to_pylist() for c in ("bucket", "at", "owners", "salts"))):
            at = cuts[bucket] + unpacked(at).cumsum(dtype=np.int64)
            owner[at], owned[at], salts[at] = unpacked(owners), True, unpacked(salt)
        group = np.empty(len(self.order), np.int32)
        group[self.order] = np.cumsum(self.fresh, dtype=np.int32) - 1
        ids, valid = self.ids()
        kind = np.where(owned[group], np.where(valid[self.doc] & (owner[group] == ids[self.doc]), 1, 2), 0).astype(np.int8)  # 1: reference, 2: to be looked for
        edge = np.ones(len(kind) + 1, bool)
        edge[1:-1] = (np.diff(self.place) != 1) | (np.diff(self.doc) != 0) | (np.diff(kind) != 0)
        for x in (owner, salts):
            x = x[group]
            edge[1:-1] |= x[1:] != x[:-1]
        at = np.flatnonzero(edge) if len(kind) else np.zeros(1, np.int64)
        lo = at[:-1][kind[at[:-1]] > 0]
        hi = at[1:][kind[at[:-1]] > 0]
        first, last, rows, kinds = self.place[lo], self.place[hi - 1] + self.window, self.doc[lo], kind[lo]
        parts = np.int64(1) << salts[group[lo]].astype(np.int64)
        shard = (mixed(owner[group[lo]].view(np.uint64)) % np.uint64(shards)).astype(np.int32)
        part = (mixed(np.uint64(chunk * 1_000_003) + lo.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
        of_kind_1 = kinds == 1
        texts, starts = [], np.zeros(len(lo), np.int64)
        slices, base, done = text_slices(self.table, "text"), 0, 0
        for a, _, data, offsets in slices:
            if done == len(lo):
                break
            words = Words(data, offsets, SPACED, hashes=False)
            upto = int(np.searchsorted(first, base + len(words)))
            x, y = first[done:upto] - base, last[done:upto] - base
            starts[done:upto] = x - words.first[rows[done:upto] - a]
            raw = data.tobytes()
            texts += [raw[i:j] for i, j in zip(words.start[x].tolist(), words.end[y - 1].tolist())]
            base, done = base + len(words), upto
        return pa.table([
            pa.array(shard), pa.array(parts), pa.array(np.where(of_kind_1, -1, part)), pa.array(kinds.astype(np.int32)), pa.array(np.full(len(lo), chunk, np.int32)),
            pa.array(rows), pa.array(starts), pa.array(texts, pa.binary()),
        ], _PASSAGES)


def kept(table: pa.Table, spans: pa.Table, keep: list[str]) -> pa.Table:
    """A chunk's rows without the words of its spans."""
    table, by_row = ordered(table), {}
    for row, lo, hi in zip(*(spans.column(c).to_pylist() for c in ("row", "from", "to"))):
        by_row.setdefault(row, []).append((lo, hi))
    n_words, n_removed, out, at = [], [], [], 0
    for chunk in table.column("text").cast(pa.large_binary()).chunks:
        for text in chunk:
            words = (text.as_py() or b"").split()
            count = len(words)
            if at in by_row:
                stay, done = [], 0
                for lo, hi in sorted(by_row[at]):
                    stay += words[done:lo]
                    done = max(done, hi)
                words = stay + words[done:]
            n_words.append(count)
            n_removed.append(count - len(words))
            out.append(b" ".join(words).decode())
            at += 1
    return pa.table([*(table.column(c) for c in keep), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], [*keep, "n_words", "n_removed", "kept"])


_PASSAGES = pa.schema([("shard", pa.int32()), ("parts", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int32()), ("row", pa.int32()), ("from", pa.int64()), ("passage", pa.binary())])


def answers(table: pa.Table) -> pa.Table:
    """A bucket's answers: of each chunk's hashes, the places (as differences) that recur and have an owner, with the
    owners and salts. Only rows with a doc_id own."""
    hashes, docs, named, many, size = [], [], [], [], []
    for h, f, m, d in zip(*(table.column(c).to_pylist() for c in ("hashes", "first", "many", "doc_ids"))):
        hashes.append(unpacked(h))
        ids, at = np.cumsum(unpacked(d)), unpacked(f)
        named.append(at < len(ids))
        docs.append(np.append(ids, LAST)[at])
        many.append(unpacked(m))
        size.append(len(hashes[-1]))
    hash_, doc, own, count = np.concatenate(hashes), np.concatenate(docs), np.concatenate(named), np.concatenate(many).astype(np.int64)
    order = np.argsort(hash_)
    sorted_ = hash_[order]
    fresh = np.ones(len(sorted_), bool)
    fresh[1:] = sorted_[1:] != sorted_[:-1]
    start, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    total = np.add.reduceat(count[order], start)
    least = np.minimum.reduceat(doc[order], start)
    some = np.logical_or.reduceat(own[order], start) & (total > 1)
    salt = np.ceil(np.log2(np.maximum(total / SALT, 1))).astype(np.uint8)
    owner, owned, salts = np.empty(len(hash_), np.int64), np.empty(len(hash_), bool), np.empty(len(hash_), np.uint8)
    owner[order], owned[order], salts[order] = least[group], some[group], salt[group]
    ends = np.cumsum(size)
    rows: dict[str, list] = {"chunk": [], "bucket": [], "at": [], "owners": [], "salts": []}
    for chunk, bucket, lo, hi in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), (ends - size).tolist(), ends.tolist()):
        at = np.flatnonzero(owned[lo:hi])
        if len(at):
            for k, v in (("chunk", chunk), ("bucket", bucket), ("at", packed(np.diff(at, prepend=0).astype(np.uint32))), ("owners", packed(owner[lo:hi][at])), ("salts", packed(salts[lo:hi][at]))):
                rows[k].append(v)
    return pa.table(rows, pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), *((k, pa.binary()) for k in ("at", "owners", "salts"))]))


def matches(table: pa.Table, window: int) -> pa.Table:
    """Spans of the shard's passages that its references hold."""
    kind = table.column("kind").to_numpy()
    texts = table.column("passage")
    queries: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(kind == 2).tolist():
        queries.setdefault(texts[i].as_py(), []).append(i)
    found: dict[int, list] = {}

    def stream(automaton: Automaton) -> None:
        for text, at in queries.items():
            if spans := automaton.spans(text.split(), window):
                for i in at:
                    found.setdefault(i, []).extend(spans)

    if queries:
        automaton, size = Automaton(), 0
        for text in dict.fromkeys(texts[i].as_py() for i in np.flatnonzero(kind == 1).tolist()):
            words = text.split()
            automaton.add(words)
            size += len(words)
            if size >= BLOCK_WORDS:
                stream(automaton)
                automaton, size = Automaton(), 0
        if size:
            stream(automaton)
    at = [i for i, spans in found.items() for _ in spans]
    base = table.column("from").to_numpy()
    flat = [(base[i] + lo, base[i] + hi) for i, spans in found.items() for lo, hi in spans]
    at = np.array(at, np.int64)
    return pa.table([pa.array(table.column("chunk").to_numpy()[at], pa.int32()), pa.array(table.column("row").to_numpy()[at], pa.int32()), pa.array([int(x) for x, _ in flat], pa.int64()), pa.array([int(x) for _, x in flat], pa.int64())], ["chunk", "row", "from", "to"])


def deduplicated(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Columns ``keep`` (doc_id among them) of ``docs``, n_words, n_removed, kept (the words that stay, one space between)."""
    prepared(docs.sparkSession)
    keep = list(keep)
    docs = docs.select(*dict.fromkeys(["doc_id", *keep, "text"]))
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    chunks = max(1, math.ceil((size[0] or 0) / chunk_bytes), math.ceil(size[1] / 20_000))
    bits = max(3, math.ceil(math.log2(max(1, (size[0] or 0) / 6 / BUCKET_WINDOWS))))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    groups = dealt.groupBy("chunk")

    def request(key, table):
        released()
        return Chunk(table, window).requests(key[0].as_py(), bits)

    def cut(key, table, replies):
        released()
        return Chunk(table, window).passages(key[0].as_py(), bits, replies, chunks) if len(table) else _PASSAGES.empty_table()

    def remove(table, spans):
        released()
        return kept(table, spans, keep)

    requests = groups.applyInArrow(request, "bucket int, chunk int, hashes binary, first binary, many binary, doc_ids binary")
    replies = requests.groupBy("bucket").applyInArrow(answers, "chunk int, bucket int, at binary, owners binary, salts binary")
    cuts = groups.cogroup(replies.groupBy("chunk")).applyInArrow(cut, "shard int, parts bigint, part bigint, kind int, chunk int, row int, from bigint, passage binary")
    # a reference goes to all parts of its shard, copied by the JVM one at a time
    passages = cuts.withColumn("salt", F.explode(F.expr("case when kind = 1 then sequence(0L, parts - 1) else array(part) end"))).withColumn("salt", F.expr("parts + salt - 1")).drop("parts", "part")
    spans = passages.groupBy("shard", "salt").applyInArrow(lambda t: matches(t, window), "chunk int, row int, from bigint, to bigint")
    schema = docs.select(*keep, F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.lit("").alias("kept")).schema
    return groups.cogroup(spans.groupBy("chunk")).applyInArrow(remove, schema)
