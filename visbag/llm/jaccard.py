"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, verified once per pair.

A document's set: its distinct shingles of so many words (64-bit hashes); with fewer words, the whole sequence as one.
Two sets link when |x & y| >= ratio |x | y|; documents with equal sets are one class. ``Join`` holds both parameters.

1. Shingles are ordered rare first: by a table of counters (document frequencies of hashed shingles over the whole
   corpus), then by hash. The table grows with the corpus up to 2**MOST_SLOTS slots, so it may be broadcast; beyond, a
   slot's count is the shingle's own plus about the mean of all slots, give or take its root, so frequent shingles
   still come last. Exact counts would need an exchange of all shingles, over three times the input. Any two sets
   that link share a shingle of both prefixes (the first n - ceil(ratio n) + 1).
2. Prefix entries are packed by bucket of the shingle: class, place, size, and the suffix's signature: how many of
   the elements after the shingle fall into each of 8 cells of hashes (modulo 256).
3. In the list of a shingle, pairs pass filters on length, position (what comes before and after the shingle bounds
   the overlap) and suffix (differences of the cells bound the symmetric difference). A bucket keeps the entries that
   have a partner. These meet again with the sketches of their classes (parities of the whole set's hashes, a finer
   bound for long texts), and each list gives a spanning forest of the pairs that pass all. Shingles that the counters
   give more than LIST documents are chained instead: of a task's entries, those of compatible lengths are linked
   where they lie, and only the ends of the chains are sent; so a frequent shingle takes a few entries a task, and
   edges are always fewer than entries.
4. Components of these edges are families: no link leaves one. Each family's sets meet in one task, where overlaps
   are counted from an inverted list, once per pair. A family of more than FAMILY shingles or MEMBERS classes is
   dealt into blocks: first each block with about PIVOTS classes of the family; then the classes outside the family's
   largest component, in pieces, against every block. Pairs already connected need no verification.

Rows are one class each until the end, so copies do not multiply. Without words or text: an empty set, linked with
nothing. Repeated rows have equal sets. A null doc_id takes part and carries links like any other, but names no
component unless all ids of the component are null. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, materialised, packed, prepared, released, tasks_for, unpacked
from .components import Union, connected
from .words import SPACED_LOWER, Words, mixed, run_hashes, text_slices

LEAST_SLOTS, MOST_SLOTS, LIST, FAMILY, MEMBERS, PIVOTS, ENTRIES, KEY_SLOTS, LISTED = 18, 21, 1024, 1_000_000, 4096, 32, 400_000, 1 << 20, 50_000
OPENS, ALONE, ENDS = -3, -2, -1  # places of a chained list's entries: the first of a chain, one alone, the last of a chain
_MIX = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Join:
    """Words of a shingle, and the ratio over / under of intersection and union from which sets link."""

    words: int = 3
    over: int = 9
    under: int = 10

    @property
    def least(self) -> int:
        """The smallest set that links with a different one (within one of one element more)."""
        return max(1, -(-self.over // max(1, self.under - self.over)))

    def prefix_length(self, n: int) -> int:
        return n - -(-self.over * n // self.under) + 1

    def overlap(self, both):
        """What two sets of ``both`` elements together must share to link."""
        return -(-self.over * both // (self.over + self.under))

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The set of each text, sorted."""
        words = Words(data, offsets, SPACED_LOWER)
        hashes, first = run_hashes(words.hash, self.words), words.first.tolist()
        for a, b in zip(first, first[1:]):
            if b - a >= self.words:
                yield np.unique(hashes[a : b - self.words + 1])
            else:
                yield run_hashes(words.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def class_of(x: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    with np.errstate(over="ignore"):
        total = np.array([x.sum(dtype=np.uint64) + np.uint64(len(x)) * _MIX, (mixed(x ^ _MIX)).sum(dtype=np.uint64)], np.uint64)
        return int(mixed(total[:1] ^ mixed(total[1:])).view(np.int64)[0])


def signatures(ordered: np.ndarray, p: int) -> np.ndarray:
    """For each of the first ``p`` elements, the sizes (modulo 256) of the 8 cells of the elements after it, a byte each."""
    cells = (ordered & np.uint64(7)).astype(np.int64)
    before = np.cumsum(cells[:p, None] == np.arange(8), axis=0)
    return (np.bincount(cells, minlength=8) - before).astype(np.uint8).view(np.uint64).reshape(-1)


def sketch(x: np.ndarray) -> bytes:
    """Parities of the hashes' low bits: about as many bits as half the set, a power of two from 64 to 65536.

    Unrelated sets then differ in a quarter of their size, sets that link at nine tenths in a ninth at most."""
    width = 1 << min(16, max(6, (len(x) - 1).bit_length() - 1))
    odd = np.bincount((x & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: int, a_bits: int, b: int, b_bits: int) -> int:
    """At least so many elements are in one set only."""
    if a_bits > b_bits:
        a, a_bits, b, b_bits = b, b_bits, a, a_bits
    while b_bits > a_bits:
        b_bits //= 2
        b = (b >> b_bits) ^ (b & ((1 << b_bits) - 1))
    return (a ^ b).bit_count()


def suffix_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least so many elements are in one of two suffixes only, from their signatures."""
    x, y = a.view(np.uint8).reshape(-1, 8), b.view(np.uint8).reshape(-1, 8)
    d = x - y
    return np.minimum(d, -d).sum(1, dtype=np.int64)


def _counters(join: Join, slot_bits: int):
    def run(batches):
        total = np.zeros(1 << slot_bits, np.uint32)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text"):
                all_ = [x for x in join.sets(data, offsets) if len(x) >= join.least]
                if all_:
                    slots, n = np.unique((np.concatenate(all_) >> np.uint64(64 - slot_bits)).astype(np.uint32), return_counts=True)
                    total[slots] += n.astype(np.uint32)
        parts = total.reshape(64, -1)
        used = [i for i in range(64) if parts[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed(parts[i]) for i in used], pa.binary())], ["part", "counts"])
        released()

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(1, np.uint64)
    for c in table.column("counts"):
        total = total + unpacked(c.as_py())
    return pa.table([table.column("part")[:1], pa.array([packed(np.minimum(total, 2**32 - 1).astype(np.uint32))], pa.binary())], ["part", "counts"])


def frequencies(docs: DataFrame, join: Join, slot_bits: int) -> np.ndarray:
    """Document frequencies by the hashes' top bits, over all documents."""
    out = np.zeros((64, (1 << slot_bits) // 64), np.uint32)
    kind = "part int, counts binary"
    for r in docs.select("text").mapInArrow(_counters(join, slot_bits), kind).groupBy("part").applyInArrow(_added, kind).collect():  # 64 rows at most
        out[r.part] = unpacked(r.counts)
    return out.reshape(-1)


_DESCRIBED = "kind string, doc_id bigint, key bigint, class bigint, n bigint, sketch binary, bucket int, grams binary, classes binary, places binary, sizes binary, suffixes binary"
_ARROW = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _DESCRIBED.split(", "))])


def _rows(kind: str, rows: int, **values) -> pa.RecordBatch:
    values["kind"] = [kind] * rows
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(rows, f.type) for f in _ARROW], schema=_ARROW)


def _chained(join: Join, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of entries sorted by shingle and size, which follow their neighbour in a chain of compatible lengths."""
    out = np.zeros(len(gram), bool)
    out[1:] = (gram[1:] == gram[:-1]) & (join.under * n[:-1] >= join.over * n[1:])
    return out


def described(docs: DataFrame, join: Join, counts, buckets: int) -> DataFrame:
    """Of each document its class and size (kind doc); of each task the prefixes of its classes by bucket (kind prefix),
    and the chains of frequent shingles among them (kind edge: pairs of classes)."""

    def prefixes(entries: list, frequent: float, slots: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
        gram, class_, place, n, suffix = (np.concatenate(x) for x in zip(*entries))
        hot = slots[(gram >> np.uint64(64 - bits)).astype(np.int64)] > frequent
        if hot.any():
            order = np.flatnonzero(hot)
            order = order[np.lexsort((class_[order], n[order], gram[order]))]
            follows = _chained(join, gram[order], n[order].astype(np.int64))
            yield _rows("edge", 1, grams=[packed(class_[order[np.flatnonzero(follows) - 1]])], classes=[packed(class_[order[follows]])])
            followed = np.append(follows[1:], False)
            inner = followed & follows
            place[order] = np.where(followed, OPENS, np.where(follows, ENDS, ALONE))
            stay = np.ones(len(gram), bool)
            stay[order[inner]] = False
            gram, class_, place, n, suffix = gram[stay], class_[stay], place[stay], n[stay], suffix[stay]
        bucket = gram % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        used, start = np.unique(bucket[order], return_index=True)
        part = [order[a:b] for a, b in zip(start, [*start[1:], len(order)])]
        yield _rows("prefix", len(used), bucket=used.astype(np.int32), **{k: [packed(x[p]) for p in part] for k, x in (("grams", gram), ("classes", class_), ("places", place), ("sizes", n), ("suffixes", suffix))})

    def run(batches):
        slots, seen, entries, held = unpacked(counts.value), set(), [], 0
        bits, mean = len(slots).bit_length() - 1, float(slots.mean())
        frequent = LIST + mean + 4 * math.sqrt(mean)
        for batch in batches:
            ids, keys, names, sizes, sketches = batch.column("doc_id"), batch.column("key"), [], [], []
            for _, _, data, offsets in text_slices(batch, "text"):
                for x in join.sets(data, offsets):
                    name = class_of(x)
                    names.append(name)
                    sizes.append(len(x))
                    sketches.append(sketch(x) if len(x) >= join.least else None)
                    if len(x) >= join.least and name not in seen:  # smaller sets link with equal ones only
                        seen.add(name)
                        p = join.prefix_length(len(x))
                        x = x[np.lexsort((x, slots[(x >> np.uint64(64 - bits)).astype(np.int64)]))]
                        entries.append((x[:p], np.full(p, name, np.int64), np.arange(p, dtype=np.int32), np.full(p, len(x), np.int32), signatures(x, p)))
                        held += p
            yield _rows("doc", len(names), doc_id=ids, key=keys, **{"class": names}, n=sizes, sketch=sketches)
            if held >= 200_000:
                yield from prefixes(entries, frequent, slots, bits)
                seen, entries, held = set(), [], 0
        if entries:
            yield from prefixes(entries, frequent, slots, bits)
        released()

    return docs.mapInArrow(run, _DESCRIBED)


class Lists:
    """Entries sorted by shingle, size and place, and the pairs of those that share a shingle, a distance at a time."""

    def __init__(self, join: Join, gram: np.ndarray, class_: np.ndarray, place: np.ndarray, n: np.ndarray, suffix: np.ndarray):
        self.join, self.order = join, np.lexsort((class_, place * (place < 0), n, gram))
        self.gram, self.class_, self.suffix = gram[self.order], class_[self.order], suffix[self.order]
        self.place, self.n = place[self.order].astype(np.int64), n[self.order].astype(np.int64)

    def chain(self) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours in the lists of frequent shingles that are linked: those of compatible lengths, and those within a
        chain that some task has sent by its ends."""
        within = np.cumsum(self.place == OPENS) - np.cumsum(self.place == ENDS)
        follows = _chained(self.join, self.gram, self.n)
        follows[1:] |= (self.gram[1:] == self.gram[:-1]) & (within[:-1] > 0)
        follows = np.flatnonzero(follows & (self.place < 0))
        return follows - 1, follows

    def pairs(self, wanted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, how many elements the sets may differ in) of pairs of different classes that pass the filters;
        ``wanted(i, j)`` tells which pairs are still of use."""
        join, gram, place, n = self.join, self.gram, self.place, self.n
        active, d = np.flatnonzero(place >= 0), 1
        while len(active):
            active = active[active + d < len(gram)]
            active = active[(gram[active] == gram[active + d]) & (join.under * n[active] >= join.over * n[active + d])]
            i = active[wanted(active, active + d) & (self.class_[active] != self.class_[active + d])]
            j = i + d
            need = join.overlap(n[i] + n[j])
            stay = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j]) >= need
            i, j, need = i[stay], j[stay], need[stay]
            may = n[i] + n[j] - 2 * need
            stay = suffix_distance(self.suffix[i], self.suffix[j]) + np.abs(place[i] - place[j]) <= may
            if stay.any():
                yield i[stay], j[stay], may[stay]
            d += 1


def partnered(lists: Lists) -> np.ndarray:
    """Which entries have a partner."""
    found = np.zeros(len(lists.gram), bool)
    for i, j, _ in lists.pairs(lambda i, j: ~(found[i] & found[j])):
        found[i] = found[j] = True
    return found


def forest(lists: Lists, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that pass all filters; ``sketches`` as the entries came."""
    names, node = np.unique(lists.class_, return_inverse=True)
    bits: dict = {}
    for k, at in zip(node.tolist(), lists.order.tolist()):
        if k not in bits:
            bits[k] = int.from_bytes(sketches[at], "little"), 8 * len(sketches[at])
    union, label, a, b = Union(), np.arange(len(names)), [], []
    for i, j, may in lists.pairs(lambda i, j: label[node[i]] != label[node[j]]):
        before = len(a)
        for x, y, most in zip(node[i].tolist(), node[j].tolist(), may.tolist()):
            if union.root(x) != union.root(y) and apart(*bits[x], *bits[y]) <= most:
                union.join(x, y)
                a.append(x)
                b.append(y)
        if len(a) > before:
            moved = np.fromiter(union.parent.keys(), np.int64, len(union.parent))
            label[moved] = np.fromiter(union.parent.values(), np.int64, len(union.parent))
            while not ((further := label[label]) == label).all():
                label = further
    return names[np.array(a, np.int64)], names[np.array(b, np.int64)]


_LISTED = "kind string, a bigint, b bigint, gram bigint, class bigint, place int, n int, suffix bigint"


def _listed(join: Join):
    """A bucket's entries that have a partner, and the edges of its chains."""

    def run(table: pa.Table) -> pa.Table:
        lists = Lists(join, *(np.concatenate([unpacked(x) for x in table.column(c).to_pylist()]) for c in ("grams", "classes", "places", "sizes", "suffixes")))
        first, second = lists.chain()
        at = np.flatnonzero(partnered(lists))
        fresh = np.ones(len(at), bool)  # several tasks may send a class
        fresh[1:] = (lists.gram[at[1:]] != lists.gram[at[:-1]]) | (lists.class_[at[1:]] != lists.class_[at[:-1]])
        at = at[fresh]
        e, m = len(first), len(at)
        released()
        values = [pa.array(["edge"] * e + ["entry"] * m, pa.string()), *(pa.concat_arrays([pa.array(lists.class_[x]), pa.nulls(m, pa.int64())]) for x in (first, second))]
        for x, kind in ((lists.gram.view(np.int64), pa.int64()), (lists.class_, pa.int64()), (lists.place, pa.int32()), (lists.n, pa.int32()), (lists.suffix.view(np.int64), pa.int64())):
            values.append(pa.concat_arrays([pa.nulls(e, kind), pa.array(x[at], kind)]))
        return pa.table(values, [x.split()[0] for x in _LISTED.split(", ")])

    return run


def _edges(join: Join):
    """Of entries sorted by shingle, with sketches, the edges of step 3; whole lists are taken together."""

    def found(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        gram, class_, place, n, suffix = (table.column(c).to_numpy() for c in ("gram", "class", "place", "n", "suffix"))
        a, b = forest(Lists(join, gram, class_, place, n, suffix.astype(np.int64).view(np.uint64)), table.column("sketch").to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            if held and rows >= LISTED:
                last = held[-1].column("gram")[-1].as_py()
                cut = int(np.searchsorted(gram != last, True)) if (gram != last).any() else len(gram)
                held.append(batch.slice(0, cut))
                if cut < len(gram):
                    yield found(held)
                    held, rows = [batch.slice(cut)], len(gram) - cut
                continue
            held.append(batch)
            rows += len(batch)
        if held:
            yield found(held)
        released()

    return run


def _unpacked_edges(batches):
    for batch in batches:
        for a, b in zip(batch.column("grams").to_pylist(), batch.column("classes").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(a)), pa.array(unpacked(b))], ["a", "b"])


def verified(join: Join, names: list[int], members: list[np.ndarray], label: list[int]) -> list[tuple[int, int]]:
    """Links among the sets of a group that join different labels, as a spanning forest of them."""
    union, out = Union(), []
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), [len(x) for x in members])
    order = np.argsort(flat, kind="stable")  # owners ascend within a shingle
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    size = np.diff(np.append(start, len(flat)))
    group = np.repeat(np.arange(len(start)), size)
    before = np.arange(len(flat)) - start[group]  # how many earlier sets hold the same shingle
    back = np.argsort(owner, kind="stable")
    ends = np.concatenate([[0], np.cumsum([len(x) for x in members])])
    lengths = np.diff(ends)
    for i in range(1, len(members)):
        at = back[ends[i] : ends[i + 1]]
        n = before[at]
        at, n = at[n > 0], n[n > 0]
        if not len(at):
            continue
        rows = np.repeat(start[group[at]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(owner[rows], minlength=i)
        for j in np.flatnonzero(both[:i] >= join.overlap(lengths[:i] + lengths[i])).tolist():
            if label[i] != label[j] and union.join(label[i], label[j]):
                out.append((names[i], names[j]))
    return out


def _linked(join: Join):
    """Links within each (family, part) of sorted rows: family, part, class, label, text."""

    def run(batches):
        def rows():
            for batch in batches:
                at = 0
                for a, b, data, offsets in text_slices(batch, "text"):
                    part = batch.slice(a, b - a)
                    yield from zip(part.column("family").to_pylist(), part.column("part").to_pylist(), part.column("class").to_pylist(), part.column("label").to_pylist(), join.sets(data, offsets))

        for _, group in itertools.groupby(rows(), key=lambda r: r[:2]):
            by_class = {r[2]: r for r in group if class_of(r[4]) == r[2]}  # a key may have several texts
            if len(by_class) > 1:
                group = [by_class[k] for k in sorted(by_class)]
                links = verified(join, [r[2] for r in group], [r[4] for r in group], [r[3] for r in group])
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])
        released()

    return run


def _with_texts(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """``placed`` with the texts of its rows. Only documents whose key falls in a used one of KEY_SLOTS slots (what is
    broadcast is never larger) are shuffled for it."""
    slot = F.pmod(F.xxhash64("key", "unnamed"), F.lit(KEY_SLOTS)).alias("slot")
    used = placed.select(slot).distinct()
    some = texts.withColumn("slot", slot).join(F.broadcast(used), "slot", "left_semi").drop("slot")
    return placed.join(some.hint("merge"), ["key", "unnamed"])


def _links(join: Join, placed: DataFrame) -> DataFrame:
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.repartition(tasks, "family", "part").sortWithinPartitions("family", "part")
    return rows.select("family", "part", "class", "label", "text").mapInArrow(_linked(join), "a bigint, b bigint")


def joined(docs: DataFrame, join: Join = Join(), family: int = FAMILY, members: int = MEMBERS, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, key (doc_id, or a hash of the text of a row without), class (of equal sets), n_shingles, component_id and
    root (a class that stands for the component) of every row of ``docs``."""
    spark = prepared(docs.sparkSession)
    docs = columns(docs, doc_id="bigint", text="string").withColumn("key", F.coalesce("doc_id", F.xxhash64("text"))).withColumn("unnamed", F.col("doc_id").isNull())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, math.ceil(size / 6 * (1 - join.over / join.under) / ENTRIES))
    slot_bits = min(MOST_SLOTS, max(LEAST_SLOTS, math.ceil(math.log2(max(1, size / 6 / 64)))))
    counts = spark.sparkContext.broadcast(packed(frequencies(docs, join, slot_bits)))  # 8 MB at most
    rows = materialised(described(docs, join, counts, buckets), "kind")
    of_doc = rows.where("kind = 'doc'").select("doc_id", "key", "class", "n", "sketch")
    # of each class its least doc_id, or the key of a row without
    classes = of_doc.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min(F.when(F.col("doc_id").isNull(), F.col("key"))).alias("other"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = classes.select("class", "doc_id", "n", "sketch", F.coalesce("doc_id", "other").alias("key"), F.col("doc_id").isNull().alias("unnamed"))
    entries = rows.where("kind = 'prefix'").select("bucket", "grams", "classes", "places", "sizes", "suffixes")
    listed = materialised(entries.groupBy("bucket").applyInArrow(_listed(join), _LISTED), "kind")
    lists = listed.where("kind = 'entry'").select("gram", "class", "place", "n", "suffix").join(classes.select("class", "sketch"), "class")
    lists = lists.repartition(tasks_for(spark, 0, 1), "gram").sortWithinPartitions("gram")
    edges = lists.mapInArrow(_edges(join), "a bigint, b bigint").unionByName(listed.where("kind = 'edge'").select("a", "b"))
    edges = edges.unionByName(rows.where("kind = 'edge'").select("grams", "classes").mapInArrow(_unpacked_edges, "a bigint, b bigint"))
    edges = materialised(edges)  # a stage with one Python step at a time: executors keep a worker for each
    classes, of_doc = classes.drop("sketch"), of_doc.drop("sketch")
    families = connected(edges).select(F.col("node").alias("class"), F.col("root").alias("family"))
    known = materialised(families.join(classes, "class"))
    sizes = known.groupBy("family").agg(F.sum("n").alias("shingles"), F.count("*").alias("classes"))
    sizes = sizes.withColumn("parts", F.greatest(F.ceil(F.col("shingles") / family), F.ceil(F.col("classes") / members)).cast("int"))
    placed = known.join(sizes.select("family", "parts", "classes"), "family")
    placed = placed.withColumn("part", F.expr("pmod(xxhash64(class), parts)").cast("int")).withColumn("label", F.col("class"))
    large = placed.where("parts > 1")
    texts = docs.select("key", "unnamed", "text")
    first = placed
    if not large.isEmpty():
        some = large.where(F.expr(f"pmod(xxhash64(class, 7), greatest(1, classes div {pivots})) = 0"))  # about so many
        spread = some.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        first = placed.unionByName(spread.select(*placed.columns)).dropDuplicates(["family", "part", "class"])
    links = materialised(_links(join, _with_texts(first, texts)))
    if not large.isEmpty():
        labels = connected(links).select(F.col("node").alias("class"), "root")
        labelled = materialised(large.join(labels, "class", "left").withColumn("label", F.coalesce("root", "class")).drop("root"))
        most = labelled.groupBy("family", "label").agg(F.sum("n").alias("weight")).groupBy("family").agg(F.max_by("label", F.struct("weight", "label")).alias("most"))
        rest = labelled.join(most, "family").where("label <> most").drop("most")
        pieces = rest.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / family), F.ceil(F.count("*") / members)).cast("int").alias("pieces"))
        # piece p of the rest meets block b of the whole family in part parts + p * parts + b
        rest = rest.join(pieces, "family").withColumn("piece", F.expr("pmod(xxhash64(class, 11), pieces)"))
        one = rest.withColumn("block", F.explode(F.expr("sequence(0, parts - 1)")))
        other = labelled.join(pieces, "family").withColumn("block", F.col("part")).withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)")))
        both = one.unionByName(other.select(*one.columns)).withColumn("part", F.expr("cast(parts + piece * parts + block as int)")).dropDuplicates(["family", "part", "class"])
        links = materialised(links.unionByName(_links(join, _with_texts(both.select(*labelled.columns), texts))))
    linked = connected(links).select(F.col("node").alias("class"), "root").join(known.select("class", F.col("doc_id").alias("least")), "class")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("class", "component_id", "root")
    whole = classes.select("class", F.col("doc_id").alias("least")).join(named, "class", "left").select("class", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "class").alias("root"))
    return of_doc.join(whole, "class").select("doc_id", "key", "class", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")
