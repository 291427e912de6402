"""LM scoring: corpus counts, a gated recurrent model learned from all training documents, whole-document scores.

1. Counts. Documents are dealt into chunks by a hash; a chunk sends the distinct words of its texts (64-bit hashes)
   with their training counts, packed by bucket; a bucket adds them up and answers each chunk in its order. So the
   counts of all words reach the documents that hold them, and the whole vocabulary is never broadcast or collected. The most
   frequent words (``sizes``: their number grows with the root of the training text, KNOWN at least) and the totals
   of the groups of other words, whose number grows likewise, reach the driver.
2. Learning. One task learns from WARM documents (a hash decides which) for a common start; then each task makes one
   pass over its training documents from there, and the parameters are averaged by tokens.
3. Scoring. Each chunk's documents run through the model, the state carried from window to window of a document.
   A frequent word or the end has its softmax probability; any other word is dealt by its hash to a group, an output
   class with learned weights that the group's words share, and has the group's probability times
   (c + 1) / (M + U + 1), c its training count, M and U the tokens and distinct words of that group: with a place for
   the unseen, this sums to at most one. The base score is the add-one unigram of the contract.

Scores are in log10. Null and empty texts are one end token. Without training documents the counts are 0. Repeated
rows count each; a null doc_id is whatever ``held_out`` says of it; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised, packed, prepared, sums, unpacked
from .gru import Model
from .words import SPACED_LOWER, Words, text_slices

KNOWN, WARM, CHUNK_BYTES, BUCKET_WORDS, STEP_WORDS, FIRST_RATE, SECOND_RATE = 255, 512, 6 << 20, 1_000_000, 400_000, 0.05, 0.03


def _words(table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows in order, and where each row's begin."""
    hashes, first, base = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in text_slices(table, "text"):
        words = Words(data, offsets, SPACED_LOWER)
        hashes.append(words.hash)
        first.append(words.first[1:] + base)
        base += len(words)
    return np.concatenate(hashes), np.concatenate(first)


def _cuts(distinct: np.ndarray, bits: int) -> np.ndarray:
    return np.concatenate([[0], np.searchsorted(distinct, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(distinct)]])


def _requests(chunk: int, table: pa.Table, bits: int) -> pa.Table:
    hashes, first = _words(table)
    learned = np.repeat(~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
    distinct, at = np.unique(hashes, return_inverse=True)
    count = np.bincount(at[learned], minlength=len(distinct)).astype(np.uint32)
    cuts = _cuts(distinct, bits)
    used = [b for b in range(len(cuts) - 1) if cuts[b] < cuts[b + 1]]
    part = [slice(cuts[b], cuts[b + 1]) for b in used]
    return pa.table([pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int32()), pa.array([packed(distinct[p]) for p in part], pa.binary()), pa.array([packed(count[p]) for p in part], pa.binary())], ["bucket", "chunk", "hashes", "counts"])


_ANSWERS = "kind string, chunk int, bucket int, counts binary, hash bigint, count bigint, words bigint"


def sizes(train_bytes: int) -> tuple[int, int, int]:
    """Frequent words, groups of other words, and words of an output class, for so many bytes of training text."""
    known = max(KNOWN, math.isqrt(train_bytes // 8))
    width = 1 << round(math.log2(1.6 * math.sqrt(known + 1)))  # a known word's class and its place in it cost alike
    return -(-(known + 1) // width) * width - 1, max(8, width // 4), width


def _answers(table: pa.Table, known: int, groups: int) -> pa.Table:
    """A bucket's counts for each chunk; its ``known`` most frequent words; its totals by group."""
    hashes = [unpacked(x) for x in table.column("hashes").to_pylist()]
    counts = np.concatenate([unpacked(x) for x in table.column("counts").to_pylist()])
    distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    top = np.lexsort((distinct, -total))[:known]
    top = top[total[top] > 0]
    ends = np.cumsum([len(h) for h in hashes])
    back = [packed(total[at[e - len(h) : e]].astype(np.uint32 if total.max() < 2**32 else np.int64)) for h, e in zip(hashes, ends)]
    n, m = len(back), len(top)
    group = (distinct & np.uint64(groups - 1)).astype(np.int64)
    of_group = np.concatenate([np.bincount(group, weights=x, minlength=groups) for x in (total, total > 0)]).astype(np.int64)
    nulls = [None]
    return pa.table({
        "kind": ["reply"] * n + ["top"] * m + ["total"], "chunk": pa.array(table.column("chunk").to_pylist() + nulls * (m + 1), pa.int32()), "bucket": pa.array(table.column("bucket").to_pylist() + nulls * (m + 1), pa.int32()),
        "counts": pa.array(back + nulls * m + [packed(of_group)], pa.binary()), "hash": pa.array(nulls * n + distinct[top].view(np.int64).tolist() + nulls, pa.int64()),
        "count": pa.array(nulls * n + total[top].tolist() + [int(total.sum())], pa.int64()), "words": pa.array(nulls * (n + m) + [int((total > 0).sum())], pa.int64()),
    })


class Vocabulary:
    """The frequent words: hashes sorted, and their symbols by rank of frequency; others by the low bits of the hash."""

    def __init__(self, hashes: list[int], groups: int):
        self.groups = groups
        rank = np.array(hashes, np.int64).view(np.uint64)
        self.order = np.argsort(rank)
        self.sorted, self.size = rank[self.order], len(rank)

    def tokens(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols with an end after each row, their tail hashes, where rows begin, and places of the words."""
        group = (hashes & np.uint64(self.groups - 1)).astype(np.int64)
        symbol = -1 - group
        if self.size:
            at = np.minimum(np.searchsorted(self.sorted, hashes), self.size - 1)
            symbol = np.where(self.sorted[at] == hashes, self.order[at] + 1, symbol)
        rows = len(first) - 1
        place = np.arange(len(hashes)) + np.repeat(np.arange(rows), np.diff(first))
        out, tails = np.zeros(len(hashes) + rows, np.int64), np.zeros(len(hashes) + rows, np.int64)
        out[place], tails[place] = symbol, group
        return out, tails, first + np.arange(rows + 1), place


_PARTS = "part int, tokens bigint, flat binary"
PART = 4096


def _learner(vocabulary: Vocabulary, width: int, start: np.ndarray, passes: int, rate: float):
    def run(batches):
        model, total, held, size = Model(vocabulary.size, groups=vocabulary.groups, width=width), 0, [], 0
        model.load(start)

        def learn():
            nonlocal total
            hashes = np.concatenate([h for h, _ in held])
            first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in held]))])
            symbols, tails, first, _ = vocabulary.tokens(hashes, first)
            for _ in range(passes):
                total += model.learn(symbols, tails, first, rate)

        for batch in batches:
            held.append(_words(batch))
            size += len(held[-1][0])
            if size >= STEP_WORDS:
                learn()
                held, size = [], 0
        if held:
            learn()
        if total:
            flat = np.pad(model.flat, (0, -model.size % PART)).reshape(-1, PART)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array([total] * len(flat), pa.int64()), pa.array([packed(x) for x in flat], pa.binary())], ["part", "tokens", "flat"])

    return run


def _average(table: pa.Table) -> pa.Table:
    tokens = table.column("tokens").to_numpy()
    mean = sum(unpacked(x).astype(np.float64) * (t / tokens.sum()) for x, t in zip(table.column("flat").to_pylist(), tokens))
    return pa.table([table.column("part")[:1], pa.array([int(tokens.sum())], pa.int64()), pa.array([packed(mean.astype(np.float32))], pa.binary())], ["part", "tokens", "flat"])


def _parameters(parts: DataFrame, size: int) -> np.ndarray | None:
    rows = sorted((r.part, r.flat) for r in parts.groupBy("part").applyInArrow(_average, _PARTS).collect())  # as many as sizes() says
    return np.concatenate([unpacked(x) for _, x in rows])[:size] if rows else None


def scored(docs: DataFrame, known: int | None = None, warm: int = WARM, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Of ``docs`` (doc_id, text, held_out): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    prepared(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*"), F.count_if(~F.col("held_out")), F.sum(F.when(~F.col("held_out"), F.octet_length("text")))).first()
    chunks = max(1, math.ceil((size[0] or 0) / chunk_bytes), math.ceil(size[1] / 20_000))
    bits = max(3, math.ceil(math.log2(max(1, chunks * 100_000 / BUCKET_WORDS))))
    grown, groups, width = sizes(size[3] or 0)
    known = grown if known is None else known
    per_bucket = min(known, 4 * (known >> bits) + 255)  # words are dealt by hash: no bucket has nearly so many of them
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))

    requests = dealt.groupBy("chunk").applyInArrow(lambda key, t: _requests(key[0].as_py(), t, bits), "bucket int, chunk int, hashes binary, counts binary")
    answers = materialised(requests.groupBy("bucket").applyInArrow(lambda t: _answers(t, per_bucket, groups), _ANSWERS), "kind")
    top = answers.where("kind = 'top'").orderBy(F.desc("count"), "hash").select("hash", "count").limit(known).collect()
    totals = answers.where("kind = 'total'").agg(F.sum("count"), F.sum("words")).first()
    ends = size[2]
    n, v = (totals[0] or 0) + ends, (totals[1] or 0) + (ends > 0)
    rest = np.zeros((2, groups), np.int64)  # tokens and distinct words of each group
    for r in answers.where("kind = 'total'").select("counts").toLocalIterator():
        rest += unpacked(r["counts"]).reshape(2, groups)
    for r in top:
        rest[:, r.hash & groups - 1] -= r["count"], 1
    vocabulary, model = Vocabulary([r.hash for r in top], groups), Model(len(top), groups=groups, width=width)
    model.begin_at([ends, *(r["count"] for r in top)], rest[0])

    learned = docs.where("not held_out")
    every = max(1, ends // warm)
    first = learned.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text").repartition(1)  # about ``warm`` documents
    flat = model.flat
    for rows, passes, rate in ((first, 2, FIRST_RATE), (learned.select("text"), 1, SECOND_RATE)):
        found = _parameters(rows.mapInArrow(_learner(vocabulary, width, flat, passes, rate), _PARTS), model.size)
        flat = flat if found is None else found

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        hashes, first = _words(table)
        distinct, at = np.unique(hashes, return_inverse=True)
        counts, cuts = np.zeros(len(distinct), np.int64), _cuts(distinct, bits)
        for bucket, reply in zip(replies.column("bucket").to_pylist(), replies.column("counts").to_pylist()):
            counts[cuts[bucket] : cuts[bucket + 1]] = unpacked(reply)
        symbols, tails, rows, place = vocabulary.tokens(hashes, first)
        count = np.full(len(symbols), ends, np.int64)
        count[place] = counts[at]
        base = np.log10((count + 1) / (n + v + 1))
        network = Model(vocabulary.size, groups=groups, width=width)
        network.load(flat)
        network.class_b[network.classes :] += np.log((rest[0] + rest[1] + 1) / (rest[0] + 1))  # room for unseen words, as in the base
        log_p = network.log_probabilities(symbols, tails, rows) / math.log(10)
        log_p += np.where(symbols < 0, np.log10((count + 1) / (rest[0] + rest[1] + 1)[tails]), 0)
        tokens = np.diff(rows)
        out = [table.column("doc_id"), table.column("held_out"), tokens, sums(count > 0, rows), np.full(len(tokens), n), sums(base, rows), sums(log_p, rows)]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in out], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    replies = answers.where("kind = 'reply'").select("chunk", "bucket", "counts")
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, schema)
