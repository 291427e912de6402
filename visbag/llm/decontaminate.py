"""Benchmark decontamination: an FM-index per training shard, searched backwards for the benchmark's windows.

Words are lower-cased (A-Z) runs of digits, letters and bytes above 0x7F. A window is WINDOW consecutive words of an
item, or all of an item with fewer. A shard is some hundred documents of one task: its words become symbols of the
windows' vocabulary, and only runs long enough to hold a window of their words are indexed (the other words cannot
be part of an occurrence), separated from each other. Backward search through wavelet-tree ranks finds each window's
rows, sampled suffix positions locate them, and the occurrences of a document merge into removal spans.

The benchmark goes to the tasks in blocks of at most BLOCK_BYTES of text (a block's windows are arrays of some 60 bytes
a word); with more than one, the documents pass through one narrow map a block, which merges its spans and items with
those before. Nothing is shuffled.

Null and empty texts have no words and no hits; an empty benchmark contaminates nothing; items without words or with
null text have no windows; items with a null id go by the empty id; items that share an id count once. Rows are kept
as they are, repeated ones too; columns other than doc_id and text are ignored unless ``keep`` names them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns
from .fm_index import FMIndex
from .words import ALNUM_LOWER, Words, text_slices

WINDOW, BLOCK_BYTES, SHARD_WORDS, SHARD_BYTES = 13, 4 << 20, 300_000, 24 << 20
SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


class Phrases:
    """The distinct windows of some items by length: rows of symbols, and whose they are (``owner[first[i] : first[i + 1]]``,
    places in ``names``). All are arrays; ``member`` tells which symbols occur."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names, number = np.unique(np.array([i or "" for i, _ in items], object), return_inverse=True) if items else (np.zeros(0, object), np.zeros(0, np.int64))
        batch = pa.record_batch({"text": pa.array([t or "" for _, t in items], pa.large_string())})
        hashes, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for _, _, data, offsets in text_slices(batch, "text", 1 << 20):
            w = Words(data, offsets, ALNUM_LOWER)
            hashes.append(w.hash)
            first.append(w.first[1:] + first[-1][-1])
        hashes, first = np.concatenate(hashes), np.concatenate(first)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        symbols, count = (symbols + 1).astype(np.int32), np.diff(first)
        self.by_length = {}
        for size in np.unique(np.minimum(count[count > 0], window)).tolist():
            own = np.flatnonzero(count >= window if size == window else count == size)
            n = count[own] - size + 1
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[own], n)
            rows = np.lib.stride_tricks.sliding_window_view(symbols, size)[at]
            table, which = np.unique(np.ascontiguousarray(rows).view(f"V{4 * size}").reshape(-1), return_inverse=True)
            pairs = np.unique(which.astype(np.int64) * len(self.names) + np.repeat(number[own], n))
            member = np.zeros(len(self.vocabulary) + 1, bool)
            member[rows] = True
            starts = np.searchsorted(pairs, np.arange(len(table) + 1, dtype=np.int64) * len(self.names))
            self.by_length[size] = (table.view(np.int32).reshape(-1, size), starts, (pairs % len(self.names)).astype(np.int32), member)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """1 .. V, or 0 for words of no window."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def long_runs(ok: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Where ``ok`` holds in a row of at least ``least``, not across the starts ``first``."""
    edge = np.zeros(len(ok) + 1, bool)
    edge[first] = edge[0] = edge[-1] = True
    edge[1:-1] |= ok[1:] != ok[:-1]
    at = np.flatnonzero(edge)
    size = np.diff(at)
    return np.repeat(ok[at[:-1]] & (size >= least), size)


class Shard:
    """Documents gathered for one index."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.counts, self.symbols, self.words, self.base, self.bytes = phrases, [], [], [], 0, 0

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        words = Words(data, offsets, ALNUM_LOWER)
        symbols = self.phrases.symbols(words.hash)
        kept = np.zeros(len(symbols), bool)
        for size, (*_, member) in self.phrases.by_length.items():
            kept |= long_runs(member[symbols], words.first, size)
        at = np.flatnonzero(kept)
        gap = np.ones(len(at), np.int64)  # a separator before each run and each document
        if len(at):
            doc = np.searchsorted(words.first, at, "right")
            gap[1:] = (np.diff(at) > 1) | (np.diff(doc) > 0)
        place = np.arange(len(at)) + np.cumsum(gap)
        text = np.zeros(len(at) + int(gap.sum()), np.int64)
        text[place] = symbols[at]
        where = np.full(len(text), -1, np.int64)
        where[place] = at + self.base
        self.symbols.append(text)
        self.words.append(where)
        self.counts.append(words.counts)
        self.base += len(symbols)
        self.bytes += len(data)

    @property
    def full(self) -> bool:
        return sum(map(len, self.symbols)) >= SHARD_WORDS or self.bytes >= SHARD_BYTES

    def search(self) -> tuple[np.ndarray, np.ndarray, dict[int, set]]:
        """Words of each document; for each word how many occurrences open there less those that close; items by document."""
        counts = np.concatenate([np.zeros(0, np.int64), *self.counts])
        first = np.concatenate([[0], np.cumsum(counts)])
        turns, items = np.zeros(self.base + 1, np.int64), {}
        text = np.concatenate([np.zeros(0, np.int64), *self.symbols])
        if np.any(text):
            where, index = np.concatenate(self.words), FMIndex(text, len(self.phrases.vocabulary))
            for size, (table, starts, owners, _) in self.phrases.by_length.items():
                low, high = index.find(table)
                hits = high - low
                which = np.repeat(np.arange(len(table)), hits)
                rows = np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits) + low[which]
                word = where[index.locate(rows)]
                np.add.at(turns, word, 1)
                np.add.at(turns, word + size, -1)
                doc = np.searchsorted(first, word, "right") - 1
                pairs = np.unique(doc * np.int64(len(table)) + which)
                for d, p in zip((pairs // len(table)).tolist(), (pairs % len(table)).tolist()):
                    items.setdefault(d, set()).update(self.phrases.names[owners[starts[p] : starts[p + 1]]])
        return counts, turns, items


def _spans(covered: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """Runs of covered words by document, in words from the document's start."""
    out: list[list[dict]] = [[] for _ in first[1:]]
    edge = np.zeros(len(covered) + 1, bool)
    edge[first] = edge[0] = edge[-1] = True
    edge[1:-1] |= covered[1:] != covered[:-1]
    at = np.flatnonzero(edge)
    for a, b in zip(at[:-1][covered[at[:-1]]].tolist(), at[1:][covered[at[:-1]]].tolist()):
        d = int(np.searchsorted(first, a, "right")) - 1
        out[d].append({"from": a - int(first[d]), "to": b - int(first[d])})
    return out


def _merged(shard: Shard, batches: list[pa.RecordBatch], more: list[str]) -> Iterator[pa.RecordBatch]:
    counts, turns, items = shard.search()
    first = np.concatenate([[0], np.cumsum(counts)])
    row = 0
    for batch in batches:
        rows = range(row, row + len(batch))
        if "spans" in batch.schema.names:
            for d, spans in zip(rows, batch.column("spans").to_pylist()):
                for s in spans:
                    turns[first[d] + s["from"]] += 1
                    turns[first[d] + s["to"]] -= 1
            for d, known in zip(rows, batch.column("items").to_pylist()):
                items.setdefault(d, set()).update(known)
        row += len(batch)
    spans = _spans(np.cumsum(turns[:-1]) > 0, first)
    row = 0
    for batch in batches:
        rows = range(row, row + len(batch))
        row += len(batch)
        out = [batch.column(c) for c in more]
        out += [pa.array(counts[rows.start : rows.stop], pa.int64()), pa.array([spans[d] for d in rows], SPANS), pa.array([sorted(items.get(d, ())) for d in rows], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(out, [*more, "n_words", "spans", "items"])


def _pass(docs: DataFrame, phrases: Phrases, keep: list[str]) -> DataFrame:
    schema = docs.select(*keep, F.lit(0).cast("bigint").alias("n_words"), F.expr("cast(array() as array<struct<from:bigint,to:bigint>>) as spans"), F.expr("cast(array() as array<string>) as items")).schema

    def run(batches):
        shard, held = Shard(phrases), []
        for batch in batches:
            held.append(batch)
            for _, _, data, offsets in text_slices(batch, "text"):
                shard.add(data, offsets)
            if shard.full:
                yield from _merged(shard, held, keep)
                shard, held = Shard(phrases), []
        if held:
            yield from _merged(shard, held, keep)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``keep`` of ``docs``, n_words, spans (merged, in words: from, to), items (sorted ids with occurring windows)."""
    items = columns(benchmark, item_id="string", text="string").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    keep = list(keep)
    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    if blocks > 1:
        items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.col("block") == block)
        phrases = Phrases([(r.item_id, r.text) for r in part.select("item_id", "text").collect()], window)
        last = block == blocks - 1
        docs = _pass(docs, phrases, keep if last else list(dict.fromkeys([*keep, "text"])))
    return docs


def judged(found: DataFrame) -> DataFrame:
    """``found`` with n_hit and contaminated: some word hit, and at least one in twenty."""
    hit = F.expr("aggregate(spans, 0L, (s, x) -> s + x.to - x.from)")
    return found.withColumn("n_hit", hit).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
