"""Ranked search of histograms: queries go to the items in blocks; each task keeps the best items of each query.

Lower scores are better. ``reference``: the absolute difference at the highest word that both histograms hold; an item
without a common word scores 0, so comes first. ``euclidean``: the root of the summed squared differences over the
common words; an item without any gets ``no_overlap``.

No row is made for a pair of query and item: an item's terms meet in one row, a block of at most BLOCK_TERMS terms of
queries is a narrow pass over these rows, and what leaves a task is ``list_size`` items a query. A task turns each batch
of items into posting lists; a query reads those of its own words only, and skips a batch whose bound (from the range of
each word's values and the smallest id) cannot beat what it has. Memory is the batch's terms and the lists, whatever the
vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import new_folder, written

LIST_SIZE, URL, BLOCK_TERMS = 100, "http://foo/", 1_000_000


def _rows(terms: DataFrame, name: str) -> DataFrame:
    """A row for each id, with its non-zero terms in order of their words."""
    held = F.filter(F.collect_list(F.struct("word", F.col("value").cast("double").alias("value"))), lambda t: t.value != 0)
    return terms.groupBy(F.col("id").alias(name)).agg(F.array_sort(held).alias("terms"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and values of all rows, and where each row's begin."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    first = rows.offsets.to_numpy()
    flat = rows.flatten()
    return flat.field("word").to_numpy(), flat.field("value").to_numpy(), first - first[0]


class Postings:
    """A block of items in order of id, turned over: for each word the items that hold it, their values, and the least and
    greatest of these."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, values: np.ndarray, first: np.ndarray):
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        place = np.empty(len(ids), np.int64)
        place[self.order] = np.arange(len(ids))
        by_word = np.argsort(words, kind="stable")
        self.items, self.values = np.repeat(place, np.diff(first))[by_word], values[by_word]
        self.words, self.start = np.unique(words[by_word], return_index=True)
        self.end = np.append(self.start[1:], len(words))
        self.low, self.high = (f.reduceat(self.values, self.start) if len(words) else np.zeros(0) for f in (np.minimum, np.maximum))

    def held(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``words`` occur here, and where their postings are."""
        at = np.minimum(np.searchsorted(self.words, words), max(0, len(self.words) - 1))
        there = np.flatnonzero(self.words[at] == words) if len(self.words) else np.zeros(0, np.int64)
        return there, at[there]

    def scored(self, words: np.ndarray, values: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
        """The items with a common word (places in ``ids``) and their scores; no other item is looked at."""
        there, at = self.held(words)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0)
        items = np.concatenate([self.items[self.start[i] : self.end[i]] for i in at])
        diff = np.concatenate([self.values[self.start[i] : self.end[i]] - v for i, v in zip(at, values[there])])
        if mode == "euclidean":
            found, inverse = np.unique(items, return_inverse=True)
            return found, np.sqrt(np.bincount(inverse, diff * diff))
        found, last = np.unique(items[::-1], return_index=True)  # words ascend: the last posting is the highest word's
        return found, np.abs(diff[::-1][last])

    def bound(self, words: np.ndarray, values: np.ndarray, mode: str, apart: float) -> float:
        """No item here scores less: one with a common word differs by at least the distance to the range of its values
        there (of ``reference`` only the highest common word counts, which may be any), one without scores ``apart``."""
        there, at = self.held(words)
        v = values[there]
        gap = np.maximum(np.maximum(self.low[at] - v, v - self.high[at]), 0)
        covered = len(at) and (self.end[at] - self.start[at]).max() == len(self.ids)  # a word that all items hold
        return min(gap.min(initial=np.inf), np.inf if covered else apart)


class Queries:
    """A block of queries."""

    def __init__(self, ids: list, terms: pa.Array):
        self.ids = ids
        self.words, self.values, self.first = _flat(terms)

    def __len__(self) -> int:
        return len(self.ids)

    def terms(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.first[k], self.first[k + 1])
        return self.words[part], self.values[part]


class Best:
    """The best items of one query so far: ``most`` at most, by score (rounded) and id."""

    def __init__(self, most: int, digits: int | None):
        self.most, self.digits = most, digits
        self.scores, self.ids = np.zeros(0), None

    def open_to(self, bound: float, least_id) -> bool:
        """Whether an item of that score, or more, and id, or greater, can still come in."""
        if len(self.scores) < self.most or not self.most:
            return self.most > 0
        last, step = self.scores[-1], 0.0 if self.digits is None else 10.0**-self.digits
        return bound <= last + step and not (bound == last and not step and least_id > self.ids[-1]) and not (last == 0 and bound == 0 and least_id > self.ids[-1])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        scores = np.concatenate([self.scores, scores])
        order = np.lexsort((ids, scores if self.digits is None else np.round(scores, self.digits)))[: self.most]
        self.scores, self.ids = scores[order], ids[order]


def _blocks(queries: DataFrame):
    """The queries in blocks; ids are dealt by their hash."""
    size = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_TERMS))
    for k in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        table = part.toArrow()
        if len(table):
            yield Queries(table.column("query_id").to_pylist(), table.column("terms").combine_chunks()), blocks == 1


def _searched(block: Queries, schema, mode: str, no_overlap: float, most: int | None, digits: int | None, report: bool = False):
    """What a task does with its items, block by block: each query carries the score and id to be beaten from one to the
    next, and a block whose bound does not beat them is not scored. ``report``: query_id, items, scored, blocks, skipped."""
    apart = no_overlap if mode == "euclidean" else 0.0

    def run(batches):
        best = [Best(most, digits) for _ in block.ids] if most is not None else []
        work = np.zeros((len(block), 4), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            posted = Postings(np.array(batch.column("item_id").to_pylist()), *_flat(batch.column("terms")))
            for k in range(len(block)):
                words, values = block.terms(k)
                work[k] += (batch.num_rows, 0, 1, 0)
                if most is not None and not best[k].open_to(posted.bound(words, values, mode, apart), posted.ids[0]):
                    work[k, 3] += 1
                    continue
                items, scores = posted.scored(words, values, mode)
                work[k, 1] += len(items)
                if most is None:
                    all_ = np.full(batch.num_rows, apart)
                    all_[items] = scores
                    yield _scored(schema, block.ids[k], posted.ids, all_)
                    continue
                if len(items):
                    best[k].add(scores, posted.ids[items])
                if len(items) < batch.num_rows and best[k].open_to(apart, posted.ids[0]):
                    others = np.ones(batch.num_rows, bool)
                    others[items] = False
                    others = np.flatnonzero(others)[:most]  # the smallest ids: all score the same
                    best[k].add(np.full(len(others), apart), posted.ids[others])
        if report:
            columns = [pa.array(block.ids, schema.types[0]), *(pa.array(c) for c in work.T)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        else:
            for k, b in enumerate(best):
                if len(b.scores):
                    yield _scored(schema, block.ids[k], b.ids, b.scores)

    return run


def _passes(queries: DataFrame, base: DataFrame, mode: str, no_overlap: float, most: int | None, digits: int | None) -> DataFrame:
    """A pass over the items for each block of queries. With several, items and each pass's result are written to the
    shared folder, so that the driver holds one block at a time."""
    if mode not in ("reference", "euclidean"):
        raise ValueError(f"unknown mode {mode!r}")
    asked, items = _rows(queries, "query_id"), _rows(base, "item_id").sortWithinPartitions("item_id")
    schema = asked.select("query_id").schema.add(items.schema["item_id"]).add("score", "double")
    results = None
    for block, only in _blocks(asked):
        if only:
            return items.mapInArrow(_searched(block, schema, mode, no_overlap, most, digits), schema)
        if results is None:
            results, items = new_folder(base.sparkSession), written(items)
        items.mapInArrow(_searched(block, schema, mode, no_overlap, most, digits), schema).write.mode("append").parquet(results)
    spark = base.sparkSession
    return spark.createDataFrame([], schema) if results is None else spark.read.schema(schema).parquet(results)


def work(queries: DataFrame, base: DataFrame, mode: str = "reference", no_overlap: float = 0.0, list_size: int = LIST_SIZE, digits: int | None = None) -> DataFrame:
    """What ``top`` does for each query: query_id, items, scored (items whose score was computed), blocks of items, and
    how many of these were skipped because of their bound."""
    from pyspark.sql.pandas.types import to_arrow_schema

    asked, items = _rows(queries, "query_id"), _rows(base, "item_id").sortWithinPartitions("item_id")
    schema = asked.select("query_id").schema
    for c in ("items", "scored", "blocks", "skipped"):
        schema = schema.add(c, "long")
    kinds, out = to_arrow_schema(schema), base.sparkSession.createDataFrame([], schema)
    for block, _ in _blocks(asked):
        out = out.unionByName(written(items.mapInArrow(_searched(block, kinds, mode, no_overlap, list_size, digits, True), schema)))
    return out.groupBy("query_id").agg(*(F.sum(c).alias(c) for c in ("items", "scored", "blocks", "skipped")))


def _scored(schema, query, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([query] * len(ids), kinds[0].type), pa.array(ids.tolist(), kinds[1].type), pa.array(score)], schema=kinds)


def scores(queries: DataFrame, base: DataFrame, mode: str = "reference", no_overlap: float = 0.0) -> DataFrame:
    """query_id, item_id, score of every query and item. Both inputs: id, word, value; zero values count as absent."""
    return _passes(queries, base, mode, no_overlap, None, None)


def top(queries: DataFrame, base: DataFrame, mode: str = "reference", no_overlap: float = 0.0, list_size: int | None = LIST_SIZE, digits: int | None = None) -> DataFrame:
    """The ``list_size`` best items of each query: query_id, rank, item_id, score; ties by item_id; no padding."""
    size = LIST_SIZE if list_size is None else list_size
    return ranked(_passes(queries, base, mode, no_overlap, size, digits), size, digits)


def ranked(scored: DataFrame, list_size: int | None = LIST_SIZE, digits: int | None = None) -> DataFrame:
    """The ``list_size`` best items of each query: query_id, rank, item_id, score; ties by item_id; no padding."""
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy("score", "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (LIST_SIZE if list_size is None else list_size)).select("query_id", "rank", "item_id", "score")


def result_lists(ranking: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """query_id and result, an array of (rank, url, score); ``names``: item_id, name."""
    named = ranking.join(names, "item_id") if names is not None else ranking.withColumn("name", F.col("item_id").cast("string"))
    entry = F.struct(F.col("rank"), F.concat(F.lit(URL), "name").alias("url"), F.col("score").cast("float").alias("score"))
    return named.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("result"))


def parsed_base(lines: DataFrame, column: str = "value") -> DataFrame:
    """name, word, value of base lines ``<name> idx:val ...``.

    Lines shorter than 2 are skipped, tokens without a colon too; numbers are read as far as they go (none: 0); words
    below 1 are dropped; the last of a repeated word wins; an item without terms has one row with a null word.
    """
    tokens = F.filter(F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " "), lambda t: t != "")
    number = lambda t: F.coalesce(F.regexp_extract(t, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))
    whole = lambda t: F.coalesce(F.regexp_extract(t, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    rows = lines.where(F.length(column) >= 2).select(tokens.alias("t")).where(F.size("t") > 0)
    pairs = F.filter(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda t: F.contains(t, F.lit(":")))
    terms = F.transform(pairs, lambda t, i: F.struct(whole(F.substring_index(t, ":", 1)).alias("word"), i.alias("at"), number(F.regexp_replace(t, "^[^:]*:", "")).cast("float").alias("value")))
    kept = F.filter(terms, lambda s: (s.word >= 1) & ~F.exists(terms, lambda o: (o.word == s.word) & (o.at > s.at)))
    return rows.select(F.col("t")[0].alias("name"), F.explode_outer(kept).alias("s")).select("name", F.col("s.word").alias("word"), F.col("s.value").alias("value"))


def base_lines(terms: DataFrame) -> DataFrame:
    """The inverse: a line for each name."""
    pair = F.struct("word", F.concat_ws(":", F.col("word").cast("string"), F.col("value").cast("string")).alias("s"))
    line = F.transform(F.array_sort(F.collect_list(pair)), lambda p: p.s)
    return terms.groupBy("name").agg(line.alias("t")).select(F.concat_ws(" ", "name", F.concat_ws(" ", "t")).alias("value"))
