"""A mixture of sources with target weights that vary over the training: every document's training positions.

Sources in order (code points, null last) have the weights WEIGHTS, repeating, and share the words of all documents; a
source is taken at most MOST times, and what is over goes to the others by weight. So a target is min(MOST * size,
level * weight) for one level, which sums of the sources in order of size / weight give (one row a source, one task).

A source's weight at time t of the training (0 to 1) is its target times a schedule, linear between knots. Its demand up
to t is the integral, in pieces of second degree. A source's documents stand one after another in an order drawn by hash,
pass after pass, until the target is reached (the last one is cut, so the words taken are the target to a word). The
training position of a document's pass is the time at which the demand reaches the words before it: the inverse of the
integral. ``in_order`` sorts the passes by position.

Texts are read once; narrow rows are dealt by (source, bucket of the order), so no source makes a large group; the
buckets' sums carry the words over. Rows equal in source, doc_id, size and hash are one row with a count until the end,
and do not make a large group either. Null texts have no words and size 0; documents of size 0 are taken 0 times; null
doc_ids are rows like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, materialised, tasks_for

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (5, 2, 1), 3
#: By weight: factors at knots with equal distances. Sources with much weight fade, those with little come late.
SCHEDULES = {5: (1.5, 1.25, 0.25), 2: (1.0, 1.0, 1.0), 1: (0.0, 1.0, 2.0)}
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 64


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight and target of ``sources`` (source, source_size), as in the module's text."""
    named = Window.orderBy(F.asc_nulls_last("source"))
    rank = F.row_number().over(named) - 1
    sized = sources.withColumn("weight", F.element_at(F.lit(list(weights)), (rank % len(weights) + 1).cast("int")))
    sized = sized.withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    level = (F.sum("source_size").over(whole) - before("cap")) / (F.sum("weight").over(whole) - before("weight"))
    filled = sized.withColumn("level", level)
    # the first source that its share does not fill sets the level for itself and those after it
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    filled = filled.withColumn("level", F.first(fits, ignorenulls=True).over(whole))
    return filled.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def inverted_sql(u: str, factors: str) -> str:
    """SQL: the time at which a schedule (an array of factors at knots) has reached the share ``u`` of its integral."""
    pieces = f"transform(sequence(1, size({factors}) - 1), i -> ({factors}[i - 1] + {factors}[i]) / 2)"
    ends = f"transform(sequence(1, size({factors}) - 1), i -> aggregate(slice({pieces}, 1, i), 0D, (s, x) -> s + x))"
    return (
        f"transform(transform(array(struct({ends} as ends, {factors} as f, {u} as u)), x -> struct(x.f as f, size(x.ends) as n, x.ends as ends, x.u * element_at(x.ends, -1) as r)), "
        "x -> transform(array(least(x.n - 1, size(filter(x.ends, e -> e <= x.r)))), i -> "
        "(i + coalesce(2 * (x.r - if(i = 0, 0D, x.ends[i - 1])) / nullif(x.f[i] + sqrt(greatest(0D, x.f[i] * x.f[i] + 2 * (x.f[i + 1] - x.f[i]) * (x.r - if(i = 0, 0D, x.ends[i - 1])))), 0D), 0D)) / x.n)[0])[0]"
    )


def scheduled(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, schedules: dict[int, tuple[float, ...]] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and passes: arrays of (words, position) of each pass that takes
    of the document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = columns(docs, doc_id="bigint", source="string", text="string").select(
        "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text)).alias("draw")
    )
    rows = materialised(rows)
    buckets = tasks_for(rows.sparkSession, max(rows.count(), LEAST_BUCKETS * BUCKET_ROWS), BUCKET_ROWS)
    bucket = F.expr(f"cast(conv(substr(draw, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296")
    distinct = rows.groupBy("source", bucket.alias("bucket"), "draw", "doc_id", "size").agg(F.count("*").alias("copies"))
    sums = materialised(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")))
    mixed = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = sums.select("source", "bucket", before.alias("before"))
    # both by (source, bucket), a row each; null-safe, since a source may be null
    begin = begin.join(mixed, begin["source"].eqNullSafe(mixed["source"])).select(begin["source"].alias("s"), F.col("bucket").alias("b"), "before", "source_size", "weight", "target")
    placed = distinct.join(begin, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    within = Window.partitionBy("source", "bucket").orderBy("draw", F.asc_nulls_first("doc_id"), "size")
    upto = F.sum(F.col("size") * F.col("copies")).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn("upto", upto).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    placed = placed.withColumn("offset", F.expr("before + upto - (copies - copy + 1) * size")).withColumn("budget", F.expr("cast(floor(target + 0.5) as bigint)"))
    known = schedules or SCHEDULES
    # the keys are weights, a few, whatever the data
    factors = F.coalesce(*(F.when(F.col("weight") == w, F.array(*(F.lit(float(x)) for x in f))) for w, f in known.items()), F.array(F.lit(1.0), F.lit(1.0)))
    passes = F.expr(
        f"filter(transform(sequence(0L, {most - 1}L), k -> struct(greatest(0L, least(size, budget - k * source_size - offset)) as words, "
        f"(k * source_size + offset) / cast(greatest(budget, 1L) as double) as share)), p -> p.words > 0)"
    )
    placed = placed.withColumn("factors", factors).withColumn("passes", passes)
    passes = F.expr(f"transform(passes, p -> struct(p.words as words, {inverted_sql('p.share', 'factors')} as position))")
    taken = F.expr("aggregate(passes, 0L, (s, p) -> s + p.words)")
    return placed.withColumn("passes", passes).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes")


def in_order(plan: DataFrame) -> DataFrame:
    """The passes of ``scheduled`` in training order: range partitions by position, sorted (then by source, doc_id)."""
    rows = plan.select("doc_id", "source", F.explode("passes").alias("p")).select(F.col("p.position").alias("position"), "source", "doc_id", F.col("p.words").alias("words"))
    return rows.repartitionByRange("position", "source", "doc_id").sortWithinPartitions("position", "source", "doc_id")
