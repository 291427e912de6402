"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 .. N-1 in a fixed order: bucket (a mix of doc_id and text checksum), doc_id, checksum, size.
A keyed Feistel network over the grid [0, a) x [0, b), with a*b >= N just above N, permutes the numbers; a result
outside [0, N) walks on along its cycle. The permuted number x gives shard x mod k and slot x div k, so counts
differ by one at most, slots are gapless, and shard and slot of a row can be computed from its number alone.

Only DataFrame and SQL functions. Narrow rows (doc_id, checksum, size) are shuffled, texts never. Rows equal in
those three stay one row with a count until they are numbered, so repeated rows never make a large group; rows
are dealt by doc_id and checksum together, so neither a frequent (or null) doc_id nor a frequent text does.

Null texts have size 8 and checksum 0, null doc_ids sort first; an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns

#: Buckets of the numbering, whatever the input's size: their counts are all that is broadcast.
BUCKETS = 4096
ROUNDS, STEPS, SEED = 6, 64, 17
PRIME = 2147483647


def mix_sql(value: str, key: str) -> str:
    """SQL that mixes a non-negative bigint to [0, 2**31 - 1), without overflow; Spark and DuckDB alike."""
    x = f"((({value}) % {PRIME} * (1103515245 + 2 * {key}) + 12345 + 7919 * {key}) % {PRIME})"
    return f"(({x} * 1597334677 + 40503 * {key} + ({x} % 8191) * 2654435) % {PRIME})"


def bucket_sql(doc_id: str, crc: str) -> str:
    return f"{mix_sql(f'{mix_sql(f"abs(coalesce({doc_id}, 0) % {PRIME})", "1")} + {crc}', '2')} % {BUCKETS}"


def permuted_sql(x: str, n: str, a: str, b: str) -> str:
    """Spark SQL: where the keyed permutation of [0, n) puts ``x``; the grid is ``a`` by ``b``."""
    once = (
        f"aggregate(sequence(1, {ROUNDS}), struct(x div {b} as l, x % {b} as r), (s, i) -> "
        f"if(i % 2 = 1, struct((s.l + {mix_sql('s.r', f'(i + {SEED})')}) % {a} as l, s.r as r), "
        f"struct(s.l as l, (s.r + {mix_sql('s.l', f'(i + {SEED})')}) % {b} as r)), s -> s.l * {b} + s.r)"
    )
    walked = f"aggregate(sequence(1, {STEPS}), cast({x} as bigint), (x, j) -> if(j > 1 and x < {n}, x, {once}))"
    return f"transform(array({walked}), x -> if(x < {n}, x, raise_error('the walk did not end')))[0]"


def shuffled_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, shard and slot of every row; see the module's text."""
    rows = columns(docs, doc_id="bigint", text="string").select(
        "doc_id",
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("bigint").alias("text_crc32"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
    )
    rows = rows.withColumn("bucket", F.expr(bucket_sql("doc_id", "text_crc32")))
    distinct = rows.groupBy("bucket", "doc_id", "text_crc32", "size").agg(F.count("*").alias("copies"))
    counts = distinct.groupBy("bucket").agg(F.sum("copies").alias("n"))
    every = Window.orderBy("bucket")
    offsets = counts.select(  # BUCKETS rows at most
        "bucket",
        F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    ).selectExpr("bucket", "before", "total", "cast(ceil(sqrt(total)) as bigint) as a", "cast(ceil(total / ceil(sqrt(total))) as bigint) as b")
    order = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size")
    numbered = (
        distinct.withColumn("upto", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(F.broadcast(offsets), "bucket")
        .withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
        .withColumn("row", F.expr("before + upto - copies + copy - 1"))
    )
    at = numbered.withColumn("x", F.expr(permuted_sql("row", "total", "a", "b")))
    return at.select("doc_id", "size", "text_crc32", F.expr(f"cast(x % {shards} as int)").alias("shard"), F.expr(f"x div {shards}").alias("slot"), "row")


def shard_and_slot(row: int, total: int, shards: int = 24) -> tuple[int, int]:
    """The same for one row number, computed alone."""
    a = -int(-(total**0.5) // 1)
    b = -(-total // a)

    def mix(v: int, key: int) -> int:
        x = (v % PRIME * (1103515245 + 2 * key) + 12345 + 7919 * key) % PRIME
        return (x * 1597334677 + 40503 * key + (x % 8191) * 2654435) % PRIME

    x = row
    while True:
        left, right = divmod(x, b)
        for i in range(1, ROUNDS + 1):
            if i % 2:
                left = (left + mix(right, i + SEED)) % a
            else:
                right = (right + mix(left, i + SEED)) % b
        x = left * b + right
        if x < total:
            return x % shards, x // shards
