"""Gapless numbers of rows in groups of any size: no task holds a group.

Rows are dealt by (group, bucket of a drawn hash); the counts of buckets carry the numbers over, those of groups the
places of groups one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3  # of a hexadecimal hash: 4,096 buckets
_BEFORE = (Window.unboundedPreceding, -1)


def _before(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(*_BEFORE)), F.lit(0))


def numbered(rows: DataFrame, group: str, draw: str, key: str) -> DataFrame:
    """``rows`` with nth, the number in its group by (``draw``, a hexadecimal hash; ``key``), size, the group's rows, and
    start, the rows of the groups before (by the hash of the group, then the group). Null groups are left out."""
    rows = rows.where(F.col(group).isNotNull()).withColumn("bucket", F.substring(draw, 1, DIGITS))
    counts = rows.groupBy(group, "bucket").agg(F.count("*").alias("c"))
    sizes = counts.groupBy(group).agg(F.sum("c").alias("size")).withColumn("part", F.substring(F.md5(F.col(group).cast("string")), 1, DIGITS))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("c"))  # 4,096 rows at most
    parts = parts.select("part", _before("c", Window.orderBy("part")).alias("start"))
    groups = sizes.withColumn("inside", _before("size", Window.partitionBy("part").orderBy(group))).join(parts, "part").select(group, "size", (F.col("start") + F.col("inside")).alias("start"))
    # 4,096 rows a group at most
    begin = counts.select(group, "bucket", _before("c", Window.partitionBy(group).orderBy("bucket")).alias("before")).join(groups, group)
    order = Window.partitionBy(group, "bucket").orderBy(draw, key)
    placed = rows.join(begin, [group, "bucket"]).withColumn("nth", F.col("before") + F.row_number().over(order) - 1)
    return placed.drop("bucket", "before")
