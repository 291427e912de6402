"""Repair of vector files: NaN entries become a constant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import VECTOR_TYPE, repaired

VALUE = 0.9


def repair(vectors: DataFrame, column: str = "vector", value: float = VALUE) -> DataFrame:
    """``vectors`` with the data of ``column`` repaired; a null vector fails the job."""
    v = F.col(column)
    data = F.when(v.isNull(), F.raise_error(F.lit("null vector")).cast("array<float>")).otherwise(repaired(v.data, value))
    return vectors.withColumn(column, F.struct(v.dimension.alias("dimension"), v.ids.alias("ids"), data.alias("data")).cast(VECTOR_TYPE))


def repair_file(spark, source: str, target: str) -> None:
    """Reads a vector file, repairs it and writes another."""
    from ..sources import vector_file

    vector_file.register(spark)
    vector_file.write_file(repair(spark.read.format("fvf").load(source)), target)
