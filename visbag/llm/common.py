"""What the operators share: sessions, shared folders, packed arrays."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to Python at once. Texts have no bounded length, so the default of 10,000 rows does not bound memory.
ARROW_ROWS = 512
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_KIND = contextvars.ContextVar("kind", default="tables")


def prepared(spark: SparkSession) -> SparkSession:
    """Sets the session's Arrow batch size to ``ARROW_ROWS``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast. Other columns, whatever their names, do not reach an operator."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as the session names it. Only a local session, whose tasks all run on this
    machine, may have none; it takes a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def _tables(spark: SparkSession, kind: str = "tables") -> str:
    return f"{shared_dir(spark)}/{kind}-{spark.sparkContext.applicationId}"


def forgotten(spark: SparkSession) -> None:
    """Removes the tables that operators of this application have materialised; their results must have been written."""
    _removed(spark, _tables(spark))


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """The tables that are materialised inside, under no kind of their own, are removed at the end, and no others: what is
    to last must have been materialised under a kind by then."""
    kind = f"passing-{uuid.uuid4().hex}"
    before = _KIND.set(kind)
    try:
        yield
    finally:
        _KIND.reset(before)
        _removed(spark, _tables(spark, kind))


def materialised(df: DataFrame, *partitions: str, kind: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: later plans start from files any executor can read."""
    spark = df.sparkSession
    path = f"{_tables(spark, kind or _KIND.get())}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, units: int, per_task: int) -> int:
    """Partitions for so many units of work: enough for ``per_task`` each, the session's count at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units // per_task))


def released() -> None:
    """Gives freed memory back to the system; workers are kept between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def packed(values: np.ndarray) -> bytes:
    """A compressed array, its bytes dealt by significance (sorted values then take few bytes)."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return values.dtype.str.encode() + b" " + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    kind, _, rest = data.partition(b" ")
    dtype = np.dtype(kind.decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(rest), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).reshape(-1)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive positions of ``first``."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
