"""Binary vector files as a Spark data source, ``format("fvf")``: schema vec_id, vector (dimension, ids, data), nullable.

One file (little endian): magic, int64 count, int64 offset of each vector; at its offset a tag (0 null, 1 float32,
2 uint8), a density byte, int32 dimension, for sparse ones int32 number of entries, the values, and their int32 ids.
Many files, read as one: a folder with the vectors of each task (``.dat``), their id, offset and end (``.idx``), and
MANIFEST, which names them in order. The vectors are numbered by their places, the ranks of vec_id, in either form.

Reading: a partition for each range of places, which reads its own part of the index; filters on vec_id are honoured;
``option("size", n)`` sets the range. ``selected`` reads the vectors of a table of ids, and little else.

Writing ``format("fvf")`` makes a folder: tasks write, and the commit orders their files by the ids they hold. If their
ids interleave (rows not partitioned by ranges), the driver merges the indexes, 24 bytes a vector; ``write`` deals the
rows by ranges first, and then nothing of a single vector comes to the driver. ``write_file`` makes one file of it: sizes
are summed first, then every task writes its own part of the index and of the vectors at its place in the file.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..schema import VECTOR_FILE

MAGIC, RANGE, BLOCK, GAP = b"FeatureVectorFile2.0", 10_000, 8 << 20, 64  # the first is a fixed value of the format


def _located(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _opened(path: str, write: bool = False):
    system, name = _located(path)
    if write and "/" in name:
        system.create_dir(name.rpartition("/")[0])
    return system.open_output_stream(name) if write else system.open_input_file(name)


def encoded(vector) -> bytes:
    """The bytes of one vector (a row of dimension, ids, data), or of null."""
    if vector is None:
        return b"\0"
    dimension, ids, data = vector[0], vector[1], np.array(vector[2], "<f4")
    with np.errstate(invalid="ignore"):
        small = bool(np.all((data >= 0) & (data <= 255) & (data == np.floor(data))))
    out = bytes([2 if small else 1, ids is None]) + struct.pack("<i", dimension)
    if ids is not None:
        out += struct.pack("<i", len(ids))
    out += data.astype(np.uint8).tobytes() if small else data.tobytes()
    return out + (np.array(ids, "<i4").tobytes() if ids is not None else b"")


def decoded(data: bytes, at: int = 0):
    """(dimension, ids, data) or None."""
    tag = data[at]
    if not tag:
        return None
    dense, (dimension,) = data[at + 1], struct.unpack_from("<i", data, at + 2)
    at, n = at + 6, dimension
    if not dense:
        (n,) = struct.unpack_from("<i", data, at)
        at += 4
    values = np.frombuffer(data, np.uint8 if tag == 2 else "<f4", n, at).astype(np.float32)
    at += n * (1 if tag == 2 else 4)
    ids = None if dense else np.frombuffer(data, "<i4", n, at).tolist()
    return dimension, ids, values.tolist()


def is_folder(path: str) -> bool:
    from pyarrow import fs

    system, name = _located(path)
    return system.get_file_info(name).type == fs.FileType.Directory


class Places:
    """Where the vectors of a file or folder are, by their places. What it holds does not grow with their number."""

    def __init__(self, path: str):
        self.path, self.manifest = path, None
        if is_folder(path):
            with _opened(f"{path}/MANIFEST") as f:
                self.manifest = json.loads(f.read())
            self.count = self.manifest["count"]
            self.first = np.cumsum([0, *(n for _, n in self.manifest["files"])])
            return
        with _opened(path) as f:
            start = f.read(len(MAGIC) + 8)
        if start[: len(MAGIC)] != MAGIC or len(start) < len(MAGIC) + 8:
            raise ValueError(f"not a vector file: {path}")
        (self.count,) = struct.unpack("<q", start[len(MAGIC) :])

    def _index(self, path: str, first: int, last: int) -> np.ndarray:
        with _opened(path) as f:
            f.seek(24 * first)
            return np.frombuffer(f.read(24 * (last - first)), "<i8").reshape(-1, 3)

    def of(self, first: int, last: int) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """The places ``first`` .. ``last`` - 1 in runs: file, first place, offsets, ends (-1 where not known)."""
        last = min(last, self.count)
        if first >= last:
            return
        if self.manifest is None:
            with _opened(self.path) as f:
                f.seek(len(MAGIC) + 8 + 8 * first)
                offsets = np.frombuffer(f.read(8 * (min(last + 1, self.count) - first)), "<i8")
            ends = np.full(last - first, -1)
            known = np.flatnonzero(offsets[1:] > offsets[:-1])
            ends[known] = offsets[known + 1]
            yield self.path, first, offsets[: last - first], ends
        elif "merged" in self.manifest:
            rows = self._index(f"{self.path}/{self.manifest['merged']}", first, last)
            cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(rows)]):
                yield f"{self.path}/{self.manifest['files'][rows[a, 0]][0]}.dat", first + int(a), rows[a:b, 1], rows[a:b, 2]
        else:
            for k in range(int(np.searchsorted(self.first, first, "right")) - 1, len(self.first) - 1):
                if self.first[k] >= last:
                    return
                a, b = max(first, int(self.first[k])), min(last, int(self.first[k + 1]))
                if a < b:
                    rows = self._index(f"{self.path}/{self.manifest['files'][k][0]}.idx", a - int(self.first[k]), b - int(self.first[k]))
                    yield f"{self.path}/{self.manifest['files'][k][0]}.dat", a, rows[:, 1], rows[:, 2]


def header(path: str) -> np.ndarray:
    """The offsets of all vectors, each in its file; their number is the number of vectors."""
    places = Places(path)
    return np.concatenate([np.zeros(0, np.int64), *(offsets for _, _, offsets, _ in places.of(0, places.count))])


def _alone(f, offset: int) -> bytes:
    """A vector whose end is not known."""
    f.seek(offset)
    data = f.read(10)
    if data[0] == 0:
        return data[:1]
    dense = bool(data[1])
    (n,) = struct.unpack_from("<i", data, 2 if dense else 6)
    return data + f.read(max(0, (6 if dense else 10) + n * ((1 if data[0] == 2 else 4) + (0 if dense else 4)) - len(data)))


def vectors(places: Places, wanted: np.ndarray) -> Iterator[tuple[int, tuple | None, int]]:
    """place, vector and bytes read for it, of ascending places. Places at most GAP apart share a look into the index,
    vectors that follow one another a read of the file."""
    cuts = np.flatnonzero(np.diff(wanted) > GAP) + 1
    for part in np.split(wanted, cuts):
        for i in range(0, len(part), RANGE):
            run = part[i : i + RANGE]
            if not len(run):
                continue
            for path, first, offsets, ends in places.of(int(run[0]), int(run[-1]) + 1):
                own = run[(run >= first) & (run < first + len(offsets))] - first
                yield from _read(path, first, own, offsets[own], ends[own], len(offsets))


def _read(path: str, first: int, own: np.ndarray, offsets: np.ndarray, ends: np.ndarray, looked: int):
    index = 8 * looked / max(1, len(own))
    with _opened(path) as f:
        i = 0
        while i < len(own):
            j = i
            while j + 1 < len(own) and ends[j] >= 0 and offsets[j + 1] == ends[j] and ends[j] - offsets[i] < BLOCK:
                j += 1
            if ends[j] < 0 and j > i:
                j -= 1
            if ends[j] < 0:
                data = _alone(f, int(offsets[j]))
            else:
                f.seek(int(offsets[i]))
                data = f.read(int(ends[j] - offsets[i]))
            for k in range(i, j + 1):
                yield first + int(own[k]), decoded(data, int(offsets[k] - offsets[i])), round(len(data) / (j + 1 - i) + index)
            i = j + 1


class Range(InputPartition):
    def __init__(self, places: Places, wanted: range | list[int]):
        self.places, self.wanted = places, wanted


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("size", RANGE))
        self.low, self.high, self.only = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("vec_id",) and hasattr(f, "value"):
                value = f.value
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, value), value + 1 if self.high is None else min(self.high, value + 1)
                elif isinstance(f, In):
                    found = {x for x in value if x is not None}
                    self.only = found if self.only is None else self.only & found
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    high = value + isinstance(f, LessThanOrEqual)
                    self.high = high if self.high is None else min(self.high, high)
            yield f  # Spark checks them again

    def partitions(self) -> list[Range]:
        places = Places(self.path)
        low, high = max(0, self.low), places.count if self.high is None else min(places.count, self.high)
        wanted = range(low, high) if self.only is None else sorted(i for i in self.only if low <= i < high)
        return [Range(places, wanted[i : i + self.size]) for i in range(0, max(1, len(wanted)), self.size)]

    def read(self, partition: Range):
        for place, v, _ in vectors(partition.places, np.array(partition.wanted, np.int64)):
            yield Row(place, None if v is None else Row(*v))


class Part(WriterCommitMessage):
    """A task's files, the number and bytes of its vectors, the least and greatest id, and whether the ids ascend."""

    def __init__(self, name: str, count: int, size: int, low: int, high: int, ascends: bool):
        self.name, self.count, self.size, self.low, self.high, self.ascends = name, count, size, low, high, ascends


class Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.capacity = options["path"], options.get("capacity")
        self.run = uuid.uuid4().hex
        # a file of this name makes way when the folder is complete
        self.where = f"{self.path}.{self.run}" if _exists(self.path) and not is_folder(self.path) else self.path

    def write(self, iterator) -> Part:
        name = f"{self.run}-{uuid.uuid4().hex}"
        count = end = 0
        low = high = None
        ascends = True
        with _opened(f"{self.where}/{name}.dat", write=True) as data, _opened(f"{self.where}/{name}.idx", write=True) as index:
            for r in iterator:
                coded = encoded(r.vector)
                data.write(coded)
                index.write(struct.pack("<qqq", r.vec_id, end, end + len(coded)))
                end, count = end + len(coded), count + 1
                ascends &= high is None or r.vec_id >= high
                low, high = r.vec_id if low is None else min(low, r.vec_id), r.vec_id if high is None else max(high, r.vec_id)
        return Part(name, count, end, low, high, ascends)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m and m.count), key=lambda p: (p.low, p.high))
        count = sum(p.count for p in parts)
        if self.capacity is not None and count > int(self.capacity):
            self.abort(messages)
            raise ValueError(f"{count} vectors; the index has room for {self.capacity}")
        system, name = _located(self.path)
        if self.where != self.path:
            system.delete_file(name)
            if _exists(self.where):
                system.move(_located(self.where)[1], name)
        manifest = {"count": count, "files": [(p.name, p.count) for p in parts], "bytes": [p.size for p in parts]}
        if not all(p.ascends for p in parts) or any(p.high > q.low for p, q in zip(parts, parts[1:])):
            manifest["merged"] = f"{self.run}.merged"
            rows = []
            for k, p in enumerate(parts):
                with _opened(f"{self.path}/{p.name}.idx") as f:
                    rows.append(np.insert(np.frombuffer(f.read(), "<i8").reshape(-1, 3), 1, k, axis=1))
            rows = np.concatenate(rows)
            with _opened(f"{self.path}/{manifest['merged']}", write=True) as f:
                f.write(rows[np.argsort(rows[:, 0], kind="stable"), 1:].astype("<i8").tobytes())
        with _opened(f"{self.path}/.{self.run}", write=True) as f:
            f.write(json.dumps(manifest).encode())
        system.move(f"{name}/.{self.run}", f"{name}/MANIFEST")
        kept = {"MANIFEST", f"{self.run}.merged", *(f"{p.name}.{kind}" for p in parts for kind in ("dat", "idx"))}
        self._removed(self.path, lambda n: n not in kept)  # of earlier writes, and of attempts that did not count

    def abort(self, messages) -> None:
        self._removed(self.where, lambda n: n.startswith(self.run))

    def _removed(self, folder: str, which) -> None:
        from pyarrow import fs

        system, name = _located(folder)
        for f in system.get_file_info(fs.FileSelector(name, allow_not_found=True)):
            if f.type == fs.FileType.File and which(f.base_name):
                system.delete_file(f.path)


def is_local(path: str) -> bool:
    """Whether ``path`` is on a mounted file system, which can be written at any place."""
    from pyarrow import fs

    return isinstance(_located(path)[0], fs.LocalFileSystem)


def _exists(path: str) -> bool:
    from pyarrow import fs

    system, name = _located(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def write(df: DataFrame, path: str, files: int | None = None, capacity: int | None = None) -> None:
    """Rows of vec_id and vector as a folder whose files hold ranges of vec_id; at most ``capacity`` vectors, if given."""
    many = (files,) if files else ()
    rows = df.select("vec_id", "vector").repartitionByRange(*many, "vec_id").sortWithinPartitions("vec_id").write.format("fvf").mode("overwrite")
    (rows if capacity is None else rows.option("capacity", capacity)).save(path)


def write_file(df: DataFrame, path: str, files: int | None = None, capacity: int | None = None) -> None:
    """Rows of vec_id and vector as one file, with room for ``capacity`` vectors in its index. ``path`` must be on a file
    system that all tasks share and that is written at any place; elsewhere ``write`` makes a folder that reads the same."""
    system, target = _located(path)
    if not is_local(path):
        raise ValueError("one file takes a file system that is written at any place; write() makes a folder")
    run = uuid.uuid4().hex
    folder, hidden = f"{path}.parts-{run}", f"{target}.{run}"
    try:
        write(df, folder, files, capacity)
        manifest = Places(folder).manifest
        room = manifest["count"] if capacity is None else int(capacity)
        bases = len(MAGIC) + 8 + 8 * room + np.cumsum([0, *manifest["bytes"]])
        firsts = np.cumsum([0, *(n for _, n in manifest["files"])])
        with open(hidden, "wb") as f:
            f.write(MAGIC + struct.pack("<q", manifest["count"]))
            f.truncate(int(bases[-1]))
        rows = [(name, int(first), int(base)) for (name, _), first, base in zip(manifest["files"], firsts, bases)]

        def placed(batches):
            for batch in batches:
                for name, first, base in zip(*(c.to_pylist() for c in batch.columns)):
                    with open(os.open(hidden, os.O_RDWR), "r+b") as out, _opened(f"{folder}/{name}.idx") as index, _opened(f"{folder}/{name}.dat") as data:
                        out.seek(len(MAGIC) + 8 + 8 * first)
                        while block := index.read(24 * (BLOCK // 24)):
                            out.write((np.frombuffer(block, "<i8").reshape(-1, 3)[:, 1] + base).astype("<i8").tobytes())
                        out.seek(base)
                        while block := data.read(BLOCK):
                            out.write(block)
                yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

        if rows:
            parts = df.sparkSession.createDataFrame(rows, "name string, first bigint, base bigint").repartition(len(rows))
            parts.mapInArrow(placed, "name string").write.format("noop").mode("overwrite").save()
        if os.path.isdir(target):
            system.delete_dir(target)
        os.replace(hidden, target)
    finally:
        if os.path.exists(hidden):
            os.remove(hidden)
        if _exists(folder):
            system.delete_dir(_located(folder)[1])


class VectorFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fvf"

    def schema(self) -> StructType:
        return VECTOR_FILE

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFile)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def picked(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """vec_id, vector, bytes of the places in ``ids`` (a DataFrame with vec_id; others are passed over). Ids are dealt by
    ranges and sorted, so that each task reads a few runs of the index and of the file; ``bytes`` is a row's share of what
    was read for it. No index comes to the driver."""
    places = Places(path)
    rows = ids.select(F.col("vec_id").cast("bigint")).where(f"vec_id >= 0 and vec_id < {places.count}").distinct()
    rows = rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    schema = StructType([*VECTOR_FILE.fields]).add("bytes", "long")

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            found = list(vectors(places, batch.column(0).to_numpy()))
            rows = [{"vec_id": i, "vector": None if v is None else dict(zip(("dimension", "ids", "data"), v)), "bytes": n} for i, v, n in found]
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return rows.mapInArrow(read, schema)


def selected(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The vectors of ``ids`` (a DataFrame with vec_id) in their places, null elsewhere: the file's full length."""
    all_ = spark.range(Places(path).count).withColumnRenamed("id", "vec_id")
    return all_.join(picked(spark, path, ids).drop("bytes"), "vec_id", "left")


def looked_up(spark: SparkSession, path: str, vec_id: int, check: bool = False):
    """One row: vec_id and its vector. ``check``: an error if there is no such vector."""
    n = Places(path).count
    if not 0 <= vec_id < n:
        raise IndexError(f"vector {vec_id} of {n}")
    row = spark.read.format("fvf").load(path).where(f"vec_id = {int(vec_id)}")
    if not check:
        return row
    return row.select("vec_id", F.when(F.col("vector").isNotNull(), F.col("vector")).otherwise(F.raise_error(F.lit(f"vector {vec_id} is null")).cast(row.schema["vector"].dataType)).alias("vector"))
