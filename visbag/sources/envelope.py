"""The work envelope: proto2 wire format to and from rows of ``visbag.schema.ENVELOPE``, matrices of blobs, stand-in features."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import ENVELOPE, HEADER

# Field numbers and kinds of the wire schema. kind: s string, b bytes, u uint, d double, f float, m message; + repeated, p packed.
MESSAGES = {
    "WorkRequest": {1: ("uuid", "s"), 2: ("timestamp", "d"), 3: ("configuration", "m+", "Configuration"), 5: ("pastConfiguration", "m+", "Configuration"), 6: ("errorCode", "u"), 7: ("message", "s+"), 8: ("returnQueue", "s"), 17: ("image", "b"), 18: ("blob", "m", "BlobFloat"), 19: ("result", "m", "ResultList")},
    "Configuration": {1: ("queue", "s"), 2: ("fe", "m", "Empty"), 3: ("translate", "m", "Translate"), 4: ("match", "m", "Match"), 5: ("caffe", "m", "Caffe")},
    "Empty": {}, "Translate": {1: ("neighborCount", "u")}, "Match": {1: ("listSize", "u"), 2: ("database", "s")}, "Caffe": {1: ("resultSize", "u")},
    "BlobFloat": {1: ("dim", "up"), 2: ("data", "b")}, "ResultList": {1: ("score", "fp"), 2: ("url", "s+")},
}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 127) << shift
        if byte < 128:
            return out, at
        shift += 7
        if shift > 63:
            raise ValueError("varint too long")


def _scalar(kind: str, wire: int, data: bytes, at: int):
    if wire == 0:
        return _varint(data, at)
    size = {1: 8, 5: 4}.get(wire)
    if size is None:
        size, at = _varint(data, at)
    if wire not in (1, 2, 5) or at + size > len(data):
        raise ValueError("truncated message")
    raw = data[at : at + size]
    return (struct.unpack("<d" if wire == 1 else "<f", raw)[0] if wire in (1, 5) else raw), at + size


def parse(data: bytes, name: str = "WorkRequest") -> dict:
    """A dict of the fields present; unknown fields are skipped; ValueError or IndexError on malformed bytes."""
    fields, out, at = MESSAGES[name], {}, 0
    while at < len(data):
        key, at = _varint(data, at)
        value, at = _scalar("", key & 7, data, at)
        if key >> 3 not in fields:
            continue
        field, kind, *message = fields[key >> 3]
        if kind[0] == "m":
            value = parse(value, message[0])
        elif kind[0] == "s":
            value = value.decode()
        if kind.endswith("p"):
            if isinstance(value, bytes):
                if kind[0] == "f":
                    value = list(struct.unpack(f"<{len(value) // 4}f", value))
                else:
                    items, pos = [], 0
                    while pos < len(value):
                        item, pos = _varint(value, pos)
                        items.append(item)
                    value = items
            else:
                value = [value]
            out.setdefault(field, []).extend(value)
        elif kind.endswith("+"):
            out.setdefault(field, []).append(value)
        else:
            out[field] = value
    if name == "BlobFloat" and "data" not in out:
        raise ValueError("a blob without data")
    return out


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def serialise(value: dict, name: str = "WorkRequest") -> bytes:
    out = b""
    for number, (field, kind, *message) in MESSAGES[name].items():
        if value.get(field) is None:
            continue
        items = value[field] if kind.endswith("+") else [value[field]]
        for item in items:
            if kind[0] == "m":
                wire, data = 2, serialise(item, message[0])
            elif kind.endswith("p"):
                wire, data = 2, struct.pack(f"<{len(item)}f", *item) if kind[0] == "f" else b"".join(map(_number, item))
            elif kind[0] in "sb":
                wire, data = 2, item.encode() if isinstance(item, str) else bytes(item)
            else:
                wire, data = {"u": 0, "d": 1}[kind[0]], item
            out += _number(number << 3 | wire) + (_number(len(data)) + data if wire == 2 else _number(data) if wire == 0 else struct.pack("<d", data))
    return out


def _row(message: dict) -> dict:
    result, out = message.get("result"), dict(message)
    if result is not None:
        out["result"] = [{"rank": i + 1, "url": u, "score": s} for i, (u, s) in enumerate(zip(result.get("url", []), result.get("score", [])))]
    for side in ("configuration", "pastConfiguration"):
        out[side] = [c | {"fe": True if "fe" in c else None} for c in message.get(side, [])]
    out.setdefault("message", [])
    out.setdefault("errorCode", 0)
    return out


def _message(row: dict) -> dict:
    out = dict(row)
    if row.get("result") is not None:
        out["result"] = {"score": [r["score"] for r in row["result"]], "url": [r["url"] for r in row["result"]]}
    for side in ("configuration", "pastConfiguration"):
        out[side] = [{k: ({} if k == "fe" else v) for k, v in c.items() if v} for c in row.get(side) or []]
    return out


def decode(messages: DataFrame, column: str = "value") -> DataFrame:
    """The envelope's columns, ``malformed`` (their bytes could not be read), and ``column``."""
    schema = messages.select(column).schema
    for f in ENVELOPE.fields:
        schema = schema.add(f)
    schema = schema.add("malformed", "boolean")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(column).to_pylist():
                try:
                    rows.append(_row(parse(data)) | {column: data, "malformed": False})
                except (ValueError, IndexError, TypeError, AttributeError, struct.error):
                    rows.append({column: data, "malformed": True})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return messages.select(column).mapInArrow(run, schema)


def encode(envelopes: DataFrame) -> DataFrame:
    """uuid, value: the serialised envelope."""
    names = [f.name for f in ENVELOPE.fields]

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["uuid"] for r in rows], pa.string()), pa.array([serialise(_message(r)) for r in rows], pa.binary())], ["uuid", "value"])

    return envelopes.select(*names).mapInArrow(run, "uuid string, value binary")


def matrix_rows(envelopes: DataFrame, column: str = "blob", *keep: str) -> DataFrame:
    """``keep``, row, values of the float32 matrix of each blob (dim[0] columns, dim[1] rows); none of an empty one."""
    schema = envelopes.select(*keep, F.lit(0).alias("row"), F.array(F.lit(0.0).cast("float")).alias("values")).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                blob = r[column]
                if blob and blob["data"] and len(blob["dim"] or []) >= 2:
                    cols, n = blob["dim"][:2]
                    for i, values in enumerate(np.frombuffer(blob["data"], "<f4", cols * n).reshape(n, cols).tolist()):
                        rows.append({k: r[k] for k in keep} | {"row": i, "values": values})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return envelopes.select(*keep, column).mapInArrow(run, schema)


def header_and_descriptor(rows: DataFrame, values: str = "values") -> DataFrame:
    """Names for the first six values; the rest is the descriptor."""
    named = [F.try_element_at(values, F.lit(i + 1)).alias(c) for i, c in enumerate(HEADER)]
    return rows.select(*(c for c in rows.columns if c != values), *named, F.slice(values, 7, F.greatest(F.size(values) - 6, F.lit(0))).alias("descriptor"))


def blobs(rows: DataFrame, key: str, order: str, values: str, words: int | None = None) -> DataFrame:
    """key, blob of each group's rows in order; an image's features meet in one row, as the wire format has them."""
    packed = F.array_sort(F.collect_list(F.struct(order, values)))

    def run(batches):
        for batch in batches:
            out = []
            for found in batch.column("rows").to_pylist():
                m = np.array([r[values] for r in found], "<f4")
                out.append({"dim": [m.shape[1] if m.ndim > 1 else 0, len(m), *([words] if words is not None else [])], "data": m.tobytes()})
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.struct([("dim", pa.list_(pa.int64())), ("data", pa.binary())]))], [key, "blob"])

    grouped = rows.groupBy(key).agg(packed.alias("rows"))
    schema = grouped.select(key, F.struct(F.array(F.lit(0).cast("bigint")).alias("dim"), F.lit(b"").alias("data")).alias("blob")).schema
    return grouped.mapInArrow(run, schema)


def dummy_features(spark: SparkSession, rows: int = 5, columns: int = 50) -> DataFrame:
    """row, values: a fixed matrix whose i-th entry is 3.1415926 i, for tests of the stages after extraction."""
    flat = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias("row"), (F.col("id") % columns).alias("c"), (F.col("id") * 3.1415926).cast("float").alias("v"))
    return flat.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: s.v).alias("values"))


def gaussian_mixture(spark: SparkSession, rows: int, dim: int, means: int = 4, seed: int = 1) -> DataFrame:
    """feature_id, label, descriptor: row i around mean i % means; the means are drawn from N(0, 1) too."""
    centers = np.random.default_rng(seed).standard_normal((means, dim)).tolist()
    book = F.array(*(F.array(*(F.lit(x) for x in c)) for c in centers))
    noise = [F.randn(seed + 1 + i) for i in range(dim)]
    label = (F.col("id") % means).cast("int")
    return spark.range(rows).select(F.col("id").alias("feature_id"), label.alias("label"), F.transform(F.arrays_zip(book[label].alias("m"), F.array(*noise).alias("e")), lambda s: (s.m + s.e).cast("float")).alias("descriptor"))


def extracted(images: DataFrame, extract) -> DataFrame:
    """Features of ``images`` (image_id, image): ``extract`` takes bytes and gives (header rows of six, descriptors).

    Undecodable images (an exception of ``extract``) have no features. No extractor is built in: the detector that
    the wire format's examples use is not freely available.
    """
    from ..schema import FEATURES

    arrow = to_arrow_schema(FEATURES)

    def run(batches):
        for batch in batches:
            rows = []
            for image_id, data in zip(batch.column("image_id").to_pylist(), batch.column("image").to_pylist()):
                try:
                    points, descriptors = extract(data)
                except Exception:  # noqa: BLE001  a bad image is data, not a failure of the job
                    continue
                for i, (p, d) in enumerate(zip(points, descriptors)):
                    rows.append({"image_id": image_id, "feature_id": i, "descriptor": [float(x) for x in d]} | dict(zip(HEADER, (float(x) if x is not None else math.nan for x in p))))
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return images.select("image_id", "image").mapInArrow(run, FEATURES)
