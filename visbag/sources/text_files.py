"""Codebook, search-base and forest files."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators import search
from ..schema import CODEBOOK, NODES

# Fixed values of the formats.
CODEBOOK_MAGIC = "Projection+K-means"
FOREST_MAGICS = {"TERC": "ExtreamlyRandomizedClusteringForestFile", "TCMP": "CmpClusteringForestFile", "TPC": "ProjectionClusteringForestFile", "TPC binary": "ProjectionClusteringForestFileBinary"}


class Codebook:
    """A codebook with what goes along: projection rows (or None), average word distance (or None), exactness."""

    def __init__(self, centers: np.ndarray, projection: np.ndarray | None = None, average: float | None = None, exact: bool = True):
        self.centers, self.projection, self.average, self.exact = np.asarray(centers, np.float32), projection, average, exact

    @property
    def input_dimension(self) -> int:
        return self.projection.shape[1] if self.projection is not None else self.centers.shape[1]

    @property
    def word_count(self) -> int:
        return len(self.centers)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centers)], CODEBOOK)


def _read(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row.content)


def parse_codebook(text: str) -> Codebook:
    words = iter(text.split())
    if next(words, None) != CODEBOOK_MAGIC:
        raise ValueError("not a codebook file")

    def matrix():
        rows, cols = int(next(words)), int(next(words))
        values = np.array([float(next(words)) for _ in range(rows * cols)], np.float64)
        return values.reshape(rows, cols) if rows and cols else None

    exact, projection, centers = next(words) not in ("0", "false"), matrix(), matrix()
    average = None
    for word in words:
        if word == "avgWordDistance":
            average = float(next(words))
    return Codebook(centers if centers is not None else np.zeros((0, 0)), projection, average, exact)


def format_codebook(book: Codebook) -> str:
    lines = [CODEBOOK_MAGIC, str(int(book.exact))]
    for m in (book.projection, book.centers):
        lines += ["0 0", ""] if m is None else [f"{m.shape[0]} {m.shape[1]}", *(" ".join(repr(float(x)) for x in row) for row in m), ""]
    if book.average is not None:
        lines.append(f"avgWordDistance {book.average!r}")
    return "\n".join(lines) + "\n"


def read_codebook(spark: SparkSession, path: str) -> Codebook:
    return parse_codebook(_read(spark, path).decode())


def write_codebook(book: Codebook, path: str, spark: SparkSession | None = None) -> None:
    """With a session, an average word distance that is not set is computed first."""
    from ..operators.codebook import average_word_distance
    from .vector_file import _opened

    if book.average is None and spark is not None and book.word_count > 1:
        book = Codebook(book.centers, book.projection, average_word_distance(book.frame(spark)).first()[0], book.exact)

    with _opened(path, write=True) as f:
        f.write(format_codebook(book).encode())


def read_base(spark: SparkSession, path: str) -> DataFrame:
    """name, word, value."""
    return search.parsed_base(spark.read.text(path))


def write_base(terms: DataFrame, path: str) -> None:
    search.base_lines(terms).write.mode("overwrite").text(path)


def parse_forest(data: bytes) -> tuple[str, list[dict]]:
    """(kind, node rows) of a forest file, text or binary."""
    head = data.split(None, 2)
    kind = {v: k for k, v in FOREST_MAGICS.items()}.get(head[0].decode("ascii", "replace") if head else "")
    if kind is None:
        raise ValueError("not a forest file")
    trees, rows = int(head[1]), []
    if kind == "TPC binary":
        at = data.index(head[1], len(head[0])) + len(head[1]) + 1

        def take(fmt: str):
            nonlocal at
            out = struct.unpack_from("<" + fmt, data, at)
            at += struct.calcsize("<" + fmt)
            return out

        def node_fields():
            left, right, left_word, right_word, deviation, threshold, n = take("qqiiffi")
            return bool(left), bool(right), left_word, right_word, {"deviation": deviation, "threshold": threshold, "projection": list(take(f"{n}f"))}
    else:
        words = iter(data.decode().split()[2:])

        def node_fields():
            left, right, left_word, right_word = (int(next(words)) for _ in range(4))
            if kind == "TERC":
                more = {"dim1": int(next(words)), "threshold": float(next(words))}
            elif kind == "TCMP":
                more = {"dim1": int(next(words)), "dim2": int(next(words))}
            else:
                more = {"deviation": float(next(words)), "threshold": float(next(words))}
                more["projection"] = [float(next(words)) for _ in range(int(next(words)))]
            return bool(left), bool(right), left_word, right_word, more

    for tree in range(trees):
        count, waiting = 0, [None]  # (parent row, side); nodes come in pre-order
        while waiting:
            link = waiting.pop()
            left, right, left_word, right_word, more = node_fields()
            row = {"tree": tree, "node": count, "left_node": None, "right_node": None, "left_word": left_word, "right_word": right_word, "dim1": None, "dim2": None, "threshold": None, "deviation": None, "projection": None} | more
            if link:
                link[0][link[1]] = count
            rows.append(row)
            count += 1
            waiting += [(row, "right_node")] * right + [(row, "left_node")] * left
    return kind.split()[0], rows


def format_forest(kind: str, rows: list[dict]) -> bytes:
    """TERC and TCMP as text, TPC binary; child presence is written as 0 or 1."""
    by = {(r["tree"], r["node"]): r for r in rows}
    trees = sorted({r["tree"] for r in rows})
    magic = FOREST_MAGICS["TPC binary" if kind == "TPC" else kind]
    out = [f"{magic} {len(trees)} ".encode()]
    for tree in trees:
        stack = [0]
        while stack:
            r = by[tree, stack.pop()]
            has = r["left_node"] is not None, r["right_node"] is not None
            if kind == "TPC":
                p = list(r["projection"])
                out.append(struct.pack(f"<qqiiffi{len(p)}f", *has, r["left_word"] or 0, r["right_word"] or 0, r["deviation"] or 0.0, r["threshold"], len(p), *p))
            else:
                more = (r["dim1"], repr(float(r["threshold"]))) if kind == "TERC" else (r["dim1"], r["dim2"])
                out.append((" ".join(map(str, (int(has[0]), int(has[1]), r["left_word"] or 0, r["right_word"] or 0, *more))) + "\n").encode())
            stack += [r["right_node"]] * has[1] + [r["left_node"]] * has[0]
    return b"".join(out)


def read_forest(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    kind, rows = parse_forest(_read(spark, path))
    return kind, spark.createDataFrame([tuple(r[f.name] for f in NODES) for r in rows], NODES)


def write_forest(kind: str, nodes: DataFrame, path: str) -> None:
    from .vector_file import _opened

    with _opened(path, write=True) as f:
        f.write(format_forest(kind, [r.asDict() for r in nodes.collect()]))
