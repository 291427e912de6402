"""Byte-level BPE: overlapping chunks, resynchronised pre-tokens, pieces encoded once each, decoding by bytes.

A text of at most CHUNK characters is pre-tokenised where it lies. A longer one is cut into chunks that overlap by
OVERLAP characters, each pre-tokenised by any task; a text's chunks meet again, only as boundary positions, and are
stitched: matching never looks left of where it starts, so once a boundary of the next chunk coincides with a true
boundary, all later ones are true, but for those the chunk's end may have cut. Where no boundaries coincide within
the overlap, the gap is matched again from the last true boundary. A long text is known by its SHA-256 and length, not
by its place, so a task that runs again, over rows in any order, finds the same chunks; copies are encoded once, and
the result goes back to each row by that key.

Pieces (pre-tokens) are encoded separately and remembered up to a fixed number. Decoding joins raw bytes.
Null and empty texts have no ids; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, released, tasks_for

CHUNK, OVERLAP, REMEMBERED = 32_768, 512, 50_000


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Pieces(dict):
    """piece -> (its ids as text, a blank before each; its decoded bytes; number of ids)."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.pattern, table = regex.compile(pattern), ranks(path)
        self.bytes_of = {v: k for k, v in table.items()}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __missing__(self, piece: str) -> tuple[str, bytes, int]:
        ids = self.encoding._encode_single_piece(piece)
        found = "".join(f" {i}" for i in ids), b"".join(map(self.bytes_of.__getitem__, ids)), len(ids)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = found
        return found

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def ends(self, text: str, start: int = 0) -> list[int]:
        return [m.end() for m in self.pattern.finditer(text, start)]

    def encoded(self, pieces: list[str]) -> tuple[str, bytes, int]:
        found = [self[p] for p in pieces]
        return "".join([f[0] for f in found])[1:], b"".join([f[1] for f in found]), sum([f[2] for f in found])


_OPEN: dict = {}


def pieces_of(path: str, pattern: str) -> Pieces:
    """One for each worker process."""
    if (path, pattern) not in _OPEN:
        _OPEN.clear()
        _OPEN[path, pattern] = Pieces(path, pattern)
    return _OPEN[path, pattern]


def cut(text: str) -> list[tuple[int, str]]:
    return [(at, text[at : at + CHUNK + OVERLAP]) for at in range(0, len(text), CHUNK)]


def stitched(text: str, chunks: list[tuple[int, list[int]]], ends, margin: int = 2) -> list[int]:
    """True piece ends of ``text``, from each chunk's (start, ends seen in it); ``ends`` matches again where needed."""
    true = [0]
    for at, seen in sorted(chunks):
        last = bool(seen) and seen[-1] >= len(text)
        usable = seen if last else seen[:-margin]  # the cut may have shaped the last ones
        behind = {x for x in true[-4 * OVERLAP :]}
        sync = 0 if at == 0 else next((i for i, x in enumerate(usable) if x in behind), None)
        if sync is None:  # no common boundary: match on from the last true one, as far as this chunk goes
            upto = seen[-1] if seen else at
            again = [true[-1] + x for x in ends(text[true[-1] : upto + OVERLAP])]
            again = again if upto + OVERLAP >= len(text) else again[:-margin]
            true += [x for x in again if x > true[-1]]
        elif at == 0:
            true += usable
        else:
            true += [x for x in usable[sync:] if x > true[-1]]
    if true[-1] < len(text):
        true += [true[-1] + x for x in ends(text[true[-1] :])]
    return true[1:]


def _result(doc_ids: pa.Array, encoded: list[tuple[str, bytes, int]], texts: bool) -> pa.RecordBatch:
    out = [doc_ids, pa.array([e[2] for e in encoded], pa.int64())]
    if texts:
        out += [pa.array([e[0] for e in encoded], pa.string()), pa.array([e[1] for e in encoded], pa.binary())]
    else:
        out += [pa.array([hashlib.sha256(e[i].encode() if i == 0 else e[i]).hexdigest() for e in encoded]) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(out, [f"c{i}" for i in range(4)])


def encoded(docs: DataFrame, path: str, pattern: str, digests: bool = True) -> DataFrame:
    """doc_id, n_tokens and ids_sha256, decoded_sha256; or, without ``digests``, ids (decimal, one blank between) and decoded."""
    spark = docs.sparkSession
    docs = columns(docs, doc_id="bigint", text="string")
    schema = "doc_id bigint, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids string, decoded binary")
    names = [x.split()[0] for x in schema.split(", ")]

    def whole(batches):
        known = pieces_of(path, pattern)
        for batch in batches:
            found = [known.encoded(known.split(t or "")) for t in batch.column("text").to_pylist()]
            yield _result(batch.column("doc_id"), found, not digests).rename_columns(names)
        released()

    def boundaries(batches):
        known = pieces_of(path, pattern)
        for batch in batches:
            for row, at, chunk in zip(*(batch.column(c).to_pylist() for c in ("row", "at", "chunk"))):
                seen = [at + x for x in known.ends(chunk)]
                yield pa.RecordBatch.from_pydict({"row": [row], "at": [at], "seen": [seen]}, pa.schema([("row", pa.string()), ("at", pa.int64()), ("seen", pa.list_(pa.int64()))]))

    def chunks(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                for at, chunk in cut(text):
                    yield pa.RecordBatch.from_pydict({"row": [row], "at": [at], "chunk": [chunk]}, pa.schema([("row", pa.string()), ("at", pa.int64()), ("chunk", pa.string())]))

    def joined(key, table: pa.Table, seen: pa.Table) -> pa.Table:
        known = pieces_of(path, pattern)
        text = table.column("text")[0].as_py()
        ends = stitched(text, list(zip(seen.column("at").to_pylist(), seen.column("seen").to_pylist())), known.ends)
        found = known.encoded([text[a:b] for a, b in zip([0, *ends], ends)])
        return pa.Table.from_batches([_result(pa.array([key[0].as_py()]), [found], not digests).rename_columns(["row", *names[1:]])])

    small = F.coalesce(F.length("text"), F.lit(0)) <= CHUNK
    long = docs.where(~small).withColumn("row", F.concat_ws(":", F.sha2("text", 256), F.length("text")))
    texts = long.select("row", "text").dropDuplicates(["row"])
    tasks = tasks_for(spark, 0, 1)
    seen = texts.mapInArrow(chunks, "row string, at bigint, chunk string").repartition(tasks, "row", "at").mapInArrow(boundaries, "row string, at bigint, seen array<bigint>")
    stitch = texts.groupBy("row").cogroup(seen.groupBy("row")).applyInArrow(joined, schema.replace("doc_id bigint", "row string"))
    return docs.where(small).mapInArrow(whole, schema).unionByName(long.select("doc_id", "row").join(stitch, "row").select(*names))
