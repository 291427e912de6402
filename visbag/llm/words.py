"""Vectorised words over UTF-8 bytes.

A batch of texts is one byte array with document offsets (the layout Arrow already has). Words, their
64-bit hashes and the hashes of runs of words come from prefix sums, so no step works word by word.

The hash of a word is a polynomial over its bytes, each byte replaced by a fixed random 64-bit value,
modulo 2**64, then mixed; the hash of a run of words is a second polynomial over word hashes, mixed again.
Equal words always have equal hashes; unequal words collide with probability about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _RUN, KEPT_POWERS = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 1 << 21


def _inverse(odd: int) -> int:
    return pow(odd, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, _powers(base, 1 << 12), _powers(_inverse(base), 1 << 12)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > KEPT_POWERS:  # one very long text: not kept for the next
            return _powers(self.base, n), _powers(_inverse(self.base), n)
        if n > len(self.up):
            n = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(self.base, n), _powers(_inverse(self.base), n)
        return self.up, self.down


_BYTES, _RUNS = _Powers(_BASE), _Powers(_RUN)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


class Alphabet:
    """Which bytes belong to words, and what they are read as (A-Z as a-z if ``lower``)."""

    def __init__(self, is_word: np.ndarray, lower: bool):
        self.is_word = is_word
        read = np.arange(256)
        if lower:
            read[65:91] += 32
        self.value = _BYTE[read]


_ANY = np.ones(256, bool)
_ANY[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
#: Words as maximal runs of bytes other than ASCII white space.
SPACED, SPACED_LOWER = Alphabet(_ANY, False), Alphabet(_ANY, True)
#: Words as maximal runs of digits, letters and bytes above 0x7F.
ALNUM_LOWER = Alphabet(_ALNUM, True)


class Words:
    """The words of some texts: ``start``/``end`` are byte positions, ``hash`` their hashes,
    ``first[d]`` .. ``first[d + 1]`` the words of text ``d``, ``data`` all bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet, hashes: bool = True):
        self.data, self.offsets, n = data, offsets, len(data)
        inside = alphabet.is_word[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        opens[cuts] |= inside[cuts]
        self.start = np.flatnonzero(opens)
        shuts = inside.copy()
        shuts[:-1] &= ~inside[1:]
        shuts[cuts - 1] |= inside[cuts - 1]
        self.end = np.flatnonzero(shuts) + 1
        self.first = np.searchsorted(self.start, offsets)
        if hashes:
            with np.errstate(over="ignore"):
                up, down = _BYTES.get(n + 1)
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(alphabet.value[data] * up[:n], out=total[1:])
                self.hash = mixed((total[self.end] - total[self.start]) * down[self.start])

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; positions whose run would pass the end are left out."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _RUNS.get(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], out=total[1:])
        return mixed((total[k:] - total[:-k]) * down[: n - k + 1] + np.uint64(k))


def text_slices(batch: pa.RecordBatch | pa.Table, column: str, max_bytes: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of consecutive rows, ``max_bytes`` together or one long row; nulls are empty."""
    text = batch.column(column)
    for chunk, base in _chunks(text):
        chunk = chunk.cast(pa.large_binary())
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2], np.uint8) if chunk.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(chunk):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
            yield base + at, base + to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def _chunks(column) -> Iterator[tuple[pa.Array, int]]:
    base = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if chunk.null_count:
            chunk = chunk.fill_null("" if pa.types.is_string(chunk.type) or pa.types.is_large_string(chunk.type) else b"")
        if len(chunk):
            yield chunk, base
        base += len(chunk)
