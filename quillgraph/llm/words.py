"""Word boundaries and word hashes of many texts at once, with numpy over Arrow's text buffers.

Texts are cut into slices of about SLICE_BYTES so that a task's memory follows the slice (or one
very long text), never the partition. Only A-Z is lower-cased. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

#: Bytes that belong to words, after lower-casing.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
LETTER_OR_DIGIT = np.zeros(256, dtype=bool)
LETTER_OR_DIGIT[48:58] = LETTER_OR_DIGIT[97:123] = LETTER_OR_DIGIT[128:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_KEPT = 1 << 21
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; those for one very long text are not kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, 2 * SLICE_BYTES)
    tables = []
    for base in (_BASE, _INVERSE):
        t = np.full(size, base, dtype=np.uint64)
        t[0] = 1
        tables.append(np.multiply.accumulate(t))
    if size <= _KEPT:
        _powers[:] = tables
    return tables[0], tables[1]


class Slice:
    """Some consecutive texts of a batch.

    lo, hi: their rows in the batch; data: their bytes; offsets: where each text begins in data.
    """

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo

    def lower(self) -> np.ndarray:
        return _LOWER[self.data]

    def words(self, alphabet: np.ndarray) -> "Words":
        return Words(self, alphabet)


class Words:
    """starts, ends: byte ranges of words; first: index of each text's first word (one more at the end)."""

    def __init__(self, part: Slice, alphabet: np.ndarray):
        self.part, self.data = part, part.lower()
        inside = np.zeros(len(self.data) + 1, dtype=bool)
        inside[:-1] = alphabet[self.data]
        cut = np.zeros(len(self.data) + 1, dtype=bool)
        cut[part.offsets] = True
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        self.starts = np.flatnonzero(inside & (cut | ~before))
        self.ends = np.flatnonzero(before & (cut | ~inside))
        self.first = np.searchsorted(self.starts, part.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """For each word, the text it is in, counted from the slice's first."""
        return np.repeat(np.arange(len(self.part)), self.counts())

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes, the same wherever the word stands."""
        power, inverse = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        values = self.data.astype(np.uint64)
        values += np.uint64(1)
        values *= power[: len(self.data)]
        np.cumsum(values, out=sums[1:])
        del values
        h = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def hash_words(words: list[str], alphabet: np.ndarray = NOT_SPACE) -> np.ndarray:
    """Hashes of given words, equal to those of Words.hashes()."""
    found = [w for part in slices(pa.array(words, pa.string())) for w in part.words(alphabet).hashes()]
    if len(found) != len(words):
        raise ValueError("each entry must be one word")
    return np.array(found, dtype=np.uint64)


def slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column of texts into slices. Every row is in exactly one."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        if chunk.null_count:
            chunk = chunk.fill_null("")
        chunk = chunk.cast(pa.large_string())
        n = len(chunk)
        if not n:
            continue
        _, places, data = chunk.buffers()
        offsets = np.frombuffer(places, dtype=np.int64, count=chunk.offset + n + 1)[chunk.offset :]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
            hi = min(n, max(hi, lo + 1))
            yield Slice(row + lo, row + hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi
        row += n


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by the position of the first; texts' borders are the caller's care."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    v = hashes[:n].copy()
    for j in range(1, k):
        v *= np.uint64(0xD6E8FEB86659FD93)
        v += hashes[j : n + j]
    return mix(v)
