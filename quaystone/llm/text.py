"""Shared text helpers: Arrow buffers to words and 64-bit hashes, in numpy.

A batch of texts is one byte buffer plus offsets, so splitting and hashing run
over the whole buffer at once.  Word identity is a 64-bit hash of the
lower-cased bytes; callers that must be exact compare the bytes afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; working arrays take about forty times this.
SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(inside) -> np.ndarray:
    """A table of 256 booleans: which byte values belong to a word."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = byte_class(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90)
#: Words ``[^\x20\x09-\x0D]+``.
NONSPACE = byte_class(lambda b: b != 32 and not 9 <= b <= 13)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all input bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER]
_STEP = 0xD6E8FEB86659FD93
_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            grown = np.full(1 << max(10, int(n - 1).bit_length()), _STEP, dtype=np.uint64)
            grown[0] = 1
            _POWERS = np.multiply.accumulate(grown)
    return _POWERS[:n]


def slices(column, limit: int = SLICE_BYTES):
    """Yield (first row, data, offsets) of a string column, about ``limit`` bytes at a time.

    A null text counts as empty.  A single text over the limit is a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def portions(column: pa.Array, rows: int = 1000, limit: int = SLICE_BYTES):
    """Cut an array of texts into arrays of at most ``rows`` rows and about ``limit`` bytes; one longer text is alone."""
    sizes = np.cumsum(pc.coalesce(pc.binary_length(column), pa.scalar(0, pa.int32())).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        before = sizes[first - 1] if first else 0
        last = min(max(first + 1, int(np.searchsorted(sizes, before + limit, side="right"))), first + rows, len(column))
        yield column.slice(first, last - first)
        first = last


class Words:
    """The words of a slice: byte starts and ends, and ``bounds``: each document's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.data, self.offsets = data, offsets
        here = inside[data] if len(data) else np.zeros(0, bool)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], here[:-1])) if len(here) else here
        after = np.concatenate((here[1:], [False])) if len(here) else here
        self.here = here
        self.starts = np.flatnonzero(here & (~before | edge[:-1]))
        self.ends = np.flatnonzero(here & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each lower-cased word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        within = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
        with np.errstate(over="ignore"):
            value = _BYTE[self.data[self.here]] * powers(int(lengths.max()))[within]
            return mix(np.add.reduceat(value, firsts) + lengths.astype(np.uint64))

    def docs(self) -> np.ndarray:
        """The row of each word, counted from the slice's first."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes; entry i covers i .. i+n-1 and may cross documents."""
    if n == 1:
        return h
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(_STEP) + h[k : k + size]
    return mix(out)


def word_list(text: str | None, inside: np.ndarray) -> list[bytes]:
    """The lower-cased words of one text as bytes; none for null."""
    raw = (text or "").encode()
    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), inside)
    low = raw.lower()
    return [low[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist())]


def seed_of(text: str) -> int:
    """A small stable number from a name, for seeding."""
    return int.from_bytes(text.encode()[:8].ljust(8, b"\0"), "little") % (2**31)
