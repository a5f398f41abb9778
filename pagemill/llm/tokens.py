"""Vectorised word splitting and hashing over Arrow string columns.

The Arrow-style operators of this subpackage never loop over words in Python: a batch is cut into slices of
bounded bytes and every slice is handled as flat numpy arrays (bytes, word bounds, word codes, row bounds).  Within a
slice words are known exactly, by dictionary codes; across slices and machines by 128 bits, which are exact for words of up to 15 bytes and XXH3's for longer ones.
A null text has no words.  Slices hold whole texts; a text longer than the slice bound makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def coded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Exact codes, from 0 in order of occurrence, of disjoint ascending byte spans; and the distinct spans."""
    marks = np.zeros(len(data) + 1, np.int8)
    marks[start] = 1
    marks[end] -= 1
    inside = np.cumsum(marks[:-1], dtype=np.int8).view(bool)
    offs = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offs[1:])
    spans = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data[inside]))]).dictionary_encode()
    return spans.indices.to_numpy(), spans.dictionary


_KEYS = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)) for k in range(4)]


def names_of(spans: pa.Array, upto: int | None = None) -> np.ndarray:
    """128 bits of each span, or of its first bytes (up to 15), as two columns.

    Spans of up to 15 bytes are scrambled without loss, so their names are exact; longer ones have XXH3's 128 bits.
    """
    n = len(spans)
    offs = np.frombuffer(spans.buffers()[1], np.int64)[spans.offset : spans.offset + n + 1]
    data = np.append(np.frombuffer(spans.buffers()[2] or b"", np.uint8), np.zeros(16, np.uint8))
    size = np.diff(offs) if upto is None else np.minimum(np.diff(offs), upto)
    raw = np.lib.stride_tricks.sliding_window_view(data, 16)[offs[:-1]]
    raw[np.arange(16) >= size[:, None]] = 0
    raw[:, 15] = np.minimum(size, 255)
    out = raw.view(np.uint64).reshape(n, 2)
    a, b = out[:, 0], out[:, 1]
    for k in range(0, 4, 2):
        b ^= mix(a + _KEYS[k])
        a ^= mix(b + _KEYS[k + 1])
    long = np.flatnonzero(size > 15)
    if len(long):
        out[long] = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, spans.take(pa.array(long)).to_pylist())), np.uint64).reshape(-1, 2)
    return out


def grouped(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the distinct rows of non-negative integer columns: equal rows, and only these, have equal numbers."""
    out = columns[0].astype(np.int64)
    for c in columns[1:]:
        wide = int(c.max()) + 1 if len(c) else 1
        if len(out) and (int(out.max()) + 1) * wide >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1].ravel()
        out = out * wide + c
    return out


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive items (fewer than n: none)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= _P
        out += hashes[k : k + m]
    return mix(out)


@dataclass
class Slice:
    """Rows [row0, row1) of a batch: their bytes, and offs[i]:offs[i+1] for each row."""

    row0: int
    row1: int
    data: np.ndarray
    offs: np.ndarray

    def split(self, is_break: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal pieces of bytes not in the break table: starts, ends, and each row's first piece (rows + 1)."""
        inside = ~is_break[self.data]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[self.offs[:-1][self.offs[:-1] < len(inside)]] = False
        start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        ends = self.offs[1:]
        after[ends[ends > 0] - 1] = False
        end = np.flatnonzero(inside & ~after) + 1
        return start, end, np.searchsorted(start, self.offs)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.split(_SPACE)

    @cached_property
    def codes(self) -> np.ndarray:
        """A number for each word, exact within the slice."""
        return self._coded[0]

    @cached_property
    def _coded(self) -> tuple[np.ndarray, pa.Array]:
        start, end, _ = self.words
        return coded(self.data, start, end)

    @cached_property
    def names(self) -> np.ndarray:
        """128 bits of each word."""
        codes, spans = self._coded
        return names_of(spans)[codes]

    @property
    def hashes(self) -> np.ndarray:
        """The first 64 of them."""
        return self.names[:, 0]

    @cached_property
    def word_rows(self) -> np.ndarray:
        """The row, counted from row0, of each word."""
        return np.repeat(np.arange(self.row1 - self.row0), np.diff(self.words[2]))

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1, from 0) of a string or binary column; null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    data, offs = utf8(column)
    n, row = len(offs) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield Slice(row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row])
        row = end
