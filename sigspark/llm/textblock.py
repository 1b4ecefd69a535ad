"""Words of an Arrow string column as numpy arrays, for tasks that look at every byte of every text.

A column's UTF-8 buffer is taken as it is (no Python string per row) and cut into chunks of whole rows of about a
megabyte, so a task's memory follows the chunk and not the partition; only a row longer than that is a larger chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

#: White space of the word rules: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Bytes of a word of letters and digits once A-Z are lowered: 0-9, a-z, and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z lowered, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; salt picks another one."""
    x = x + _U((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64), 7)
_LOWER_BYTE = _BYTE[LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers


@dataclass
class Chunk:
    """Rows first..stop of a column: their bytes end to end, the byte offset of each row (and the end), and which are null."""

    first: int
    stop: int
    data: np.ndarray
    offsets: np.ndarray
    null: np.ndarray

    def __len__(self) -> int:
        return self.stop - self.first


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    null = column.is_null().to_numpy(zero_copy_only=False)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(off, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, n)
        yield Chunk(row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], null[row:stop])
        row = stop


@dataclass
class Words:
    """start and end (exclusive) byte of each word; first[r]..first[r+1] are the words of row r."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words(chunk: Chunk, member: np.ndarray) -> Words:
    """Maximal runs, within a row, of bytes for which member is true."""
    w = member[chunk.data]
    n = len(w)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(chunk) + 1, np.int64))
    new = np.zeros(n + 1, bool)
    new[chunk.offsets] = True
    begin, finish = w.copy(), w.copy()
    begin[1:] &= ~w[:-1] | new[1:n]
    finish[:-1] &= ~w[1:] | new[1:n]
    start = np.flatnonzero(begin)
    return Words(start, np.flatnonzero(finish) + 1, np.searchsorted(start, chunk.offsets))


#: Spans beyond so many bytes are hashed whole: sums modulo 2^64 are equal for some unlike spans from 1,024 bytes on, whatever the base.
LONG = 256


class SpanHashes:
    """64-bit hashes of byte spans of a chunk with A-Z lowered; equal spans have equal hashes wherever they stand.

    A span of up to LONG bytes is a difference of two running polynomial sums, a longer one goes through BLAKE2."""

    def __init__(self, chunk: Chunk):
        n = len(chunk.data)
        self.data, self.sums = chunk.data, np.zeros(n + 1, np.uint64)
        np.cumsum(_LOWER_BYTE[chunk.data] * powers(n + 1)[0][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = mix((self.sums[end] - self.sums[start]) * powers(len(self.sums))[1][start])
        for i in np.flatnonzero(end - start > LONG).tolist():
            span = LOWER[self.data[start[i] : end[i]]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "little")
        return out


def text_hash(text: str) -> int:
    """The span hash of one whole text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    chunk = Chunk(0, 1, raw, np.array([0, len(raw)]), np.zeros(1, bool))
    return int(SpanHashes(chunk).of(np.array([0]), np.array([len(raw)]))[0])


_STEP = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words of each row, repeats included, and each row's first one. A row of fewer
    words, but not none, has one: its whole sequence."""
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    begin = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    total = len(hashes)
    out = np.full(len(at), size, np.uint64)
    short = np.flatnonzero((count > 0) & (count < size))
    for k in range(size):
        out = out * _U(_STEP[0]) + hashes[np.minimum(at + k, total - 1)] if total else out
    for r in short:
        v = int(count[r]) + (1 << 20)
        for h in hashes[first[r] : first[r + 1]]:
            v = (v * _STEP[0] + int(h)) % (1 << 64)
        out[begin[r]] = v
    return mix(out, 3), begin
