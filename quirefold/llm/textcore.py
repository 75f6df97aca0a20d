"""Array views of text batches: UTF-8 bytes, word spans and hashes of spans and windows.

Every function works on one Arrow batch inside a task; Spark decides what is in the batch. Hashes of windows are built by
doubling, each step a product and a shift of the two halves, so that all windows of a batch cost a few array passes. Two
seeds give independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry mask that is True for the bytes in the given inclusive ranges."""
    mask = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        mask[lo : hi + 1] = True
    return mask


#: Bytes of words that stand between white space (0x20, 0x09 to 0x0D).
SPACED = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes of terms: ASCII letters and digits, and every byte of a character beyond ASCII.
TERMS = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Texts:
    """Concatenated UTF-8 bytes; text i is data[offs[i]:offs[i + 1]]. A null text is empty."""

    data: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def pieces(self, limit: int) -> Iterator[tuple[int, Texts]]:
        """(first row, texts) of runs of rows with about `limit` bytes, one row at least."""
        lo, n = 0, len(self)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.offs, self.offs[lo] + limit, "right")) - 1)
            yield lo, Texts(self.data[self.offs[lo] : self.offs[hi]], self.offs[lo : hi + 1] - self.offs[lo])
            lo = hi


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[offs[0] : offs[-1]], offs - offs[0])


@dataclass
class Spans:
    """Spans of bytes in document order; doc[i] is the row of span i, first[d] the number of spans before row d."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def room(self) -> np.ndarray:
        """How many spans the row of each span has from that span on."""
        return self.first[self.doc + 1] - np.arange(len(self.start))


def spans_of(texts: Texts, member: np.ndarray) -> Spans:
    """Maximal runs of bytes in `member`; a run never crosses rows."""
    data, offs = texts.data, texts.offs
    if not len(data):
        return Spans(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(len(offs), np.int64))
    inside = member[data]
    prev = np.zeros(len(data), bool)
    prev[1:] = inside[:-1]
    edges = offs[(offs > 0) & (offs < len(data))]
    prev[edges] = False
    start = np.flatnonzero(inside & ~prev)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offs, "left")
    return Spans(start, end, np.repeat(np.arange(len(offs) - 1), np.diff(first)), first)


def _splitmix(seed: int, n: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(29))


def lanes(data: np.ndarray) -> np.ndarray:
    """For each byte the 8 bytes from it on, as a little-endian integer; zeros follow the last byte."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty(n, U64)
    for k in range(min(8, n)):
        size = len(range(k, n, 8))
        out[k::8] = padded[k : k + 8 * size].view(U64)
    return out


def join(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each pair (x, y): products and shifts in turn, so that no sum of terms decides it."""
    a, b, c = _CONSTANTS[seed]
    out = x * a
    out ^= out >> U64(29)
    other = y * b
    other ^= other >> U64(31)
    out += other
    out *= c
    out ^= out >> U64(32)
    return out


_CONSTANTS = [tuple(x | U64(1) for x in _splitmix(seed, 3)) for seed in range(4)]
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
LONG_SPAN = 64  # bytes beyond which a span is hashed by itself


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes of each span. `at` are the lanes of data, where the caller has them."""
    size = end - start
    out = mix(size.astype(U64) + _CONSTANTS[seed][0])
    at = lanes(data) if at is None else at
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    done = 0
    while len(live):
        rest = size[live] - done
        out[live] = join(out[live], at[start[live] + done] & _MASK[np.minimum(rest, 8)], seed)
        done += 8
        live = live[rest > 8]
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out


class Runs:
    """Hashes of runs of a sequence, by doubling: level k has the hash of each run of 2**k items.

    A run of another length is the pair of the two runs of the next smaller power of two that cover it. Items are 64-bit
    values; `unit` says how many places an item covers, as lanes cover 8 bytes each.
    """

    def __init__(self, items: np.ndarray, seed: int, unit: int = 1):
        self.seed, self.unit, self.levels = seed, unit, [mix(items ^ _CONSTANTS[seed][2])]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, step = self.levels[-1], self.unit << (len(self.levels) - 1)
            self.levels.append(join(last[:-step], last[step:], self.seed) if len(last) > step else last[:0])
        return self.levels[k]

    def _power(self, width: int) -> int:
        return (width // self.unit).bit_length() - 1

    def windows(self, width: int) -> np.ndarray:
        """All runs of `width` places, whether or not they cross rows. The last unit - 1 places hold zeros beyond the sequence."""
        k = self._power(width)
        level, rest = self._level(k), width - (self.unit << k)
        n = len(self.levels[0]) - width + 1
        return join(level[: max(n, 0)], level[rest : rest + max(n, 0)], self.seed) if n > 0 else level[:0]

    def spans(self, start: np.ndarray, end: np.ndarray, block: int, seed: int) -> np.ndarray:
        """The runs [start, end), each of `block` places or more, by the blocks that cover them. Block is a power of two of units.

        Results of two seeds share the hashes of blocks. Two runs that differ in several blocks must collide in all of them to be
        taken for equal.
        """
        level = self._level(self._power(block))
        out = mix((end - start).astype(U64) + _CONSTANTS[seed][0])
        at, live = start.copy(), np.arange(len(start))
        while len(live):
            out[live] = join(out[live], level[np.minimum(at[live], end[live] - block)], seed)
            at[live] += block
            live = live[at[live] < end[live]]
        return out


def equal_classes(data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A number for each span, equal if and only if the bytes are equal. Hashes (`keys`) say which to compare; if different
    spans ever share one, all are told apart by their bytes."""
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    twin = first[which]
    other = np.flatnonzero(twin != np.arange(len(keys)))
    a, b = other, twin[other]
    same = (end[a] - start[a]) == (end[b] - start[b])
    if same.all() and np.array_equal(gather(data, start[a], end[a]), gather(data, start[b], end[b])):
        return which
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[s:e].tobytes(), len(known)) for s, e in zip(start, end)], np.int64)


def run_cover(n: int, start: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """A mask of the n positions that some [start, start + width) covers."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + width, -1)
    return np.cumsum(depth[:-1]) > 0


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray, tail: int | None = None) -> np.ndarray:
    """The bytes of the spans one after the other, each followed by the byte `tail` if given."""
    size = end - start + (tail is not None)
    stop = np.cumsum(size)
    at = np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
    if tail is None:
        return data[at]
    out = data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8)
    out[stop - 1] = tail
    return out
