"""Vectorised text scanning: words, hashes of words and of word runs, over Arrow string batches.

Texts stay UTF-8 bytes; all work per byte or word is done by numpy on whole batches.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library than glibc
    _TRIM = None

U64 = np.uint64
#: Bytes of text that one numpy pass handles (a longer text is a pass of its own).
PASS_BYTES = 4 << 20

_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xFF51AFD7ED558CCD)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def class_table(excluded: str) -> np.ndarray:
    """256 booleans: True for bytes that belong to a word, given the excluded ASCII characters."""
    table = np.ones(256, dtype=bool)
    table[[ord(c) for c in excluded]] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACE_WORDS = class_table(" \t\n\x0b\x0c\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over lower-cased text
ALNUM_WORDS = class_table("".join(chr(i) for i in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a batch of texts. ``buf`` has eight spare bytes; ``first[d]:first[d+1]`` are text d's words."""

    buf: np.ndarray
    inside: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words, each with one space behind it: the buffer, and starts and ends of words in it."""
        lens = self.ends - self.starts
        start = np.zeros(len(lens) + 1, dtype=np.int64)
        np.cumsum(lens + 1, out=start[1:])
        out = np.full(start[-1], 32, dtype=np.uint8)
        place = np.ones(start[-1], dtype=bool)
        end = start[:-1] + lens
        place[end] = False
        out[place] = self.buf[: len(self.inside)][self.inside]
        return out, start[:-1], end


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its texts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def scan(column: pa.Array, table: np.ndarray = SPACE_WORDS, lower: bool = False) -> Words:
    """Find the words of every text of ``column``; ``lower`` turns A-Z into a-z first."""
    raw, offsets = string_bytes(column)
    buf = np.zeros(len(raw) + 8, dtype=np.uint8)
    buf[: len(raw)] = LOWER[raw] if lower else raw
    inside = table[buf[: len(raw)]]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = inside[edges]
    finish[edges[1:] - 1] = inside[edges[1:] - 1]
    starts = np.flatnonzero(begin)
    return Words(buf, inside, starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets))


def release() -> None:
    """Give freed memory back to the system: Python workers of one executor stay alive side by side."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of ``mapInArrow`` for tasks without ``passes``: drops what was ``kept`` and, when it ends, gives freed memory back."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _KEPT.clear()
        yield from run(batches)
        release()

    return call


#: What tasks left in this Python worker for later tasks of the same operator.
_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gave an earlier task of this Python worker for ``key``, or gives now.

    Workers serve the tasks of all operators: it goes when ``passes`` reads texts for another one.
    """
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def passes(batch: pa.RecordBatch, column: str, limit: int = PASS_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes of text each (or one row); unless ``keep``, what was ``kept`` goes."""
    if not keep:
        _KEPT.clear()
    _, offsets = string_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered 64-bit mix of two hash arrays."""
    h = a * _M1 + (b ^ (b >> U64(29))) * _M2
    h ^= h >> U64(32)
    h *= _M3
    h ^= h >> U64(29)
    return h


def first_bytes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The first eight bytes (fewer: all) behind each start, as a number; ``buf`` has eight spare bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    eight = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf.data, strides=(1,))
    return eight[starts] & _MASKS[np.minimum(lens, 8)]


def word_hashes(words: Words) -> np.ndarray:
    """64-bit hash of every word, eight bytes a step."""
    lens = words.ends - words.starts
    if not len(lens):
        return np.zeros(0, dtype=np.uint64)
    eight = np.ndarray(shape=(len(words.buf) - 7,), dtype="<u8", buffer=words.buf.data, strides=(1,))
    h = combine(lens.astype(np.uint64), first_bytes(words.buf, words.starts, lens))
    rest, k = np.flatnonzero(lens > 8), 8
    while len(rest):
        h[rest] = combine(h[rest], eight[words.starts[rest] + k] & _MASKS[np.minimum(lens[rest] - k, 8)])
        k += 8
        rest = rest[lens[rest] > k]
    return h


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive entries (len - k + 1 of them), by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done, power, size = None, 0, hashes, 1
    while True:
        if k & size:
            out = power[:n] if out is None else combine(out[:n], power[done : done + n])
            done += size
        if done == k:
            return out[:n]
        power = combine(power[:-size], power[size:])
        size *= 2


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    size = 1
    while size * 2 <= w:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (w - size)], values[w - size :]) if w > size else values

