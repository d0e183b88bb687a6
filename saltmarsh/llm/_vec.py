"""Vectorised helpers on Arrow string columns: byte buffers, word and rolling hashes, hash tables of n-grams."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into numpy arrays at once. A longer text is handled alone.
CHUNK = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SYM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def tidy() -> None:
    """Give back to the machine what a task's arrays took: workers are used again by the stages after, for other work."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def tidied(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``each`` over a partition's batches, tidied up after when they are over."""

    @functools.wraps(each)
    def run(batches: Iterator) -> Iterator:
        yield from each(batches)
        tidy()

    return run


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts together have about ``limit`` bytes; every row is in one of them."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the rows' offsets in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _C1
    x ^= x >> np.uint64(33)
    x *= _C2
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
        if size > 8 * CHUNK:  # one very long text; its tables aren't kept
            found = _powers[0][:n], _powers[1][:n]
            _powers[0], _powers[1] = _powers[0][:1].copy(), _powers[1][:1].copy()
            return found
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """64-bit hashes of any byte ranges of a buffer, from prefix sums of a random symbol table times powers."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_SYM[data] * up[:-1], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, ``[^\\x20\\x09-\\x0D]+`` if no other separating bytes are given, and the rows' offsets among them."""
    n = len(data)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~separators[data]
    first = word[1:-1] & ~word[:-2]
    last = word[1:-1] & ~word[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = word[inner + 1]
    last[inner - 1] = word[inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of a column, and the rows' offsets among them."""
    data, offsets = buffers(column)
    data = lowered(data)
    starts, ends, at = word_spans(data, offsets)
    return Rolling(data).ranges(starts, ends), at


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unique_counts(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts summed."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


class Tally:
    """Counts of keys over a task, merged when they have doubled, handed out in parts when they are many."""

    def __init__(self, most: int = 2_000_000):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting, self.most = 0, most

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.parts.append(unique_counts(keys, counts))
        self.waiting += len(self.parts[-1][0])
        if self.waiting > max(500_000, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        if self.parts:
            self.keys, self.counts = unique_counts(np.concatenate([self.keys, *(k for k, _ in self.parts)]), np.concatenate([self.counts, *(c for _, c in self.parts)]))
        self.parts, self.waiting = [], 0

    def take(self, least: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
        """What has been counted, if there are more than ``least`` keys; they are then forgotten."""
        self.merge()
        if len(self.keys) <= least:
            return None
        found = self.keys, self.counts
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return found


class Slots:
    """Open-addressing table from uint64 keys to their row; built and probed a whole array at a time."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.slot = np.full(1 << self.bits, len(keys), np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self.home(keys.astype(np.uint64))
        while len(left):
            free = self.slot[at] == len(keys)
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' rows; -1 where there is none."""
        none = len(self.keys) - 1
        at = self.home(keys)
        row = self.slot[at]
        todo = np.flatnonzero((row != none) & (self.keys[row] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            row[todo] = now = self.slot[at[todo]]
            todo = todo[(now != none) & (self.keys[now] != keys[todo])]
        row[row == none] = -1
        return row


def grams(data: np.ndarray, offsets: np.ndarray, width: int, pad: int) -> np.ndarray:
    """For each byte the last ``width`` (8 at most) bytes up to it as one number; before a row's start stands ``pad``."""
    n, rows = len(data), len(offsets) - 1
    room = np.full(n + 7 * rows, pad, np.uint8)
    shift = np.repeat(np.arange(7, 7 * rows + 7, 7), np.diff(offsets))
    at = np.arange(n) + shift
    room[at] = data
    whole = np.ndarray((max(0, len(room) - 7),), ">u8", room, strides=(1,)).astype(np.uint64) if len(room) >= 8 else np.zeros(0, np.uint64)
    return whole[at - 7] & np.uint64((1 << (8 * width)) - 1)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows' parts of ``values`` along the first axis; 0 for an empty part."""
    sums = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        sums[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=np.float64)
    return sums
