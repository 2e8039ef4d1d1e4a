"""Words of whole Arrow batches at once: byte classes give word bounds, octets of bytes word hashes, prefix sums window hashes.

Every alphabet used here puts all bytes from 0x80 on one side, so classes of bytes are classes of code points.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker process keeps between tasks: the last object only, so that memos of several operators don't add up."""
    if key not in _kept:
        _kept.clear()
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Gives memory that is free in this process back to the machine: the next operator's worker may be this one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)


def _class(separators: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: [^\x20\x09-\x0D]+
SPACED = _class([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after A-Z are lowered)
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Lowers A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd, 3 mod 4: then 1 - base has one factor two only, and swaps of neighbours change the sum.
_WORD_BASE = 0xD6E8FEB86659FD93 | 3
_STEP = 1 << 12


class _Powers:
    """base ** n mod 2**64 for arrays of n, from two small tables."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.low = self._run(base, _STEP)
        self.high = self._run(pow(base, _STEP, 2**64), _STEP)

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        x = 1
        for i in range(n):
            out[i] = x
            x = x * base % 2**64
        return out

    def upto(self, n: int) -> np.ndarray:
        """base ** 0 .. base ** (n - 1)."""
        while len(self.high) * _STEP < n:
            top = pow(self.base, _STEP * len(self.high), 2**64)
            self.high = np.concatenate([self.high, self.high * U(top)])
        return (self.high[: -(-n // _STEP), None] * self.low[None, :]).reshape(-1)[:n]


_word_up, _word_down = _Powers(_WORD_BASE), _Powers(pow(_WORD_BASE, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(32))


@dataclass
class Words:
    """Words of a batch: bounds in `data`, and for each document the index of its first word (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


#: The first n bytes of a little-endian octet.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer spans are hashed one by one.
_LONG = 64


def octets(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a little-endian integer; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(_LONG + 8, np.uint8)])
    return np.ndarray((len(data) + _LONG + 1,), "<u8", padded, 0, (1,))


#: For each octet of spans in turn: which of them reach it (None is all) and their octets, zeros beyond a span's end.
Octets = list[tuple[np.ndarray | None, np.ndarray]]


def span_octets(view: np.ndarray, starts: np.ndarray, size: np.ndarray, most: int) -> Octets:
    """The first `most` octets of spans, from octets()."""
    out: Octets = [(None, view[starts] & _FIRST[np.minimum(size, 8)])]
    more = np.flatnonzero(size > 8)
    for k in range(1, most):
        if not len(more):
            break
        left = size[more] - 8 * k
        out.append((more, view[starts[more] + 8 * k] & _FIRST[np.minimum(left, 8)]))
        more = more[left > 8]
    return out


def hash_octets(size: np.ndarray, spans: Octets) -> np.ndarray:
    """A 64-bit hash of each span; every step is one-to-one in both its inputs."""
    out = mix((size.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15) ^ spans[0][1])
    for at, octet in spans[1:]:
        out[at] = mix((out[at] + U(0xA0761D6478BD642F)) ^ octet)
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes. It only tells what may be equal: who needs to know compares bytes or digests."""
    size = ends - starts
    out = hash_octets(size, span_octets(octets(data), starts, size, _LONG // 8))
    long = np.flatnonzero(size > _LONG)
    if len(long):
        raw = memoryview(data)
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    return out


_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U(bits)) | (x >> U(64 - bits))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each span: spans of under 32 bytes step by step together, longer ones by the library."""
    size = ends - starts
    view = octets(data)
    out = U(seed) + _P5 + size.astype(np.uint64)
    at = starts.copy()
    left = size.copy()
    short = size < 32
    more = np.flatnonzero(short & (left >= 8))
    while len(more):
        out[more] = _turned(out[more] ^ (_turned(view[at[more]] * _P2, 31) * _P1), 27) * _P1 + _P4
        at[more] += 8
        left[more] -= 8
        more = more[left[more] >= 8]
    more = np.flatnonzero(short & (left >= 4))
    out[more] = _turned(out[more] ^ ((view[at[more]] & _FIRST[4]) * _P1), 23) * _P2 + _P3
    at[more] += 4
    left[more] -= 4
    more = np.flatnonzero(short & (left > 0))
    while len(more):
        out[more] = _turned(out[more] ^ ((view[at[more]] & _FIRST[1]) * _P5), 11) * _P1
        at[more] += 1
        left[more] -= 1
        more = more[left[more] > 0]
    out ^= out >> U(33)
    out *= _P2
    out ^= out >> U(29)
    out *= _P3
    out ^= out >> U(32)
    long = np.flatnonzero(~short)
    if len(long):
        raw = memoryview(data)
        out[long] = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    return out


class Numbers:
    """An open-addressing table from 64-bit hashes to 0, 1, 2, ... in the order they came; it grows before it is three quarters full."""

    def __init__(self, bits: int) -> None:
        self.n = 0
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.low = np.uint64((1 << bits) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for one that isn't there."""
        slot = (hashes & self.low).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == hashes, self.values[slot], np.int32(-1))
        rest = np.flatnonzero((key != hashes) & (key != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & int(self.low)
            key = self.keys[slot[rest]]
            same = key == hashes[rest]
            out[rest[same]] = self.values[slot[rest[same]]]
            rest = rest[~same & (key != 0)]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Distinct hashes that aren't there yet and aren't zero."""
        bits = int(self.low).bit_length()
        if 4 * (self.n + len(hashes)) > 3 << bits:
            while 4 * (self.n + len(hashes)) > 3 << bits:
                bits += 1
            used = np.flatnonzero(self.keys)
            keys, values = self.keys[used], self.values[used]
            self._empty(bits)
            self._place(keys, values)
        self._place(hashes, np.arange(self.n, self.n + len(hashes), dtype=np.int32))
        self.n += len(hashes)

    def _place(self, hashes: np.ndarray, values: np.ndarray) -> None:
        slot = (hashes & self.low).astype(np.int64)
        rest = np.arange(len(hashes))
        while len(rest):
            at = slot[rest]
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[rest[free]]
            placed = free & (self.keys[at] == hashes[rest])
            self.values[at[placed]] = values[rest[placed]]
            rest = rest[~placed]
            slot[rest] = (slot[rest] + 1) & int(self.low)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray) -> Words:
    inside = alphabet[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    if len(before):
        before[0] = False
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(after):
        after[-1] = False
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` neighbouring word hashes, across documents too: the caller leaves those out."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _word_up.upto(len(words)), dtype=np.uint64, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _word_down.upto(len(words) - size + 1))


def spaced(words: Words, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch, each followed by one space, and where each begins (one more at the end)."""
    at = np.concatenate([[0], np.cumsum(words.ends - words.starts + 1)])
    body = np.full(int(at[-1]), 32, np.uint8)
    letters = np.ones(int(at[-1]), bool)
    letters[at[1:] - 1] = False
    body[letters] = words.data[alphabet[words.data]]
    return body, at


def whole_windows(first: np.ndarray, size: int) -> np.ndarray:
    """For each window start of window_hashes: does the window lie in one document?"""
    total = int(first[-1])
    if total < size:
        return np.zeros(0, bool)
    change = np.zeros(total + 1, np.int32)
    counts = np.diff(first)
    long = counts >= size
    np.add.at(change, first[:-1][long], 1)
    np.add.at(change, first[1:][long] - size + 1, -1)
    return np.cumsum(change)[: total - size + 1] > 0


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, so that arrays over bytes stay small; a longer text is one batch."""
    for batch in batches:
        offsets = utf8(batch.column(column))[1]
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
