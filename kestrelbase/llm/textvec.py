"""Vectorised text primitives over Arrow string buffers.

Arrow hands a Python worker one contiguous UTF-8 buffer for a batch of texts.
Everything here works on that buffer with numpy, so a word costs tens of
nanoseconds rather than a Python object.  Words are maximal runs of bytes
outside ``\\x20 \\x09-\\x0D``; as those are all ASCII this equals the
code-point definition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes of text that one numpy pass sees; a longer single text is one pass of its own.
PASS_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII letters and digits, and every byte of a non-ASCII code point.
PLAIN = np.ones(256, bool)
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bits of the first k bytes of a block of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


@lru_cache(maxsize=1)
def lean() -> ctypes.CDLL | None:
    """Let this process give the memory of large arrays and batches back at once, so that reused workers don't grow."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-8, 1)  # M_ARENA_MAX
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it only saves memory
        return None
    pa.set_memory_pool(pa.system_memory_pool())
    return libc


def passes(column: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows of at most ``limit`` bytes; a null is an empty text."""
    libc = lean()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if column.null_count and np.diff(offs)[column.is_null().to_numpy(zero_copy_only=False)].any():
        # a null that hides bytes; most have none, and need no copy of the column
        yield from passes(column.fill_null(""), limit)
        return
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to
    if libc is not None:
        libc.malloc_trim(0)


def spans_of(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in ``inside``; a run ends where a text ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    first = offs[:-1][np.diff(offs) > 0]
    begins[first] = inside[first]
    last = offs[1:][np.diff(offs) > 0] - 1
    stops[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they lie.

    Blocks of eight bytes are chained through ``mix``, so spans of one length of up to eight bytes never
    share a hash, and no texts are known that do; spans over LONG_SPAN go through xxh3.
    """
    left = ends - starts
    h = mix(left.astype(np.uint64) * U(0xD6E8FEB86659FD93) + U(0x8CB92BA72F3D8DD7))
    if not len(h):
        return h
    if lower:
        buf = LOWER[buf]
    blocks = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(8, np.uint8)]), 8)
    long = np.flatnonzero(left > LONG_SPAN)
    rows = np.arange(len(h)) if not len(long) else np.flatnonzero(left <= LONG_SPAN)
    rows = rows[left[rows] > 0]
    at = starts[rows]
    left = left[rows]
    while len(rows):
        block = blocks[at].view(np.uint64).ravel()
        block &= _FIRST[np.minimum(left, 8)]
        h[rows] = mix((h[rows] ^ block) * U(0x9FB21C651E98DF25))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    if len(long):
        raw = memoryview(np.ascontiguousarray(buf))
        h[long] = mix(np.array([xxhash.xxh3_64_intdigest(raw[a:b], 97) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)], np.uint64))
    return h


def words(buf: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, first word of each text and the count of all) of the words of a pass."""
    starts, ends = spans_of(~SPACE[buf], offs)
    return starts, ends, span_hashes(buf, starts, ends, lower), np.searchsorted(starts, offs)


def owner(bounds: np.ndarray) -> np.ndarray:
    """The text of each word, from ``words``' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def chain(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n consecutive words inside one text, and the window bounds of each text."""
    counts = np.maximum(np.diff(bounds) - (n - 1), 0)
    out = np.zeros(len(bounds), np.int64)
    np.cumsum(counts, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], counts)
    h = hashes[at]
    for i in range(1, n):
        h = mix(h * U(0x9FB21C651E98DF25) + hashes[at + i])
    return h, out


def sort_within(values: np.ndarray, bounds: np.ndarray) -> None:
    """Sort each text's slice in place."""
    b = bounds.tolist()
    for i in range(len(b) - 1):
        if b[i + 1] - b[i] > 1:
            values[b[i] : b[i + 1]].sort()


def first_of_runs(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of values sorted within each text: True at the first of equal ones."""
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    return keep


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over each text's slice."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
