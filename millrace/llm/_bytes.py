"""Vectorised UTF-8 helpers shared by the operators.

Texts stay in Arrow buffers: a batch of documents is one byte array plus
offsets, so words, hashes and spans come from numpy passes and no Python string
is made for a word.  A null text is an empty text.  Memory is a constant times
``CHUNK`` (or the longest single document, if that is larger).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 3 << 20
CACHED_POWERS = 4 << 20

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}

#: Words of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in text whose A-Z were lowered.
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
#: Maps A-Z to a-z, other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the int64 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK, rows: int = 65_536) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and ``rows`` rows, or one row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi


def text_chunks(column, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of one chunk after the other."""
    data, offs = string_buffers(column)
    for lo, hi in chunks(offs, limit):
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
    release()


def release() -> None:
    """Gives freed memory back, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def spans(is_word: np.ndarray, offs: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs, none across rows, and each row's count.

    ``cuts``: positions where a run is cut as well.
    """
    if not len(is_word):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    filled = offs[1:] > offs[:-1]
    edge = np.empty(len(is_word), bool)
    edge[0] = True
    np.not_equal(is_word[1:], is_word[:-1], out=edge[1:])
    edge[offs[:-1][filled]] = True
    if cuts is not None:
        edge[cuts] = True
    cuts = np.flatnonzero(edge)
    ends = np.append(cuts[1:], len(is_word))
    keep = is_word[cuts]
    starts, ends = cuts[keep], ends[keep]
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inverse" if inverse else "power"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), _R_INV if inverse else _R, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if len(have) <= CACHED_POWERS:
            _POWERS[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Hasher:
    """64-bit hashes of any spans of one byte array, from one prefix sum.

    A span's hash is a polynomial in random odd byte values over 2^64, shifted
    to the span's start, finished with its length.
    """

    def __init__(self, data: np.ndarray, lower: bool = False):
        value = _BYTE_VALUE[LOWER] if lower else _BYTE_VALUE
        self.sums = np.zeros(len(data) + 1, np.uint64)
        at = value[data]
        at *= powers(len(data))
        np.cumsum(at, out=self.sums[1:])
        self.back = powers(len(data) + 1, inverse=True)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= self.back[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        return mix(h)


_IS_LETTER: list[np.ndarray] = []


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a letter: a code point of the Unicode categories L*."""
    out = ((data | 32) >= 97) & ((data | 32) <= 122)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        if not _IS_LETTER:
            _IS_LETTER.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
        first = data[lead].astype(np.int32)
        more = 1 + (first >= 0xE0) + (first >= 0xF0)  # bytes that follow
        code = first & (0x3F >> more)
        padded = np.append(data, np.zeros(3, np.uint8))
        for k in (1, 2, 3):
            code = np.where(more >= k, (code << 6) | (padded[lead + k] & 0x3F), code)
        out[lead] = _IS_LETTER[0][code]
    return out


def hash_bytes(text: bytes) -> int:
    """The Hasher's value of one whole text."""
    data = np.frombuffer(text, np.uint8)
    return int(Hasher(data)(np.array([0]), np.array([len(data)]))[0])


def row_of(counts: np.ndarray) -> np.ndarray:
    """The row of every item, from the items of each row."""
    return np.repeat(np.arange(len(counts)), counts)


def union_length(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions some span covers."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1) if len(starts) < 64 else change.__iadd__(np.bincount(starts, minlength=n + 1).astype(np.int32))
    change -= np.bincount(ends, minlength=n + 1).astype(np.int32)
    return np.cumsum(change[:-1]) > 0
