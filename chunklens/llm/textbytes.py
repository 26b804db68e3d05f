"""Words of whole texts, vectorised over the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text is handled alone.
BLOCK = 2 << 20

_U = np.uint64
_LENGTH, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
#: The low bytes that a word of so many bytes has in a block of eight.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
#: Words of more bytes are hashed one by one.
_LONG = 512

#: Word bytes: all but white space (space, \t to \r).
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes: digits, ASCII letters (upper case counts as lower) and all bytes of other characters.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes in all."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row limits: words of row r are at [limits[r], limits[r + 1])."""
    mask = is_word[data]
    before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
    if len(mask):
        before[1:], after[:-1] = mask[:-1], mask[1:]
        edge = offsets[1:-1]
        before[edge[edge < len(mask)]] = False
        after[edge[edge > 0] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, that depends on its (lower-cased) bytes alone. Eight bytes at a time are added and
    mixed, so that words of up to eight bytes with equal lengths never have the same hash, and long words no structure
    that makes them collide."""
    if not len(starts):
        return np.zeros(0, _U)
    own = np.zeros(len(data) + 8, np.uint8)
    own[: len(data)] = LOWER[data] if lower else data
    eight = np.ndarray(len(data) + 1, "<u8", own, strides=(1,))
    length = ends - starts
    out = mix((eight[starts] & _LOW[np.minimum(length, 8)]) + length.astype(_U) * _LENGTH)
    rest = np.flatnonzero((length > 8) & (length <= _LONG))
    at = 8
    while len(rest):
        left = length[rest] - at
        out[rest] = mix(out[rest] * _STEP + (eight[starts[rest] + at] & _LOW[np.minimum(left, 8)]))
        at += 8
        rest = rest[left > 8]
    for i in np.flatnonzero(length > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(own[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def sequence_hashes(words: np.ndarray, limits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each k-word window; a row of 1 to k - 1 words gives its whole sequence as one."""
    n, count = len(words), np.diff(limits)
    row = np.repeat(np.arange(len(count)), count)
    if n >= k:
        acc = np.full(n - k + 1, _U(k), _U)
        for j in range(k):
            acc = acc * _U(0xD6E8FEB86659FD93) + words[j : n - k + 1 + j]
        whole = row[: n - k + 1] == row[k - 1 :]
        acc, at = mix(acc[whole]), row[: n - k + 1][whole]
    else:
        acc, at = np.zeros(0, _U), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = count[short].astype(_U)
        for j in range(k - 1):
            has = count[short] > j
            own[has] = own[has] * _U(0xD6E8FEB86659FD93) + words[limits[short[has]] + j]
        acc, at = np.concatenate([acc, mix(own)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        acc, at = acc[order], at[order]
    return acc, at
