"""Vectorised word hashing over Arrow string buffers, for use inside tasks.

Works on whole batches of texts at once, in pieces of about ``PIECE`` bytes, so that memory does
not grow with the length of a text.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Is the byte part of a word; its 64-bit code, the same for A-Z and a-z."""
    b = np.arange(256)
    is_word = ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    folded = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint64)
    return is_word, mix((folded + np.uint64(1)) * _GOLD)


IS_WORD, CODE = _byte_tables()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]))
    return up, down


_TABLE: list = [None]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _TABLE[0] is None or len(_TABLE[0][0]) <= n:
        _TABLE[0] = _powers(max(n, PIECE + 4096))
    return _TABLE[0]


def give_back() -> None:
    """At the end of a task: hand freed memory back, since the worker stays and other stages need it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[o[0] : o[-1]], o - o[0]


def pieces(column: pa.Array, size: int = PIECE, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes and at most ``rows`` rows each; a longer text is a range of its own."""
    _, offsets = string_buffers(column)
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), first + (rows or len(offsets)), len(offsets) - 1)
        yield first, last
        first = last


def _hash_span(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and hashes in ``data``; no word crosses a break."""
    word = IS_WORD[data]
    if not word.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[breaks] = False
    start = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[breaks[breaks > 0] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    up, down = _power_tables(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum(CODE[data] * up[: len(data)], dtype=np.uint64)])
    h = (total[end] - total[start]) * down[start]
    return start, end, mix(h + (end - start).astype(np.uint64) * _GOLD)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, ends and hashes of all words in order, and the n + 1 offsets of each text's words."""
    starts, ends, hashes, at = [], [], [], 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data) and IS_WORD[data[to]] and IS_WORD[data[to - 1]]:  # to the end of a word
            gap = np.flatnonzero(~IS_WORD[data[to : to + PIECE]])
            to = to + int(gap[0]) if len(gap) else min(to + PIECE, len(data))
        inner = offsets[(offsets >= at) & (offsets < to)] - at
        s, e, h = _hash_span(data[at:to], inner)
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = to
    start, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return start, end, h, np.searchsorted(start, offsets, "left")


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 offsets of each text's words."""
    _, _, h, words = word_spans(data, offsets)
    return h, words


def shingle_units(h: np.ndarray, word_offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of word shingles: text index, shingle hash and count, sorted by both.

    A text of fewer than ``width`` words, but not none, is one shingle.
    """
    n_texts = len(word_offsets) - 1
    n = np.diff(word_offsets)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
    count = np.where(n >= width, n - width + 1, 0)
    doc = np.repeat(np.arange(n_texts), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(word_offsets[:-1], count)
    s = np.zeros(len(at), np.uint64)
    for k in range(width):
        s += h[at + k] * factors[k]
    short = np.flatnonzero((n > 0) & (n < width))
    tail = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = n[short] > k
        tail[has] += h[word_offsets[short[has]] + k] * factors[k]
    doc = np.concatenate([doc, short])
    s = mix(np.concatenate([s, tail + n[short].astype(np.uint64)]))
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    if not len(s):
        return doc, s, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])]))
    return doc[first], s[first], np.diff(np.concatenate([first, [len(s)]]))
