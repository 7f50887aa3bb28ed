"""A wavelet matrix over token ids, held in one compressed image.

Bit planes from the highest bit down; at each, ids with a 0 move stably before ids with a 1.
A rank directory holds the ones before every 512 bits. Planes and directories are compressed
with Zstandard, so one image is one self-contained file:

    b"WVLT1" | header length u32 | header JSON | sections, each compressed, lengths in the header
    sections: document ids (i64, null as minimum), token offsets (u64), then per plane bits, ranks
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"WVLT1"
STEP = 512
NULL_ID = -(2**63)


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int], doc_ids: np.ndarray, offsets: np.ndarray):
        self.n, self.planes, self.ranks, self.zeros, self.doc_ids, self.offsets = n, planes, ranks, zeros, doc_ids, offsets

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, offsets: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        current = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        planes, ranks, zeros = [], [], []
        for bit in range(depth - 1, -1, -1):
            one = (current & current.dtype.type(1 << bit)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            blocks = np.add.reduceat(np.bitwise_count(packed), np.arange(0, max(len(packed), 1), STEP // 8), dtype=np.int64) if len(packed) else np.zeros(1, np.int64)
            planes.append(packed)
            ranks.append(np.concatenate([[0], np.cumsum(blocks)]).astype(np.uint32))
            zeros.append(int(len(current) - ranks[-1][-1]))
            current = np.concatenate([current.compress(~one), current.compress(one)])
        return cls(len(ids), planes, ranks, zeros, np.asarray(doc_ids, np.int64), np.asarray(offsets, np.uint64))

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        raw = [self.doc_ids, self.offsets, *(x for pair in zip(self.planes, self.ranks, strict=True) for x in pair)]
        sections = [pack(np.ascontiguousarray(x).tobytes()) for x in raw]
        header = json.dumps({"n": self.n, "zeros": self.zeros, "lengths": [len(x) for x in sections]}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections])

    @classmethod
    def from_bytes(cls, image: bytes) -> WaveletMatrix:
        if image[:5] != MAGIC:
            raise ValueError("not a wavelet matrix image")
        size = struct.unpack_from("<I", image, 5)[0]
        header = json.loads(image[9 : 9 + size])
        at, raw = 9 + size, []
        unpack = zstandard.ZstdDecompressor().decompress
        for length in header["lengths"]:
            raw.append(unpack(image[at : at + length]))
            at += length
        planes = [np.frombuffer(x, np.uint8) for x in raw[2::2]]
        ranks = [np.frombuffer(x, np.uint32) for x in raw[3::2]]
        return cls(header["n"], planes, ranks, header["zeros"], np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.uint64))

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block, plane = i // STEP, self.planes[level]
        first = block * (STEP // 8)
        part = int(np.bitwise_count(plane[first : i // 8]).sum())
        if i % 8:
            part += int(plane[i // 8] & ((1 << (i % 8)) - 1)).bit_count()
        return int(self.ranks[level][block]) + part

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane: directory search, then one block."""
        edges = self.ranks[level].astype(np.int64)
        if not bit:
            edges = np.minimum(np.arange(len(edges)) * STEP, self.n) - edges
        block = int(np.searchsorted(edges, k, "right")) - 1
        first = block * (STEP // 8)
        bits = np.unpackbits(self.planes[level][first : first + STEP // 8], bitorder="little")
        return block * STEP + int(np.flatnonzero(bits == bit)[k - int(edges[block])])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit = (int(self.planes[level][i // 8]) >> (i % 8)) & 1
            ones = self._rank1(level, i)
            value, i = value * 2 + bit, self.zeros[level] + ones if bit else i - ones
        return value

    def _interval(self, value: int, start: int, stop: int) -> tuple[int, int]:
        depth = len(self.planes)
        if value < 0 or value >> depth:
            return 0, 0
        for level in range(depth):
            a, b = self._rank1(level, start), self._rank1(level, stop)
            if (value >> (depth - 1 - level)) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` before position i."""
        start, stop = self._interval(value, 0, i)
        return stop - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``value``."""
        start, stop = self._interval(value, 0, self.n)
        if not 0 <= k < stop - start:
            raise IndexError(k)
        i, depth = start + k, len(self.planes)
        for level in range(depth - 1, -1, -1):
            bit = (value >> (depth - 1 - level)) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """All ids in order: the stable moves undone from the lowest plane up."""
        depth = len(self.planes)
        values = np.zeros(self.n, np.uint16 if depth <= 16 else np.uint32)
        for level in range(depth - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            values[self.zeros[level] :] |= values.dtype.type(1 << (depth - 1 - level))
            # Zeros went first, then ones, both in this plane's order.
            before = np.empty_like(values)
            before[np.flatnonzero(~one)], before[np.flatnonzero(one)] = values[: self.zeros[level]], values[self.zeros[level] :]
            values = before
        return values.astype(np.uint32)
