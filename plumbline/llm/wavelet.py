"""Wavelet matrix: token ids as succinct bit-planes with rank and select.

One matrix holds one shard.  The ids that occur in the shard are numbered by
falling frequency; the matrix stores those numbers, highest bit first.  Every
plane is the stable partition of the plane above it by its bit.  A plane keeps
its bits and one 32-bit rank for every 512 bits, so that access, rank and select
touch one block of bits a plane.

File format (little-endian): magic ``WMX1``; u32 n, u32 symbols, u32 planes;
u32 ids[symbols]; then per plane u32 zeros, u32 packed size, and the zlib stream
of its bit bytes (first bit lowest).  Ranks are rebuilt on loading.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"WMX1"
BLOCK = 512
_POP = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


def build(ids: np.ndarray) -> bytes:
    """The file of one shard's ids (any unsigned 32-bit values; none is fine)."""
    ids = np.asarray(ids, np.uint32)
    if len(ids) and int(ids.max()) < 1 << 20:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        symbols = symbols[np.argsort(-counts[symbols], kind="stable")].astype(np.uint32)
        table = np.zeros(len(counts), np.uint32)
        table[symbols] = np.arange(len(symbols), dtype=np.uint32)
        seq = table[ids]
    else:
        values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        symbols = values[order].astype(np.uint32)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        seq = rank[inverse]
    planes = max(1, int(len(symbols) - 1).bit_length()) if len(symbols) else 0
    seq = seq.astype(np.uint16) if planes <= 16 else seq
    out = [MAGIC, struct.pack("<III", len(ids), len(symbols), planes), symbols.tobytes()]
    for level in range(planes - 1, -1, -1):
        bits = (seq >> level & 1).astype(bool)
        packed = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
        low = seq[~bits]
        out += [struct.pack("<II", len(low), len(packed)), packed]
        if level:
            seq = np.concatenate([low, seq[bits]])
    return b"".join(out)


class WaveletMatrix:
    """A loaded shard; positions and counts are within the shard."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, count, planes = struct.unpack_from("<III", data, 4)
        self.symbols = np.frombuffer(data, np.uint32, count, 16)
        at = 16 + 4 * count
        self.bits, self.zeros = [], []
        for _ in range(planes):
            zeros, size = struct.unpack_from("<II", data, at)
            self.bits.append(np.frombuffer(zlib.decompress(data[at + 8 : at + 8 + size]), np.uint8))
            self.zeros.append(zeros)
            at += 8 + size
        self._ranks: list[np.ndarray] | None = None

    @property
    def ranks(self) -> list[np.ndarray]:
        """Ones before every block of 512 bits, by plane."""
        if self._ranks is None:
            self._ranks = []
            for b in self.bits:
                ones = np.zeros(-(-len(b) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
                ones[: len(b)] = _POP[b]
                self._ranks.append(np.concatenate([[0], np.cumsum(ones.reshape(-1, BLOCK // 8).sum(1, dtype=np.int64))]))
        return self._ranks

    def _ones(self, plane: int, at: int) -> int:
        block = at // BLOCK
        lo, hi = block * BLOCK // 8, at // 8
        n = int(self.ranks[plane][block]) + int(_POP[self.bits[plane][lo:hi]].sum())
        return n + int(self.bits[plane][hi] & (1 << at % 8) - 1).bit_count() if at % 8 else n

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, b in enumerate(self.bits):
            bit = b[i >> 3] >> (i & 7) & 1
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | int(bit)
        return int(self.symbols[value])

    def _code(self, token: int) -> int | None:
        found = np.flatnonzero(self.symbols == token)
        return int(found[0]) if len(found) else None

    def _range(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(len(self.bits)):
            a, b = self._ones(k, lo), self._ones(k, hi)
            if code >> len(self.bits) - 1 - k & 1:
                lo, hi = self.zeros[k] + a, self.zeros[k] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the id occurs in positions lo..hi (hi excluded)."""
        code = self._code(token)
        if code is None:
            return 0
        a, b = self._range(code, lo, self.n if hi is None else hi)
        return b - a

    def _find(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        ranks = self.ranks[plane]
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        raw = self.bits[plane][block * BLOCK // 8 : (block + 1) * BLOCK // 8]
        return block * BLOCK + int(np.flatnonzero(np.unpackbits(raw, bitorder="little") == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the id; -1 if there is none."""
        code = self._code(token)
        if code is None or k < 0:
            return -1
        lo, hi = self._range(code, 0, self.n)
        if lo + k >= hi:
            return -1
        at = lo + k
        for plane in range(len(self.bits) - 1, -1, -1):
            bit = code >> len(self.bits) - 1 - plane & 1
            at = self._find(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids: the planes are undone from the lowest up."""
        codes = np.zeros(self.n, np.uint16 if len(self.bits) <= 16 else np.uint32)
        for k in range(len(self.bits) - 1, -1, -1):
            bits = np.unpackbits(self.bits[k], count=self.n, bitorder="little").astype(bool)
            out = np.empty_like(codes)
            out[~bits] = codes[: self.zeros[k]]
            out[bits] = codes[self.zeros[k] :] | codes.dtype.type(1 << len(self.bits) - 1 - k)
            codes = out
        return self.symbols[codes] if self.n else np.zeros(0, np.uint32)
