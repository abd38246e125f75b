"""Wavelet matrix of a shard of token ids: bit planes with rank and select."""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"WVM1"
BLOCK = 512  # bits between two entries of a plane's rank directory


class WaveletMatrix:
    """Ids as bit planes, highest bit first; each plane orders the ids stably by the bits before it.

    The ids of a shard are first numbered within it, so that a shard with few
    distinct ids has few planes.
    """

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.alphabet, self.planes, self.zeros = n, alphabet, planes, zeros
        self._ranks: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        alphabet = np.flatnonzero(np.bincount(ids)).astype(np.uint32) if n else np.zeros(0, np.uint32)
        number = np.zeros(int(alphabet[-1]) + 1 if n else 1, dtype=np.uint32)
        number[alphabet] = np.arange(len(alphabet))
        now = number[ids]
        if len(alphabet) <= 1 << 16:
            now = now.astype(np.uint16)
        planes, zeros = [], []
        for level in reversed(range(max(0, len(alphabet) - 1).bit_length())):
            bits = (now >> level) & 1
            plane = bits.view(np.uint8)[:: bits.itemsize].astype(bool)
            planes.append(np.packbits(plane, bitorder="little"))
            low = np.flatnonzero(~plane)
            zeros.append(len(low))
            now = np.concatenate([now.take(low), now.take(np.flatnonzero(plane))])
        return cls(n, alphabet, planes, zeros)

    def dumps(self) -> bytes:
        """One file: header, alphabet, then for each plane its zeros, bits and rank directory."""
        parts = [MAGIC, struct.pack("<QII", self.n, len(self.alphabet), len(self.planes)), self.alphabet.astype("<u4").tobytes()]
        for i, plane in enumerate(self.planes):
            parts += [struct.pack("<Q", self.zeros[i]), plane.tobytes(), self.ranks(i).astype("<u4").tobytes()]
        return b"".join(parts)

    @classmethod
    def loads(cls, data: bytes) -> WaveletMatrix:
        raw = data
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, m, k = struct.unpack_from("<QII", raw, 4)
        at = 20
        alphabet = np.frombuffer(raw, "<u4", m, at)
        at += 4 * m
        planes, zeros, ranks = [], [], []
        for _ in range(k):
            zeros.append(struct.unpack_from("<Q", raw, at)[0])
            planes.append(np.frombuffer(raw, np.uint8, (n + 7) // 8, at + 8))
            at += 8 + (n + 7) // 8
            ranks.append(np.frombuffer(raw, "<u4", n // BLOCK + 1, at))
            at += 4 * (n // BLOCK + 1)
        out = cls(n, alphabet, planes, zeros)
        out._ranks = ranks
        return out

    def ranks(self, level: int) -> np.ndarray:
        if self._ranks[level] is None:
            ones = np.bitwise_count(self.planes[level]).astype(np.int64)
            step = BLOCK // 8
            upto = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), step)))]) if len(ones) else np.zeros(1, np.int64)
            self._ranks[level] = upto[: self.n // BLOCK + 1].astype(np.uint32)
        return self._ranks[level]

    def rank1(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        block = i // BLOCK
        first, whole = block * BLOCK // 8, i // 8
        plane = self.planes[level]
        ones = int(self.ranks(level)[block]) + int(np.bitwise_count(plane[first:whole]).sum())
        return ones + (int(plane[whole]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else ones

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][i >> 3]) >> (i & 7) & 1
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _range(self, token: int, start: int, end: int) -> tuple[int, int] | None:
        at = int(np.searchsorted(self.alphabet, token))
        if at == len(self.alphabet) or self.alphabet[at] != token:
            return None
        for level in range(len(self.planes)):
            s, e = self.rank1(level, start), self.rank1(level, end)
            if at >> (len(self.planes) - 1 - level) & 1:
                start, end = self.zeros[level] + s, self.zeros[level] + e
            else:
                start, end = start - s, end - e
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Times that token occurs in [start, end)."""
        got = self._range(token, start, self.n if end is None else end)
        return got[1] - got[0] if got else 0

    def _select_bit(self, level: int, bit: int, nth: int) -> int:
        """Position of the nth (from 0) bit of that value in a plane."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self.rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > nth:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, token: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of token."""
        got = self._range(token, 0, self.n)
        if not got or not 0 <= nth < got[1] - got[0]:
            raise IndexError(nth)
        i, value = got[0] + nth, int(np.searchsorted(self.alphabet, token))
        for level in reversed(range(len(self.planes))):
            bit = value >> (len(self.planes) - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, in order."""
        if not self.planes:
            return np.repeat(self.alphabet, self.n).astype(np.uint32)
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        values = None  # bits below the level at hand, in that level's order
        for level in reversed(range(len(self.planes))):
            plane = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            now = plane.astype(kind) << kind(len(self.planes) - 1 - level)
            if values is not None:
                now[np.flatnonzero(~plane)] |= values[: self.zeros[level]]
                now[np.flatnonzero(plane)] |= values[self.zeros[level] :]
            values = now
        return self.alphabet[values]
