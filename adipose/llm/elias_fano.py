"""Monotone integer sequences in Elias-Fano form; low bits stay packed, the high bitmap is unpacked to bucket ends."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class EliasFano:
    """``n`` sorted non-negative integers below 2**63: low bits packed, high parts as a unary bitmap."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        bits = np.unpackbits(high, bitorder="little")
        # element i has its high part's 1 at bit (high part + i); zeros end the buckets
        self._ends = np.flatnonzero(bits == 0) - np.arange(len(bits) - int(bits.sum()))

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(_U)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = min(56, max(0, (top // max(1, n)).bit_length() - 1))
        places = np.arange(low_bits, dtype=_U)
        packed = [np.empty(0, np.uint8)]
        for at in range(0, n if low_bits else 0, 1 << 14):  # a multiple of 8, so that parts end with whole bytes
            spread = (values[at : at + (1 << 14), None] >> places) & _U(1)
            packed.append(np.packbits(spread.astype(np.uint8).ravel(), bitorder="little"))
        low = np.concatenate(packed)
        buckets = (values >> _U(low_bits)).astype(np.int64)
        bits = np.zeros(n + (int(buckets[-1]) if n else 0) + 1, np.uint8)
        bits[buckets + np.arange(n)] = 1
        return cls(n, low_bits, np.append(low, np.zeros(9, np.uint8)), np.packbits(bits, bitorder="little"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<i8").tobytes()
        return head + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_buffer(cls, buffer, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence at byte ``at`` of a buffer, such as a memory map, and where it ends."""
        n, low_bits, a, b = (int(x) for x in np.frombuffer(buffer, "<i8", 4, at))
        low = np.frombuffer(buffer, np.uint8, a, at + 32)
        return cls(n, low_bits, low, np.frombuffer(buffer, np.uint8, b, at + 32 + a)), at + 32 + a + b

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), _U)
        bit = index * self.low_bits
        byte, shift = bit >> 3, (bit & 7).astype(_U)
        out = np.zeros(len(index), _U)
        for j in range(8):
            out |= self.low[byte + j].astype(_U) << _U(8 * j)
        out >>= shift
        over = shift > 0
        out[over] |= self.low[byte[over] + 8].astype(_U) << (_U(64) - shift[over])
        return out & _U((1 << self.low_bits) - 1)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element >= each value; n where there is none."""
        values = values.astype(_U)
        bucket = (values >> _U(self.low_bits)).astype(np.int64)
        rest = values & _U((1 << self.low_bits) - 1)
        last = len(self._ends) - 1
        inside = bucket <= last
        lo = np.where(inside, np.where(bucket > 0, self._ends[np.clip(bucket - 1, 0, last)], 0), self.n)
        hi = np.where(inside, self._ends[np.clip(bucket, 0, last)], self.n)
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < rest[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo

    def get(self, index: np.ndarray) -> np.ndarray:
        bucket = np.searchsorted(self._ends, index, side="right")
        return (bucket.astype(_U) << _U(self.low_bits)) | self._low(np.asarray(index))
