"""Sorted numbers in Elias-Fano form, with vectorised successor search on the compressed arrays.

A number's low bits are stored as they are; its high part is stored as gaps in a bit vector, a one for each number and a zero
for each step of the high part.  About 2 + log2(universe / n) bits a number.
"""

from __future__ import annotations

import json

import numpy as np

U64 = np.uint64
_ONES = U64(0x0101010101010101)
#: Place of the k-th one of each byte.
_PLACE = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    for _k, _at in enumerate(i for i in range(8) if _byte >> i & 1):
        _PLACE[_byte, _k] = _at


def select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one, from 0, of each 64-bit word, by running sums of its bytes' ones (the public broadword method)."""
    k = k.astype(U64)
    s = x - (x >> U64(1) & U64(0x5555555555555555))
    s = (s & U64(0x3333333333333333)) + (s >> U64(2) & U64(0x3333333333333333))
    s = (s + (s >> U64(4)) & U64(0x0F0F0F0F0F0F0F0F)) * _ONES
    high = U64(0x8080808080808080)
    at = (((k * _ONES | high) - s & high) >> U64(7)) * _ONES >> U64(56) << U64(3)
    rank = k - ((s << U64(8)) >> at & U64(255))
    return (at + _PLACE[x >> at & U64(255), rank.astype(np.int64) & 7]).astype(np.int64)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays in one block of bytes, each from a multiple of 8, behind a JSON header."""
    at, head, body = 0, {}, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [at, len(raw), a.dtype.str]
        body.append(raw + b"\0" * (-len(raw) % 8))
        at += len(body[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return b"".join([len(text).to_bytes(8, "little"), text, *body])


def unpack(block: np.ndarray) -> dict[str, np.ndarray]:
    """Views into a block of :func:`pack` given as bytes, memory-mapped or not."""
    n = int.from_bytes(block[:8].tobytes(), "little")
    head = json.loads(block[8 : 8 + n].tobytes())
    return {k: block[8 + n + at : 8 + n + at + size].view(kind) for k, (at, size, kind) in head.items()}


def encode(values: np.ndarray, universe: int, name: str = "") -> dict[str, np.ndarray]:
    """Arrays of sorted unsigned numbers below ``universe``; keys begin with ``name``."""
    n = len(values)
    low_bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
    values = values.astype(U64)
    low = np.zeros((n * low_bits + 63) // 64 + 1, U64)
    if low_bits:
        raw, step = low.view(np.uint8), 1 << 16
        shifts = np.arange(low_bits, dtype=U64)
        for a in range(0, n, step):  # a multiple of 8 numbers begins a byte
            bits = (values[a : a + step, None] >> shifts & U64(1)).astype(np.uint8)
            packed = np.packbits(bits.reshape(-1), bitorder="little")
            raw[a * low_bits // 8 : a * low_bits // 8 + len(packed)] = packed
    top = (universe >> low_bits) + 1
    bits = np.zeros(-(-(n + top) // 64) * 64, np.uint8)
    bits[(values >> U64(low_bits)).astype(np.int64) + np.arange(n)] = 1
    high = np.packbits(bits, bitorder="little").view(U64)
    ones = np.bitwise_count(high).astype(np.int64)
    zeros = np.concatenate([[0], np.cumsum(64 - ones)]).astype(np.int64)
    return {f"{name}n": np.array([n, low_bits], np.int64), f"{name}low": low, f"{name}high": high, f"{name}zeros": zeros}


class Sequence:
    """Reads what :func:`encode` wrote."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str = ""):
        self.n, self.low_bits = (int(x) for x in arrays[f"{name}n"])
        self._low, self._high, self._zeros = (arrays[f"{name}{k}"] for k in ("low", "high", "zeros"))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U64)
        at = i.astype(np.int64) * self.low_bits
        word, off = at >> 6, (at & 63).astype(U64)
        return (self._low[word] >> off | self._low[word + 1] << (U64(63) - off) << U64(1)) & U64((1 << self.low_bits) - 1)

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high part's bits, from 0."""
        word = np.searchsorted(self._zeros, k, side="right") - 1
        return word * 64 + select_in_word(~self._high[word], k - self._zeros[word])

    def _range(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first number not below each value, and where the numbers with its high part end."""
        high = (values >> U64(self.low_bits)).astype(np.int64)
        zero = np.full(len(values), -1, np.int64)
        later = high > 0
        zero[later] = self._select_zero(high[later] - 1)
        start = zero - high + 1
        # The ones behind that zero are the numbers with this high part; they seldom go on in the next word.
        shift = np.where(later, (zero & 63) + 1, 0)
        x = self._high[np.maximum(zero, 0) >> 6] >> (shift >> 1).astype(U64) >> (shift - (shift >> 1)).astype(U64)
        ones = np.bitwise_count(x & ~(x + U64(1))).astype(np.int64)
        end = start + ones
        on = np.flatnonzero(ones >= 64 - shift)
        end[on] = self._select_zero(high[on]) - high[on]
        stop = end.copy()
        want = values & U64((1 << self.low_bits) - 1)
        live = np.flatnonzero(start < stop)
        while len(live):
            mid = (start[live] + stop[live]) >> 1
            below = self._lows(mid) < want[live]
            start[live] = np.where(below, mid + 1, start[live])
            stop[live] = np.where(below, stop[live], mid)
            live = live[start[live] < stop[live]]
        return start, end

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first number that is not below each value."""
        return self._range(values.astype(U64))[0]

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it is not among the numbers."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        values = values.astype(U64)
        at, end = self._range(values)
        out = np.full(len(values), -1, np.int64)
        inside = np.flatnonzero(at < end)  # a number with the same high part, so that low parts decide
        same = inside[self._lows(at[inside]) == values[inside] & U64((1 << self.low_bits) - 1)]
        out[same] = at[same]
        return out

    def values(self, i: np.ndarray) -> np.ndarray:
        """The numbers at some places."""
        return self._highs(i) << U64(self.low_bits) | self._lows(i)

    def _highs(self, i: np.ndarray) -> np.ndarray:
        """High parts: the place of the i-th one, less i."""
        ones = np.arange(len(self._zeros), dtype=np.int64) * 64 - self._zeros
        word = np.searchsorted(ones, i, side="right") - 1
        return (word * 64 + select_in_word(self._high[word], i - ones[word]) - i).astype(U64)

    def decode(self) -> np.ndarray:
        """All numbers."""
        places = np.flatnonzero(np.unpackbits(self._high.view(np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return (places - i).astype(U64) << U64(self.low_bits) | self._lows(i)
