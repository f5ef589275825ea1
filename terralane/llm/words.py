"""Words of Arrow text columns as 64-bit hashes, computed over whole blocks of bytes in numpy.

A block's bytes get one running sum of ``value(byte) * M^place`` (mod 2^64); the difference between a word's ends, times
``M^-start``, is a polynomial hash of the word wherever it stands, and is then mixed.  Equal words have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once; one longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_MULTIPLIER = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_tables: dict[str, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the public splitmix64 finish)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + (64 << 10))
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        for name, base in (("up", _MULTIPLIER), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _tables[name] = np.cumprod(table)
    return _tables["up"], _tables["down"]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b))


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; when a task has read its last, memory that Arrow keeps for more goes back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()


class Block:
    """Some rows' words: ``hashes`` in order, those of row r at ``bounds[r]:bounds[r+1]``."""

    def __init__(self, first: int, hashes: np.ndarray, bounds: np.ndarray):
        self.first, self.hashes, self.bounds = first, hashes, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def rows(self) -> np.ndarray:
        """The row of each word, from 0 in this block."""
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a space behind each text (null: empty), and where each text starts; one more bound at the end."""
    spaced = pc.binary_join_element_wise(pc.fill_null(column, "").cast(pa.large_string()), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    return np.frombuffer(spaced.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    part, start = np.cumsum(size) // limit, 0
    for stop in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]:
        if stop > start:
            yield start, stop
        start = stop


def blocks(column: pa.Array, lower: bool = True, by_class: bool = False) -> Iterator[Block]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; A-Z in lower case on request.

    ``by_class`` cuts words further where letters, digits and bytes of other scripts meet ASCII punctuation.
    """
    for first, stop in row_slices(column):
        data, offsets = joined(column.slice(first, stop - first))
        kind = (_CLASS if by_class else _SOLID)[data]
        solid = kind > 0
        change = np.empty(len(data), bool)
        change[0] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
        starts = np.flatnonzero(change & solid)
        edges = np.flatnonzero(change)
        ends = np.append(edges, len(data))[np.searchsorted(edges, starts) + 1]
        hashes = hash_spans(LOWER[data] if lower else data, starts, ends)
        yield Block(first, hashes, np.searchsorted(starts, offsets))


_SOLID = (~WHITE).astype(np.uint8)
_CLASS = _SOLID * 2
_CLASS[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
