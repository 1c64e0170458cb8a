"""Sets of rising offsets in the style of Roaring bitmaps, with selection of the k-th member.

Offsets are grouped by their high bits into chunks of 65,536. A chunk is stored as the smallest of three containers: an array of 16-bit
values, a bitmap of 8 KiB, or runs of consecutive values. Cumulative cardinalities over the containers turn the
selection of the k-th member into a binary search for its container and a selection inside it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHUNK_BITS = 16
CHUNK = 1 << CHUNK_BITS
BITMAP_BYTES = CHUNK // 8


@dataclass
class Array:
    """Sorted 16-bit values."""

    values: np.ndarray

    def select(self, k: int) -> int:
        return int(self.values[k])

    @property
    def bytes(self) -> int:
        return 2 * len(self.values)


@dataclass
class Bitmap:
    """One bit a value, with the number of members before each 64-bit word."""

    bits: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Bitmap:
        flags = np.zeros(CHUNK, np.uint8)
        flags[values] = 1
        return cls(np.packbits(flags, bitorder="little"), np.cumsum(flags.reshape(-1, 64).sum(axis=1, dtype=np.int64)))

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right"))
        inside = k - (int(self.before[word - 1]) if word else 0)
        flags = np.unpackbits(self.bits[8 * word:8 * word + 8], bitorder="little")
        return 64 * word + int(np.flatnonzero(flags)[inside])

    @property
    def bytes(self) -> int:
        return BITMAP_BYTES


@dataclass
class Runs:
    """First value of each run, with the number of members up to its end."""

    starts: np.ndarray
    upto: np.ndarray

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.upto, k, side="right"))
        return int(self.starts[run]) + k - (int(self.upto[run - 1]) if run else 0)

    @property
    def bytes(self) -> int:
        return 4 * len(self.starts)


def container(values: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest container of sorted distinct values below ``CHUNK``; ties go to the array, then the bitmap."""
    breaks = np.flatnonzero(np.diff(values) != 1) + 1
    n_runs = len(breaks) + 1
    least = min(2 * len(values), BITMAP_BYTES, 4 * n_runs)
    if least == 2 * len(values):
        return Array(values.astype(np.uint16))
    if least == BITMAP_BYTES:
        return Bitmap.of(values)
    first = np.concatenate([[0], breaks])
    return Runs(values[first].astype(np.uint16), np.append(breaks, len(values)))


class BoundarySet:
    """Rising distinct offsets with ``len`` and ``select``."""

    def __init__(self, offsets: np.ndarray):
        offsets = np.asarray(offsets, np.int64)
        chunk = offsets >> CHUNK_BITS
        first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(offsets) else np.zeros(0, np.int64)
        self.keys = chunk[first]
        self.upto = np.append(first[1:], len(offsets)) if len(offsets) else first
        self.containers = [container(part) for part in np.split(offsets & (CHUNK - 1), first[1:])] if len(offsets) else []

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The member of rank k, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.upto, k, side="right"))
        return (int(self.keys[at]) << CHUNK_BITS) + self.containers[at].select(k - (int(self.upto[at - 1]) if at else 0))
