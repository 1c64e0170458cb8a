"""Token ids of whole texts by way of their distinct space-separated segments.

Words repeat, so a worker encodes each distinct segment once and keeps its ids. ``Segments`` is the store:
a bounded dictionary over one flat array; a full store is emptied and refilled, which costs time only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np

KEPT_SEGMENTS = 1_500_000


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Segments:
    """``encode`` maps distinct segments to their ids: (flat ids, length per segment)."""

    def __init__(self, encode: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT_SEGMENTS):
        self.encode, self.kept = encode, kept
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, new: list[str]) -> None:
        ids, lengths = self.encode(new)
        first, count = len(self.places), len(new)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + count > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[first:first + count] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:first + count] = lengths
        self.used += len(ids)
        self.places.update(zip(new, range(first, first + count)))

    def places_of(self, distinct: Sequence[str]) -> np.ndarray:
        """Places of distinct segments in the store; new ones are encoded."""
        index = np.fromiter(map(self.places.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(index < 0)
        if len(missing) and self.places and len(self.places) + len(missing) > self.kept:
            self.clear()
            index[:], missing = -1, np.arange(len(distinct))
        if len(missing):
            index[missing] = len(self.places) + np.arange(len(missing))
            self._add([distinct[i] for i in missing.tolist()])
        return index

    def take(self, index: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Ids of texts of some ``counts`` of segments, given as the places of all their segments in a row."""
        lengths = self.lengths[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)].tolist()
        flat = self.flat[gather(self.starts[index], lengths)]
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def ids(self, texts: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """Ids of each text, given as its segments."""
        codes: dict[str, int] = {}
        index = [codes.setdefault(s, len(codes)) for segments in texts for s in segments]
        places = self.places_of(list(codes))
        return self.take(places[np.array(index, np.int64)], np.array([len(s) for s in texts], np.int64))
