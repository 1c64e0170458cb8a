"""Balanced time slices.

Alert state is sequential per rule, yet one rule may see a third of all records. The
operators therefore work per (rule, slice): slices are consecutive stretches of the
``(when, seq)`` order holding about the same number of records, so even a burst of records
with one timestamp is split. A slice is a pure function of a row's ``(when, seq)``, which
keeps recomputed tasks consistent after an executor loss.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SLICE = 1_000_000
MAX_SLICES = 65_536
_SAMPLES_PER_SLICE = 16


@dataclass(frozen=True)
class Timeline:
    """Slice boundaries: sorted ``(microseconds, seq)`` pairs, first row of each later slice."""

    bounds: tuple[tuple[int, int], ...] = ()

    @property
    def slices(self) -> int:
        return len(self.bounds) + 1

    def slice_of(self, when: Column, seq: Column) -> Column:
        """Index of the slice a row belongs to (binary search over the boundaries)."""
        if not self.bounds:
            return F.lit(0)
        bounds = F.from_json(
            F.lit(json.dumps([{"us": us, "seq": seq} for us, seq in self.bounds])),
            "array<struct<us:bigint,seq:bigint>>",
        )
        key = F.struct(F.unix_micros(when).alias("us"), seq.cast("bigint").alias("seq"))
        steps = [2**b for b in range(len(self.bounds).bit_length() - 1, -1, -1)]
        return F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda low, step: F.when(F.get(bounds, low + step - 1) <= key, low + step).otherwise(low),
        )


def plan_timeline(
    records: DataFrame,
    rows_per_slice: int = ROWS_PER_SLICE,
    max_slices: int = MAX_SLICES,
    when: str = "when",
    seq: str = "seq",
) -> Timeline:
    """Choose boundaries from the data: a count, and for large inputs a key sample.

    Only boundary candidates are sampled (about 16 keys per slice reach the driver); every
    record keeps its exact place.
    """
    keys = records.select(F.unix_micros(F.col(when)).alias("us"), F.col(seq).cast("bigint").alias("seq"))
    rows = keys.count()
    wanted = max(
        math.ceil(rows / rows_per_slice),
        min(3 * records.sparkSession.sparkContext.defaultParallelism, rows // 5_000),
    )
    slices = max(1, min(wanted, max_slices))
    if slices == 1:
        return Timeline()
    fraction = min(1.0, _SAMPLES_PER_SLICE * slices / rows)
    sample = sorted({(r["us"], r["seq"]) for r in keys.sample(fraction, seed=17).collect()
                     if r["us"] is not None})
    step = len(sample) / slices
    picks = {sample[int(i * step)] for i in range(1, slices)} if step >= 1 else set(sample)
    return Timeline(tuple(sorted(picks)))
