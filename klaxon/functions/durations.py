"""Flexible durations: ``1h30m``, ``1.5s``, and bare ``30d`` / ``2w``.

Day and week suffixes stand alone (``30d12h`` is invalid); negative or empty text is
invalid. Invalid durations are ``None`` / NULL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nanoseconds per unit.
UNIT_NS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}
DAY_NS = 24 * UNIT_NS["h"]
WEEK_NS = 7 * DAY_NS

_UNIT = "ns|us|µs|μs|ms|s|m|h"
_NUMBER = r"(?:\d+\.?\d*|\.\d+)"
_PART = rf"(\d*)(\.\d*)?({_UNIT})"
_CLOCK = rf"[+-]?(?:{_NUMBER}(?:{_UNIT}))+|[+-]?0"
_CALENDAR = rf"(\+?{_NUMBER}(?:[eE][+-]?\d+)?)([dw])"


def clock_duration_ns(text: str) -> int | None:
    """Nanoseconds of ``1h30m``-style text (may be negative), None when invalid."""
    if not re.fullmatch(_CLOCK, text):
        return None
    total = 0
    for whole, frac, unit in re.findall(_PART, text):
        size = UNIT_NS[unit]
        total += int(whole or 0) * size + int(float("0" + frac) * size if len(frac) > 1 else 0)
    return -total if text.startswith("-") else total


def flex_duration_ns(text: str) -> int | None:
    """Plan-time parse for rule specs; non-negative nanoseconds or None."""
    text = text.strip()
    calendar = re.fullmatch(_CALENDAR, text)
    if calendar:
        return int(float(calendar[1]) * (DAY_NS if calendar[2] == "d" else WEEK_NS))
    ns = clock_duration_ns(text)
    return ns if ns is not None and ns >= 0 else None


def flex_duration(text: Column) -> Column:
    """The same for a STRING column: BIGINT nanoseconds, NULL when invalid."""
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    amount = F.regexp_extract(clean, f"^{_CALENDAR}$", 1).try_cast("double")
    unit = F.when(F.endswith(clean, F.lit("w")), F.lit(WEEK_NS)).otherwise(F.lit(DAY_NS))

    def part_ns(part: Column) -> Column:
        size = F.lit(None).cast("bigint")
        for name, ns in UNIT_NS.items():
            size = F.when(F.regexp_extract(part, f"({_UNIT})$", 1) == name, F.lit(ns)).otherwise(size)
        whole = F.coalesce(F.regexp_extract(part, r"^(\d*)", 1).try_cast("bigint"), F.lit(0))
        frac = F.coalesce(F.regexp_extract(part, r"(\.\d+)", 1).try_cast("double"), F.lit(0.0))
        return whole * size + (frac * size).cast("bigint")

    parts = F.regexp_extract_all(clean, F.lit(f"({_NUMBER}(?:{_UNIT}))"), 1)
    clock = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc + part_ns(p))
    clock = F.when(F.startswith(clean, F.lit("-")), -clock).otherwise(clock)
    return (
        F.when(F.rlike(clean, F.lit(f"^(?:{_CALENDAR})$")), (amount * unit).cast("bigint"))
        .when(F.rlike(clean, F.lit(f"^(?:{_CLOCK})$")) & (clock >= 0), clock)
    )
