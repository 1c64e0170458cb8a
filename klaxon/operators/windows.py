"""Scheduled rules over trailing windows of samples.

Samples are first summed into panes (the stretch between two grid points), with map-side
combine, and only the panes are spread over the ticks they belong to. The grid step is the
greatest common divisor of schedule and window, so a window is always a whole number of
panes. A window is closed on both ends: samples lying exactly on a grid point form a pane of
their own that reaches one tick further.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import number_field, record_kind
from ..model import SCHEDULED, Fields, Rule, SqlReturnsRows, runnable
from ..session import materialize

# A window longer than this many schedules is put together from blocks instead of giving each pane to all its ticks.
MOST_TICKS_PER_PANE = 32
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(when: datetime) -> int:
    """Microseconds since the epoch; naive datetimes are UTC."""
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    delta = when - _EPOCH
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def cadence_us(schedule_ns: int) -> int:
    """Distance between two runs: the scheduler wakes once a second."""
    return max(1, math.ceil(schedule_ns / 1_000_000_000)) * 1_000_000


def observe(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One sample per record and numeric field: (input_ref, field, at, v)."""
    kind = record_kind(records)
    samples = F.array(*[
        F.struct(F.lit(f).alias("field"), number_field(F.col("record"), kind, f).alias("v")) for f in fields])
    return (records.select("input_ref", F.col("when").alias("at"), F.inline(samples))
            .where(F.col("v").isNotNull()))


@dataclass(frozen=True)
class _Feature:
    """One window aggregate of one rule, in grid units."""

    rule: str
    slot: int
    input_ref: str
    field: str
    agg: str
    step: int      # grid step in microseconds
    every: int     # grid steps between ticks
    span: int      # grid steps in the window
    closed: bool   # lower edge included
    first: int     # tick indexes first..ticks-1
    ticks: int


def _first_tick(start: int, every: int, after: datetime | None) -> int:
    return 0 if after is None else max(0, (micros(after) - start) // every + 1)


def _features(rules: Sequence[Rule], slots: dict[str, Fields], start: int, end: int, max_span_ns: int | None,
              after: datetime | None):
    for rule in rules:
        every = cadence_us(rule.schedule_ns)
        for (agg, name, window_ns), alias in slots[rule.id].wanted.items():
            limited = bool(max_span_ns and max_span_ns > 0 and max_span_ns <= window_ns)
            span = (max_span_ns if limited else window_ns) // 1000
            step = math.gcd(every, span) if span else every
            yield _Feature(rule.id, int(alias[1:]), rule.input_ref, name, agg, step, every // step, span // step,
                           not limited, _first_tick(start, every, after), max(0, (end - start) // every + 1))


def schedule_grid(spark: SparkSession, rules: Sequence[Rule], start: datetime, end: datetime,
                  after: datetime | None = None) -> DataFrame:
    """Every tick of the scheduled rules: (rule_id, tick, now), first one at ``start``.

    With ``after`` only the ticks later than it, on the same grid.
    """
    first, last = micros(start), micros(end)
    plan = [(r.id, cadence_us(r.schedule_ns)) for r in runnable(rules, SCHEDULED)]
    most = max([(last - first) // every + 1 for _, every in plan], default=0)
    least = min([_first_tick(first, every, after) for _, every in plan], default=0)
    entries = F.array(*[
        F.struct(F.lit(i).alias("rule_id"), F.lit(e).cast("bigint").alias("every"),
                 F.lit(_first_tick(first, e, after)).cast("bigint").alias("from")) for i, e in plan]) if plan \
        else F.expr("cast(array() as array<struct<rule_id:string,every:bigint,from:bigint>>)")
    return (
        spark.range(least, max(least, most)).select(F.col("id").alias("tick"), F.inline(entries))
        .where((F.col("tick") * F.col("every") <= last - first) & (F.col("tick") >= F.col("from")))
        .select("rule_id", "tick", F.timestamp_micros(F.lit(first) + F.col("tick") * F.col("every")).alias("now"))
    )


def window_features(
    records: DataFrame,
    rules: Sequence[Rule],
    start: datetime,
    end: datetime,
    max_span_ns: int | None = None,
    after: datetime | None = None,
) -> tuple[DataFrame, dict[str, Fields]]:
    """Window aggregates of every rule at every tick.

    Returns (rule_id, tick, now, w0..wn) and, per rule, which aggregate each ``w`` holds.
    Ticks without samples are present: count 0, other aggregates NULL.
    """
    active = [r for r in runnable(rules, SCHEDULED) if not isinstance(r.condition, SqlReturnsRows)]
    slots = {r.id: Fields(prefix="w") for r in active}
    for rule in active:
        rule.condition.outcome(slots[rule.id])
    first, last = micros(start), micros(end)
    features = list(_features(active, slots, first, last, max_span_ns, after))
    width = max([f.slot + 1 for f in features], default=0)
    grid = schedule_grid(records.sparkSession, active, start, end, after)
    empty = [F.lit(None).cast(t).alias(n) for n, t in
             (("slot", "int"), ("s", "double"), ("n", "bigint"), ("lo", "double"), ("hi", "double"))]
    rows = grid.select("rule_id", "tick", *empty)
    if features:
        panes = _panes(records, features, first)
        long = [i for i, f in enumerate(features) if f.span > MOST_TICKS_PER_PANE * f.every]
        if long:
            panes = materialize(panes, "panes")
            rows = rows.unionByName(_covered(panes.where(F.col("f").isin(long)), features, long))
            panes = panes.where(~F.col("f").isin(long))
        rows = rows.unionByName(_spread(panes, features))
    per_tick = rows.groupBy("rule_id", "tick").agg(
        *[a.alias(f"{name}{i}") for i in range(width) for name, a in _slot_aggregates(i)] or
        [F.count(F.lit(1)).alias("_rows")])
    every = {r.id: cadence_us(r.schedule_ns) for r in active}
    now = F.timestamp_micros(F.lit(first) + F.col("tick") * _by_rule(every, "bigint"))
    columns = []
    for i in range(width):
        aggs = {f.rule: f.agg for f in features if f.slot == i}
        agg = _by_rule(aggs, "string")
        count = F.coalesce(F.col(f"n{i}"), F.lit(0))
        columns.append(
            F.when(agg == "count", count.cast("double"))
            .when(count == 0, F.lit(None).cast("double"))
            .when(agg == "avg", F.try_divide(F.col(f"s{i}"), count))
            .when(agg == "sum", F.col(f"s{i}"))
            .when(agg == "min", F.col(f"lo{i}"))
            .when(agg == "max", F.col(f"hi{i}")).alias(f"w{i}"))
    return per_tick.select("rule_id", "tick", now.alias("now"), *columns), slots


def _slot_aggregates(i: int):
    mine = F.col("slot") == i
    for name, fn in (("s", F.sum), ("n", F.sum), ("lo", F.min), ("hi", F.max)):
        yield name, fn(F.when(mine, F.col(name)))


def _by_rule(values: dict, kind: str) -> Column:
    if not values:
        return F.lit(None).cast(kind)
    pairs = [c for k, v in values.items() for c in (F.lit(k), F.lit(v).cast(kind))]
    return F.try_element_at(F.create_map(*pairs), F.col("rule_id"))


def _panes(records: DataFrame, features: list[_Feature], first: int) -> DataFrame:
    """Sum samples into panes: (f, pane, edge) with partial aggregation before the shuffle."""
    kind = record_kind(records)
    names = sorted({f.field for f in features})
    numbers = {n: F.col(f"v{i}") for i, n in enumerate(names)}
    base = records.where(F.col("input_ref").isin(sorted({f.input_ref for f in features}))).select(
        "input_ref", (F.unix_micros("when") - first).alias("at"),
        *[number_field(F.col("record"), kind, n).alias(f"v{i}") for i, n in enumerate(names)])
    entries = F.array(*[
        F.struct(F.lit(i).alias("f"), F.lit(f.input_ref).alias("ref"), F.lit(f.step).cast("bigint").alias("step"),
                 F.lit((f.ticks - 1) * f.every).cast("bigint").alias("top"),
                 F.lit(f.first * f.every).cast("bigint").alias("bottom"),
                 F.lit(f.span).cast("bigint").alias("span"), numbers[f.field].alias("v"))
        for i, f in enumerate(features)])
    rest = F.pmod(F.col("at"), F.col("step"))
    pane = F.expr("(at - pmod(at, step)) div step") + F.when(rest > 0, F.lit(1)).otherwise(F.lit(0))
    return (
        base.select("input_ref", "at", F.inline(entries))
        .where((F.col("ref") == F.col("input_ref")) & F.col("v").isNotNull())
        .withColumn("pane", pane).withColumn("edge", rest == 0)
        .where((F.col("pane") <= F.col("top")) & (F.col("pane") + F.col("span") >= F.col("bottom")))
        .groupBy("f", "pane", "edge")
        .agg(F.sum("v").alias("s"), F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )


def _covered(panes: DataFrame, features: list[_Feature], long: list[int]) -> DataFrame:
    """Aggregates of windows that are much longer than their schedule, by blocks of 1, 2, 4, ... panes.

    A pane is summed into one block per size, and a window is cut into at most two blocks of each size, which an equi-join
    fetches. Both fan out with the logarithm of the window only. The pane exactly at the far end counts with its edge samples alone; it
    is kept as size -1.
    """
    levels = {i: max(0, features[i].span.bit_length()) for i in long}
    height = F.try_element_at(F.create_map(*[F.lit(x) for kv in levels.items() for x in kv]), F.col("f"))
    sums = [F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    sizes = F.when(F.col("edge"), F.sequence(F.lit(-1), height)).otherwise(F.sequence(F.lit(0), height))
    blocks = panes.select("*", F.explode(sizes).alias("size")).withColumn(
        "block", F.expr("if(size < 0, pane, shiftright(pane, greatest(size, 0)))")).groupBy("f", "size", "block").agg(*sums)
    entries = F.array(*[
        F.struct(F.lit(i).alias("f"), F.lit(features[i].rule).alias("rule_id"), F.lit(features[i].slot).alias("slot"),
                 F.lit(features[i].every).cast("bigint").alias("every"), F.lit(features[i].span).cast("bigint").alias("span"),
                 F.lit(features[i].closed).alias("closed"), F.lit(features[i].first).cast("bigint").alias("first"),
                 F.lit(features[i].ticks).cast("bigint").alias("ticks"), F.lit(levels[i]).alias("height")) for i in long])
    span = panes.sparkSession.range(min(features[i].first for i in long), max(features[i].ticks for i in long))
    ticks = span.select(F.col("id").alias("tick"), F.inline(entries)).where("tick >= first and tick < ticks")
    ticks = ticks.withColumn("b", F.col("tick") * F.col("every")).withColumn("a", F.col("b") - F.col("span") + 1)
    wanted = F.expr("""
        concat(
          flatten(transform(sequence(0, height), l -> filter(
            array(struct(l as size, -shiftright(-a, l) as block, (-shiftright(-a, l)) % 2 <> 0 as takes),
                  struct(l as size, shiftright(b + 1, l) - 1 as block, (shiftright(b + 1, l) - 1) % 2 = 0 as takes)),
            x -> x.takes and -shiftright(-a, l) <= shiftright(b + 1, l) - 1))),
          if(closed, array(struct(-1 as size, a - 1 as block, true as takes)), cast(array() as array<struct<size:int,block:bigint,takes:boolean>>)))""")
    pieces = ticks.select("f", "rule_id", "tick", "slot", F.explode(wanted).alias("w")).select("f", "rule_id", "tick", "slot", "w.size", "w.block")
    return pieces.join(blocks, ["f", "size", "block"]).groupBy("rule_id", "tick", "slot").agg(*sums).select(
        "rule_id", "tick", "slot", "s", "n", "lo", "hi")


def _spread(panes: DataFrame, features: list[_Feature]) -> DataFrame:
    """Give each pane to the ticks whose window covers it."""
    entry = F.array(*[
        F.struct(F.lit(f.rule).alias("rule_id"), F.lit(f.slot).alias("slot"), F.lit(f.every).alias("every"),
                 F.lit(f.span).alias("span"), F.lit(f.closed).alias("closed"), F.lit(f.first).cast("bigint").alias("first"),
                 F.lit(f.ticks).alias("ticks"))
        for f in features])
    reach = F.when(F.col("edge") & F.col("e.closed"), F.lit(0)).otherwise(F.lit(1))
    low = F.expr("greatest((greatest(pane, 0) + e.every - 1) div e.every, e.first)")
    top = F.col("pane") + F.col("e.span") - reach
    high = F.least(F.expr("top div e.every"), F.col("e.ticks").cast("bigint") - 1)
    return (
        panes.withColumn("e", F.get(entry, F.col("f"))).withColumn("top", top).where("top >= 0")
        .withColumn("low", low).withColumn("high", high).where("low <= high")
        .select("e.rule_id", F.explode(F.sequence("low", "high")).alias("tick"), "e.slot", "s", "n", "lo", "hi")
    )


def window_verdicts(
    records: DataFrame,
    rules: Sequence[Rule],
    start: datetime,
    end: datetime,
    max_span_ns: int | None = None,
    after: datetime | None = None,
) -> DataFrame:
    """Verdicts of window_aggregate and scheduled expression rules at every tick."""
    features, slots = window_features(records, rules, start, end, max_span_ns, after)
    triggered = measure = None
    for rule in runnable(rules, SCHEDULED):
        if rule.id not in slots:
            continue
        outcome = rule.condition.outcome(slots[rule.id])
        mine = F.col("rule_id") == rule.id
        shown = F.lit(None).cast("double") if outcome.measure is None else outcome.measure.cast("double")
        triggered = F.when(mine, outcome.triggered) if triggered is None else triggered.when(mine, outcome.triggered)
        measure = F.when(mine, shown) if measure is None else measure.when(mine, shown)
    if triggered is None:
        triggered, measure = F.lit(None).cast("boolean"), F.lit(None).cast("double")
    return features.select(
        "rule_id", "now", F.col("tick").alias("seq"), triggered.alias("triggered"), measure.alias("measure"),
        F.lit(None).cast("string").alias("detail"),
    ).where(F.col("triggered").isNotNull())
