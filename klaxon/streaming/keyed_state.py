"""Incidents and notices as keyed incremental state, with ``transformWithState``.

The other stream (:class:`~klaxon.streaming.alert_stream.AlertStream`) rewrites its state tables in every micro-batch. Here each rule holds
one small value in the state store (RocksDB): its open incident, the last tick it has seen, and when each (dwell, repeat) policy was
last told. Its size depends on the rules and their policies, not on history.

Ticks wait in the state store until the watermark has passed them; an event-time timer then takes them in the order of (now, seq).
So records may come out of order by up to the watermark's delay, and the events are those of one batch run. Spark drops ticks behind
the watermark; one that still is older than the last one taken gives an event of kind ``late`` and changes nothing. Firing stretches are skipped through by binary search, so the
work of a batch is its sorting plus its events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Rule
from ..operators.state import incident_id
from ..operators.verdicts import push_verdicts

OPEN, CLOSE, LATE = "open", "close", "late"
_EVENTS = ("rule_id string, kind string, open_us bigint, open_seq bigint, dwell_us bigint, repeat_us bigint, us bigint, seq bigint, "
           "measure double, detail string")
_TICK = "us bigint, seq bigint, triggered boolean, measure double, detail string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def policies_of(subscription_policies: DataFrame) -> DataFrame:
    """The distinct (dwell, repeat) of each rule as one array: what the state of a rule has to follow."""
    return subscription_policies.where("not carried").groupBy("rule_id").agg(
        F.sort_array(F.collect_set(F.struct("dwell_us", "repeat_us"))).alias("policies"))


def _processor():
    """The processor's class. It is nested so that it is shipped by value and executors need not import this package."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    columns = [f.split()[0] for f in _EVENTS.split(", ")]

    class Ticks(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.rule = handle.getValueState("rule", "firing boolean, open_us bigint, open_seq bigint, last_us bigint, last_seq bigint")
            self.told = handle.getMapState("told", "dwell_us bigint, repeat_us bigint", "us bigint")
            self.known = handle.getValueState("policies", "pairs array<struct<dwell_us:bigint,repeat_us:bigint>>")
            self.waiting = handle.getListState("waiting", _TICK)
            self.alarm = handle.getValueState("alarm", "ms bigint")

        def handleInputRows(self, key, rows, timerValues):
            late, earliest = [], None
            held = self.rule.get() if self.rule.exists() else None
            for frame in rows:
                if not len(frame):
                    continue
                pairs = frame["policies"].iloc[0]
                self.known.update(([(int(p["dwell_us"]), int(p["repeat_us"])) for p in pairs] if pairs is not None else [],))
                fresh = np.ones(len(frame), bool)
                if held is not None and held[3] is not None:
                    after = (frame["us"] > held[3]) | ((frame["us"] == held[3]) & (frame["seq"] > held[4]))
                    fresh = after.to_numpy()
                for r in frame[~fresh].itertuples(index=False):
                    late.append((key[0], LATE, None, None, None, None, r.us, r.seq, r.measure, r.detail))
                kept = frame[fresh]
                if len(kept):
                    self.waiting.appendList([(int(r.us), int(r.seq), bool(r.triggered), None if pd.isna(r.measure) else float(r.measure),
                                              None if pd.isna(r.detail) else r.detail) for r in kept.itertuples(index=False)])
                    first = int(kept["us"].min()) // 1000 + 1
                    earliest = first if earliest is None else min(earliest, first)
            if earliest is not None:
                self._wake(earliest)
            if late:
                yield pd.DataFrame(late, columns=columns)

        def _wake(self, ms):
            """One timer a rule: at the millisecond after its earliest waiting tick."""
            if self.alarm.exists():
                set_for = self.alarm.get()[0]
                if set_for <= ms:
                    return
                self.handle.deleteTimer(set_for)
            self.handle.registerTimer(ms)
            self.alarm.update((ms,))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            limit = timerValues.getCurrentWatermarkInMs() * 1000
            self.alarm.clear()
            ticks = sorted(tuple(t) for t in self.waiting.get())
            at = next((i for i, t in enumerate(ticks) if t[0] >= limit), len(ticks))
            ready, rest = ticks[:at], ticks[at:]
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
                self._wake(rest[0][0] // 1000 + 1)
            out = self._taken(key[0], ready)
            if out:
                yield pd.DataFrame(out, columns=columns)

        def _taken(self, rule_id, ticks):
            """Events of ticks in order. A stretch of equal outcomes is handled as a whole."""
            if not ticks:
                return []
            held = self.rule.get() if self.rule.exists() else (False, None, None, None, None)
            firing, open_us, open_seq = held[0], held[1], held[2]
            pairs = [(int(p[0]), int(p[1])) for p in self.known.get()[0]] if self.known.exists() else []
            told = {(int(k[0]), int(k[1])): int(v[0]) for k, v in self.told.iterator()} if firing else {}
            us = np.array([t[0] for t in ticks], np.int64)
            on = np.array([t[2] for t in ticks], bool)
            cuts = [0, *(np.flatnonzero(on[1:] != on[:-1]) + 1).tolist(), len(ticks)]
            out = []

            def event(kind, pair, at):
                t = ticks[at]
                out.append((rule_id, kind, open_us, open_seq, pair and pair[0], pair and pair[1], t[0], t[1], t[3], t[4]))

            for start, end in zip(cuts, cuts[1:]):
                if not on[start]:
                    if firing:
                        event(CLOSE, None, start)
                        for pair in sorted(told):
                            event("resolved", pair, start)
                        firing, told = False, {}
                    continue
                first = start
                if not firing:
                    firing, open_us, open_seq = True, ticks[start][0], ticks[start][1]
                    event(OPEN, None, start)
                    for pair in pairs:
                        if pair[0] <= 0:
                            event("firing", pair, start)
                            told[pair] = open_us // 1000 * 1000
                    first = start + 1
                for pair in pairs:
                    at = first
                    if pair not in told:
                        at += int(np.searchsorted(us[at:end], open_us // 1000 * 1000 + pair[0], side="left"))
                        if at >= end:
                            continue
                        event("firing", pair, at)
                        told[pair] = int(us[at]) // 1000 * 1000
                        at += 1
                    while pair[1] > 0 and at < end:
                        at += int(np.searchsorted(us[at:end], told[pair] + pair[1], side="left"))
                        if at < end:
                            event("repeat", pair, at)
                            told[pair] = int(us[at]) // 1000 * 1000
                            at += 1
            self.rule.update((firing, open_us if firing else None, open_seq if firing else None, ticks[-1][0], ticks[-1][1]))
            self.told.clear()
            for pair, when in told.items():
                self.told.updateValue(pair, (when,))
            return out

        def close(self):
            pass

    return Ticks()


def rule_events(records: DataFrame, rules: Sequence[Rule], policies: DataFrame, delay: str) -> DataFrame:
    """Events of push rules over a stream of records, in append mode.

    ``policies`` comes from :func:`policies_of`. Kinds: ``open`` and ``close`` of incidents (without a policy), ``firing``, ``repeat`` and
    ``resolved`` per policy, ``late``. An event goes out once the watermark, ``delay`` behind the newest record, has passed its tick. The session
    needs the RocksDB state store (``STORE``).
    """
    watched = records.withWatermark("when", delay)
    verdicts = push_verdicts(watched, rules)
    ticks = verdicts.join(F.broadcast(policies), "rule_id", "left").select(
        "rule_id", F.col("now").alias("when"), F.unix_micros("now").alias("us"), "seq", "triggered", "measure", "detail", "policies")
    events = ticks.groupBy("rule_id").transformWithStateInPandas(
        statefulProcessor=_processor(), outputStructType=T.StructType.fromDDL(_EVENTS), outputMode="Append", timeMode="EventTime")
    open_at = F.timestamp_micros("open_us")
    return events.select(
        F.when(F.col("kind") != LATE, incident_id(F.col("rule_id"), open_at, F.col("open_seq"))).alias("incident_id"), "rule_id", "kind",
        open_at.alias("open_at"), "open_seq", "dwell_us", "repeat_us", F.timestamp_micros("us").alias("now"), "seq", "measure", "detail")


def dispatches(events: DataFrame, subscription_policies: DataFrame) -> DataFrame:
    """One row per notice and subscription, as :func:`klaxon.operators.delivery.dispatches` plans them."""
    told = events.where(F.col("dwell_us").isNotNull()).drop("open_seq")
    joined = told.join(subscription_policies.where("not carried"), ["rule_id", "dwell_us", "repeat_us"])
    return joined.where((F.col("kind") != "resolved") | F.col("notify_on_resolve")).select(
        "incident_id", "rule_id", "open_at", "subscription_id", "subscriber_id", "one_shot", "kind", "now", "seq", "measure", "detail")
