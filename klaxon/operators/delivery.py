"""What to send, to whom and when.

Timing depends on a subscription only through (dwell, repeat): it is planned once per incident and
distinct policy and joined with the subscriptions afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .state import incident_id, to_ms
from .verdicts import with_value

FIRING, REPEAT, RESOLVED = "firing", "repeat", "resolved"
_POLICY = ("dwell_us", "repeat_us", "since_us")
_EVENT = ("rule_id", "carried", "open_at", "open_seq", *_POLICY, "kind", "now", "seq", "measure", "detail")
_NEVER = -1  # since_us of a policy that has not notified yet
_MS = 1000   # clocks restart at millisecond precision, as stored


def _us(ns: Column) -> Column:
    """Whole microseconds, rounded up: a delay is reached at the same tick."""
    return F.expr("({0} + 999) div 1000".format(ns))


def subscription_policies(matches: DataFrame, sub_states: DataFrame | None = None,
                          carried_incidents: DataFrame | None = None) -> DataFrame:
    """Timing policy of every (rule, subscription).

    For an incident carried over from an earlier batch the policy also holds when the subscription
    was last notified about it, so its clock continues.
    """
    base = matches.select(
        "*", _us("dwell_ns").alias("dwell_us"), _us("repeat_interval_ns").alias("repeat_us"))
    fresh = base.withColumn("since_us", F.lit(_NEVER).cast("bigint")).withColumn("carried", F.lit(False))
    if sub_states is None or carried_incidents is None:
        return fresh
    told = sub_states.where("notify_count > 0").select(
        "incident_id", "subscription_id", F.unix_micros("last_notified_at").alias("since_us"))
    old = (
        base.join(carried_incidents.select("rule_id", "incident_id"), "rule_id")
        .join(told, ["incident_id", "subscription_id"], "left").drop("incident_id")
        .withColumn("since_us", F.coalesce("since_us", F.lit(_NEVER).cast("bigint")))
        .withColumn("carried", F.lit(True))
    )
    return fresh.unionByName(old)


def _policies(policies: DataFrame, keep: str) -> DataFrame:
    """Distinct policies per rule as one array, so that ticks are joined, not multiplied."""
    return (
        policies.where(keep).groupBy("rule_id", "carried")
        .agg(F.collect_set(F.struct(*_POLICY)).alias("policies"))
    )


def _elapsed(now: Column) -> Column:
    return F.unix_micros(now) - F.unix_micros(to_ms(F.col("open_at")))


def first_notices(incidents: DataFrame, ticks: DataFrame | None, policies: DataFrame) -> DataFrame:
    """First tick of an incident that has fired for at least ``dwell``: one row per incident and policy."""
    at_open = (
        incidents.where("not carried")
        .join(_policies(policies, "not carried and dwell_us <= 0"), ["rule_id", "carried"])
        .select("rule_id", "carried", "open_at", "open_seq", F.inline("policies"),
                F.lit(FIRING).alias("kind"), F.col("open_at").alias("now"), F.col("open_seq").alias("seq"),
                F.col("open_measure").alias("measure"), F.col("open_detail").alias("detail"))
    )
    if ticks is None:
        return at_open
    waiting = _policies(policies, f"since_us = {_NEVER} and (dwell_us > 0 or carried)")
    # Keep a tick only if it may be the first one past some dwell: about one row per policy and slice.
    due = F.filter("policies", lambda p: (_elapsed(F.col("now")) >= p["dwell_us"]) & (
        F.col("prev_now").isNull() | (F.col("prev_now") == F.col("open_at")) | (
            _elapsed(F.col("prev_now")) < p["dwell_us"])))
    later = (
        ticks.join(waiting, ["rule_id", "carried"])
        .where((F.col("now") > F.col("open_at")) | (F.col("seq") > F.col("open_seq")))
        .withColumn("policies", due)
        .select("rule_id", "carried", "open_at", "open_seq", F.inline("policies"), "now", "seq", "measure", "detail")
        .groupBy("rule_id", "carried", "open_at", "open_seq", *_POLICY)
        .agg(F.min(F.struct("now", "seq", "measure", "detail")).alias("t"))
        .select("rule_id", "carried", "open_at", "open_seq", *_POLICY, F.lit(FIRING).alias("kind"), "t.*")
    )
    return at_open.unionByName(later)


def repeat_notices(incidents: DataFrame, ticks: DataFrame, policies: DataFrame) -> DataFrame:
    """Repeats: after a notice, the next one is the first firing tick at least ``repeat`` later.

    The chain is greedy over the actual ticks, so it is walked in order, one incident and policy at a
    time, holding only the last notice. Only incidents that lasted at least ``dwell`` and ``repeat`` are
    walked. Since the clock has millisecond precision, only the first tick of a millisecond can ever be a
    notice; the others are dropped before the shuffle, which bounds a chain by the time it covers and
    not by the number of records.
    """
    cell = lambda t, p: F.expr(f"(unix_micros({t}) - {p} % {_MS}) div {_MS}")
    lasted = F.unix_micros("close.now") - F.unix_micros(to_ms(F.col("open_at")))
    long = F.filter("policies", lambda p: F.col("close").isNull() | (p["since_us"] != _NEVER) | (
        lasted >= F.greatest(p["dwell_us"], p["repeat_us"])))
    walked = (
        incidents.join(_policies(policies, "repeat_us > 0"), ["rule_id", "carried"])
        .select("rule_id", "carried", "open_at", "open_seq", long.alias("policies")).where(F.size("policies") > 0)
    )
    chains = (
        ticks.join(walked, ["rule_id", "carried", "open_at", "open_seq"])
        .select("*", F.inline("policies")).drop("policies")
        .where(_elapsed(F.col("now")) >= F.col("dwell_us"))
        .where((F.col("dwell_us") <= 0) | (F.col("now") > F.col("open_at")) | (F.col("seq") > F.col("open_seq")))
        .where(F.col("prev_now").isNull() | (cell("now", "repeat_us") != cell("prev_now", "repeat_us"))
               | (F.col("prev_now") == F.col("open_at")) | (_elapsed(F.col("prev_now")) < F.col("dwell_us")))
    )
    keys = ["rule_id", "carried", "open_at", "open_seq", *_POLICY]
    ordered = (
        chains.select(*keys, "now", "seq", "measure", "detail", F.unix_micros("now").alias("us"))
        .repartition(*keys).sortWithinPartitions(*keys, "now", "seq")
    )
    schema = T.StructType([f for f in ordered.schema if f.name != "us"])
    return (
        ordered.mapInArrow(_chain_walker(keys, _MS), schema)
        .select(*keys, F.lit(REPEAT).alias("kind"), "now", "seq", "measure", "detail")
    )


def _chain_walker(keys: list[str], ms: int):
    """Walk sorted chains batch by batch; a chain may span batches but never partitions.

    Nested, so that it is shipped by value and executors need not import this package.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            us, repeat, since = (batch.column(c).to_numpy() for c in ("us", "repeat_us", "since_us"))
            begins = np.zeros(n, dtype=bool)
            for name in keys:
                column = batch.column(name)
                begins[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            begins[0] = current != [batch.column(k)[0] for k in keys]
            starts = np.union1d([0], np.flatnonzero(begins))
            picks: list[int] = []
            for start, end in zip(starts, [*starts[1:], n]):
                pos = start
                if begins[start]:
                    last = None if since[start] < 0 else int(since[start])
                if last is None:
                    last, pos = int(us[start]) // ms * ms, start + 1  # the firing notice itself
                while pos < end:
                    pos += int(np.searchsorted(us[pos:end], last + repeat[start], side="left"))
                    if pos < end:
                        picks.append(int(pos))
                        last = int(us[pos]) // ms * ms
                        pos += 1
            current = [batch.column(k)[n - 1] for k in keys]
            if picks:
                yield batch.take(pa.array(picks, pa.int64())).select([c for c in batch.schema.names if c != "us"])

    return walk


def resolve_notices(incidents: DataFrame, firsts: DataFrame, policies: DataFrame, carried: bool = True) -> DataFrame:
    """A closed incident resolves for every policy that had been notified; dwell is not checked again.

    ``carried`` tells whether there are incidents from earlier batches.
    """
    closed = incidents.where("close is not null").select(
        "rule_id", "carried", "open_at", "open_seq", F.lit(RESOLVED).alias("kind"),
        F.col("close.now").alias("now"), F.col("close.seq").alias("seq"),
        F.col("close.measure").alias("measure"), F.col("close.detail").alias("detail"))
    told_early = [closed.join(_policies(policies, "not carried and dwell_us <= 0"), ["rule_id", "carried"])]
    if carried:
        told_early.append(closed.join(_policies(policies, f"carried and since_us <> {_NEVER}"), ["rule_id", "carried"]))
    keys = ["rule_id", "carried", "open_at", "open_seq"]
    told_now = firsts.where("carried or dwell_us > 0").select(*keys, *_POLICY).join(closed, keys)
    out = told_now.select(*_EVENT)
    for part in told_early:
        out = out.unionByName(part.select("*", F.inline("policies")).select(*_EVENT))
    return out


def dispatches(
    incidents: DataFrame,
    ticks: DataFrame | None,
    policies: DataFrame,
    carried: bool = True,
) -> DataFrame:
    """Every (event, subscription): firing, repeat and resolved, before one-shot and channels.

    The first notices are stored, since resolutions start from them again.
    """
    firsts = first_notices(incidents, ticks, policies)
    if ticks is not None:
        firsts = materialize(firsts, "firsts")
    events = firsts.select(*_EVENT).unionByName(resolve_notices(incidents, firsts, policies, carried))
    if ticks is not None:
        events = events.unionByName(repeat_notices(incidents, ticks, policies).select(*_EVENT))
    return (
        events.join(policies, ["rule_id", "carried", *_POLICY])
        .where((F.col("kind") != RESOLVED) | F.col("notify_on_resolve"))
        .withColumn("incident_id", incident_id(F.col("rule_id"), F.col("open_at"), F.col("open_seq")))
        .select("incident_id", "rule_id", "open_at", "subscription_id", "subscriber_id", "one_shot", "kind",
                "now", "seq", "measure", "detail")
    )


def bindings(subscriptions: DataFrame, subscribers: DataFrame, channels: DataFrame) -> DataFrame:
    """Channel bindings of each subscription that may be used.

    Drops bindings outside the subscription's channel filter (empty = all) or naming a channel that is
    not configured; ``skipped`` counts them. Subscriptions of unknown subscribers are absent.
    """
    subs = subscriptions.select(F.col("id").alias("subscription_id"), "subscriber_id", "channel_filter")
    people = subscribers.select(F.col("id").alias("subscriber_id"), "channels")
    listed = subs.join(people, "subscriber_id").select(
        "subscription_id", "channel_filter", F.posexplode_outer("channels").alias("pos", "b"))
    known = channels.select(F.col("name").alias("channel"), F.col("type").alias("channel_type"), "default_address")
    allowed = (F.coalesce(F.size("channel_filter"), F.lit(0)) <= 0) | F.array_contains("channel_filter", F.col("b.channel"))
    joined = listed.withColumn("channel", F.col("b.channel")).join(known, "channel", "left")
    usable = F.col("channel_type").isNotNull() & allowed
    entry = F.struct("pos", "channel", F.col("b.address").alias("address"), "channel_type", "default_address")
    return joined.groupBy("subscription_id").agg(
        F.array_sort(F.collect_list(F.when(usable, entry))).alias("bindings"),
        F.count_if(F.col("channel").isNotNull() & ~F.coalesce(usable, F.lit(False))).alias("skipped"))


def missing_subscribers(subscriptions: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Subscriptions whose subscriber does not exist; nothing is ever sent for them."""
    return subscriptions.select(F.col("id").alias("subscription_id"), "subscriber_id").join(
        subscribers.select(F.col("id").alias("subscriber_id")), "subscriber_id", "left_anti")


def addressed(dispatched: DataFrame, usable: DataFrame) -> DataFrame:
    """Dispatches of known subscribers with their usable bindings."""
    return dispatched.join(usable, "subscription_id")


def one_shot(deliveries: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Keep the first delivery of one-shot subscriptions, and none if the history holds one.

    A delivery without any usable binding leaves no trace and so does not use up the shot. All
    bindings of the first delivery go out. Ties are broken by (now, seq, rule).
    """
    many = deliveries.where("not one_shot")
    single = deliveries.where("one_shot and size(bindings) > 0")
    if history is not None:
        single = single.join(history.select("subscription_id").distinct(), "subscription_id", "left_anti")
    columns = deliveries.columns
    rest = [c for c in columns if c not in ("now", "seq", "rule_id")]
    first = (
        single.groupBy(F.col("subscription_id").alias("_s"))
        .agg(F.min_by(F.struct("now", "seq", "rule_id", *rest), F.struct("now", "seq", "rule_id")).alias("d"))
        .select("d.*").select(*columns)
    )
    return many.unionByName(first)


def outbox(deliveries: DataFrame, rules: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per message: audit columns plus everything a payload needs.

    ``triggered_at`` equals the send time; the start of the incident is ``incident_triggered_at``.
    """
    from .payloads import destination

    names = rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "severity",
                         F.coalesce("description", F.lit("")).alias("description"))
    rows = deliveries.select("*", F.explode("bindings").alias("b")).drop("bindings", "skipped")
    rows = with_value(rows.withColumn("triggered", F.col("kind") != RESOLVED), templates)
    sent_at = to_ms(F.col("now"))
    target, error = destination(F.col("b.channel_type"), F.col("b.address"), F.col("b.default_address"))
    identity = F.sha2(F.concat_ws(
        "|", "incident_id", "subscription_id", "kind", F.unix_micros("now").cast("string"),
        F.col("seq").cast("string"), F.col("b.pos").cast("string")), 256)
    return rows.join(names, "rule_id").select(
        identity.alias("id"), "incident_id", "subscription_id", "subscriber_id", F.col("b.channel").alias("channel"),
        F.coalesce("b.address", F.lit("")).alias("address"), "kind", sent_at.alias("sent_at"),
        F.when(error.isNull(), "ok").otherwise("error").alias("status"), F.coalesce(error, F.lit("")).alias("error"),
        F.col("b.channel_type").alias("channel_type"), target.alias("destination"), "rule_id", "rule_name",
        "severity", "description", "value", F.col("now").alias("now"), F.col("now").alias("triggered_at"),
        F.col("open_at").alias("incident_triggered_at"),
    )


_AUDIT = ("id", "incident_id", "subscription_id", "subscriber_id", "channel", "address", "kind", "sent_at",
          "status", "error")


def audit(messages: DataFrame) -> DataFrame:
    """The stored notification rows."""
    return messages.select(*_AUDIT)


def deliver(messages: DataFrame, sender: Callable[[dict], None]) -> DataFrame:
    """Send messages with a user-supplied callable and return the audit rows.

    The callable gets one message as a dict and raises to report a failure. It runs on the executors, per
    partition; failed sends are recorded and not retried. Spark may rerun a lost task, so write the
    result once and give the sender the message ``id`` for de-duplication.
    """
    columns = list(_AUDIT)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            results = []
            for message in part.to_dict("records"):
                if message["status"] == "error":
                    results.append(("error", message["error"]))
                    continue
                try:
                    sender(message)
                    results.append(("ok", ""))
                except Exception as err:  # the audit row carries whatever the sender reports
                    results.append(("error", str(err)))
            out = part[columns].copy()
            out["status"] = [r[0] for r in results]
            out["error"] = [r[1] for r in results]
            yield out

    return messages.mapInPandas(run, audit(messages).schema)


def delivery_counters(deliveries: DataFrame, messages: DataFrame) -> DataFrame:
    """Per subscription: messages sent, failed, and bindings skipped."""
    skipped = deliveries.groupBy("subscription_id").agg(F.sum("skipped").alias("skipped"))
    sent = messages.groupBy("subscription_id").agg(
        F.count_if(F.col("status") == "ok").alias("sent_ok"), F.count_if(F.col("status") == "error").alias("sent_err"))
    zero = F.lit(0).cast("bigint")
    return skipped.join(sent, "subscription_id", "left").select(
        "subscription_id", F.coalesce("sent_ok", zero).alias("sent_ok"),
        F.coalesce("sent_err", zero).alias("sent_err"), "skipped")


def sub_states(dispatched: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Delivery state per (incident, subscription).

    Counts advance with every planned delivery, also when its sends failed or were suppressed.
    """
    told = F.col("kind").isin(FIRING, REPEAT)
    now = dispatched.groupBy("incident_id", "subscription_id").agg(
        F.max(F.when(told, to_ms(F.col("now")))).alias("last_notified_at"), F.count_if(told).alias("notify_count"),
        F.bool_or(F.col("kind") == RESOLVED).alias("resolution_sent"))
    if previous is None:
        return now
    return now.unionByName(previous.select(*now.columns)).groupBy("incident_id", "subscription_id").agg(
        F.max("last_notified_at").alias("last_notified_at"), F.sum("notify_count").alias("notify_count"),
        F.bool_or("resolution_sent").alias("resolution_sent"))
