"""From records to incidents and messages, in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.fields import record_kind
from ..model import PUSH, SCHEDULED, Rule, SqlReturnsRows, runnable, skipped
from ..operators import config, delivery, matching, payloads, state
from ..operators.sqljobs import JobLimits, evaluate_sql_rules, ticks_of
from ..operators.sqlrules import Datasources
from ..operators.timeline import ROWS_PER_SLICE, Timeline, plan_timeline
from ..operators.verdicts import push_verdicts, value_templates, with_value
from ..operators.windows import window_verdicts
from ..session import local_table, materialize


@dataclass(frozen=True)
class Subscribers:
    """Who wants to hear: subscriptions, subscribers, configured channels (DataFrames)."""

    subscriptions: DataFrame
    subscribers: DataFrame
    channels: DataFrame


@dataclass(frozen=True)
class Carried:
    """State left by earlier batches.

    ``open_incidents`` has the columns of :func:`klaxon.operators.state.open_seeds`.
    """

    open_incidents: DataFrame | None = None
    sub_states: DataFrame | None = None
    live_states: DataFrame | None = None
    notifications: DataFrame | None = None


@dataclass(frozen=True)
class AlertPlan:
    """Results as DataFrames. Making the plan counts the records of its time slices and runs the SQL rules; the rest runs when it is used."""

    rules: Sequence[Rule]
    verdict_parts: tuple[DataFrame, ...]
    errors: DataFrame | None
    timeline: Timeline
    rules_table: DataFrame
    audience: Subscribers | None = None
    carried: Carried = Carried()
    record_type: DataType | None = None

    @cached_property
    def templates(self) -> DataFrame:
        return value_templates(self.rules_table.sparkSession, self.rules)

    @cached_property
    def skipped(self) -> DataFrame:
        """(rule_id, reason) of the enabled rules that do not take part, because they are not valid."""
        return local_table(self.rules_table.sparkSession, skipped(self.rules, self.record_type), "rule_id string, reason string")

    @cached_property
    def verdicts(self) -> DataFrame:
        columns = ["rule_id", "now", "seq", "triggered", "measure", "detail", "slice"]
        parts = [p.select(*columns) for p in self.verdict_parts]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    @cached_property
    def incident_rows(self) -> DataFrame:
        """Incidents with their exact opening and closing ticks (see :func:`state.incidents_of`)."""
        runs = state.local_runs(self.verdict_parts[0])
        for part in self.verdict_parts[1:]:
            runs = runs.unionByName(state.local_runs(part))
        return state.incidents_of(runs, self.carried.open_incidents)

    @cached_property
    def incidents(self) -> DataFrame:
        return state.incident_table(self.incident_rows, self.templates)

    @cached_property
    def transitions(self) -> DataFrame:
        return with_value(state.transitions_of(self.incident_rows), self.templates)

    @cached_property
    def live_states(self) -> DataFrame:
        return state.live_states(state.last_verdicts(self.verdicts), self.incident_rows, self.templates,
                                 self.errors, self.carried.live_states)

    @cached_property
    def stored_incidents(self) -> DataFrame:
        """The incident rows, computed once: delivery planning reads them from several branches."""
        return materialize(self.incident_rows, "incidents")

    @cached_property
    def matches(self) -> DataFrame:
        known = config.surviving_subscriptions(self.audience.subscriptions, self.audience.subscribers)
        return matching.match_subscriptions(self.rules_table, known)

    @cached_property
    def policies(self) -> DataFrame:
        old = None if self.carried.open_incidents is None else self.carried.open_incidents.select(
            "rule_id", "incident_id")
        return materialize(
            delivery.subscription_policies(self.matches, self.carried.sub_states, old), "policies")

    @cached_property
    def ticks(self) -> DataFrame | None:
        """Firing ticks with their incident, of the rules whose subscriptions wait or repeat.

        None when every subscription is served at the opening tick. The rule ids are read from the policies:
        at most one per compiled rule.
        """
        waiting = {r["rule_id"] for r in self.policies.where("dwell_us > 0 or repeat_us > 0 or carried")
                   .select("rule_id").distinct().collect()}
        if not waiting:
            return None
        verdicts = self.verdicts.where(F.col("rule_id").isin(sorted(waiting)))
        return state.firing_ticks(verdicts, self.stored_incidents, self.timeline)

    @cached_property
    def dispatched(self) -> DataFrame:
        """Every (event, subscription), stored: deliveries and delivery state both start from it."""
        planned = delivery.dispatches(self.stored_incidents, self.ticks, self.policies,
                                      carried=self.carried.open_incidents is not None)
        return materialize(planned, "dispatched", spread=True)

    @cached_property
    def deliveries(self) -> DataFrame:
        usable = delivery.bindings(self.audience.subscriptions, self.audience.subscribers, self.audience.channels)
        return delivery.one_shot(delivery.addressed(self.dispatched, usable), self.carried.notifications)

    @cached_property
    def outbox(self) -> DataFrame:
        return delivery.outbox(self.deliveries, self.rules_table, self.templates)

    @cached_property
    def notifications(self) -> DataFrame:
        return delivery.audit(self.outbox)

    @cached_property
    def messages(self) -> DataFrame:
        return payloads.render(self.outbox)

    @cached_property
    def sub_states(self) -> DataFrame:
        return delivery.sub_states(self.dispatched, self.carried.sub_states)

    @cached_property
    def open_incidents(self) -> DataFrame:
        """Seeds for the next batch."""
        return self.stored_incidents.where("close is null").select(
            "incident_id", "rule_id", "open_at", "open_seq", "open_measure", "open_detail")


def plan_alerts(
    records: DataFrame,
    rules: Sequence[Rule],
    audience: Subscribers | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    max_span_ns: int | None = None,
    datasources: Datasources | None = None,
    sql_ticks: Sequence[datetime] = (),
    carried: Carried = Carried(),
    timeline: Timeline | None = None,
    samples: DataFrame | None = None,
    after: datetime | None = None,
    limits: JobLimits = JobLimits(),
) -> AlertPlan:
    """Evaluate rules over records and plan what to send.

    Event time is the clock: a record's ``when`` for push rules, the tick for scheduled rules, which run
    from ``start`` to ``end``. SQL rules run at ``sql_ticks``, or else at the ticks of their own schedule, as jobs of their own within
    ``limits`` (see :mod:`klaxon.operators.sqljobs`): what fails in one is its ``last_error`` and touches no other rule. An incremental run passes the ticks already
    done in ``after`` and, in ``samples``, the records its windows reach back to.
    """
    spark = records.sparkSession
    pushed = runnable(rules, PUSH, record_kind(records))
    if timeline is None:
        # A slice is sorted once per rule, so it holds fewer records when there are many rules.
        timeline = plan_timeline(records, max(20_000, ROWS_PER_SLICE // max(1, len(pushed))))
    parts, errors = [], None
    if pushed:
        parts.append(push_verdicts(records, rules, timeline))
    scheduled = runnable(rules, SCHEDULED)
    if any(not isinstance(r.condition, SqlReturnsRows) for r in scheduled) and start and end:
        parts.append(state.sliced(window_verdicts(records if samples is None else samples, rules, start, end, max_span_ns, after), timeline))
    if any(isinstance(r.condition, SqlReturnsRows) for r in scheduled) and datasources and (sql_ticks or start and end):
        due = sql_ticks or (lambda rule: ticks_of(rule, start, end, after))
        verdicts, errors = evaluate_sql_rules(datasources, rules, due, limits)
        parts.append(state.sliced(verdicts, timeline))
    if not parts:
        parts.append(push_verdicts(records, [], timeline))
    return AlertPlan(tuple(rules), tuple(parts), errors, timeline, config.rules_frame(spark, rules), audience, carried, record_kind(records))
