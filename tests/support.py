"""Fixtures in code: small records, verdicts and audiences."""

from datetime import datetime, timedelta, timezone

from klaxon import AlertPlan, Rule, Subscribers, Threshold
from klaxon.operators import config, state
from klaxon.operators.timeline import Timeline
from klaxon.session import local_table

T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)
SEC = 10**9


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def json_records(spark, rows, input_ref="events"):
    """(seconds, body) pairs as JSON records."""
    from klaxon.sources.records import decode_json

    data = [(input_ref, at(s), i, body) for i, (s, body) in enumerate(rows)]
    return decode_json(local_table(spark, data, "input_ref string, when timestamp, seq bigint, body string"))


def rule(rule_id="r", labels=None, condition=None, **kw) -> Rule:
    return Rule(rule_id, rule_id, "events", condition or Threshold("v", ">", 0), labels=labels or {}, **kw)


def subscription(sub_id, subscriber="p", rule_id=None, selector=None, dwell=0.0, repeat=0.0, resolve=True, once=False,
                 only=None):
    return (sub_id, subscriber, rule_id, selector, int(dwell * SEC), int(repeat * SEC), resolve, once, only, None, None)


def audience(spark, subscriptions, people=(("p", "P", [("mail", "p@x")], None, None),), channels=(("mail", "smtp", ""),)):
    return Subscribers(config.table(spark, "subscriptions", subscriptions), config.table(spark, "subscribers", people),
                       config.table(spark, "channels", channels))


def plan_of(spark, ticks, rules, who, bounds=(), carried=None) -> AlertPlan:
    """A plan over ready-made verdicts: (rule_id, seconds, seq, triggered)."""
    rows = [(r, at(s), q, t, 1.0, None) for r, s, q, t in ticks]
    verdicts = local_table(spark, rows, "rule_id string, now timestamp, seq bigint, triggered boolean, measure double, "
                                        "detail string")
    timeline = Timeline(tuple(bounds))
    extra = {} if carried is None else {"carried": carried}
    return AlertPlan(tuple(rules), (state.sliced(verdicts, timeline),), None, timeline,
                     config.rules_frame(spark, rules), who, **extra)


def sent(plan):
    """(subscription, kind, seconds since T0) of every dispatch, in order."""
    rows = plan.dispatched.selectExpr("subscription_id", "kind", "unix_micros(now) as us", "rule_id").collect()
    base = int(T0.timestamp() * 1_000_000)
    return sorted((r["subscription_id"], (r["us"] - base) / 1e6, r["kind"]) for r in rows)
