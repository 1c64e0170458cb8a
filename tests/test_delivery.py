import random

import pytest
from pyspark.sql import functions as F

from klaxon.operators import delivery, matching, state
from klaxon.operators.timeline import plan_timeline
from klaxon.plans.alerting import Carried
from klaxon.session import local_table

from support import T0, at, audience, plan_of, rule, sent, subscription

R = [rule("r", {"team": "ops"})]


def ticks(*pairs, rule_id="r"):
    return [(rule_id, s, i, t) for i, (s, t) in enumerate(pairs)]


def run(spark, pairs, **settings):
    who = audience(spark, [subscription("s", rule_id="r", **settings)])
    return [(t, k) for _, t, k in sent(plan_of(spark, ticks(*pairs), R, who))]


def test_one_firing_notice_per_incident(spark):
    assert run(spark, [(i / 10, True) for i in range(5)]) == [(0.0, "firing")]


def test_fires_again_after_resolution(spark):
    assert run(spark, [(0, True), (1, False), (2, True)]) == [(0, "firing"), (1, "resolved"), (2, "firing")]


def test_dwell(spark):
    assert run(spark, [(0, True), (30, True), (121, True)], dwell=120) == [(121, "firing")]
    assert run(spark, [(0, True), (60, False)], dwell=300) == []


def test_repeat(spark):
    assert run(spark, [(60 * i, True) for i in range(4)], repeat=60) == [
        (0, "firing"), (60, "repeat"), (120, "repeat"), (180, "repeat")]
    assert run(spark, [(t, True) for t in (0, 50, 70, 120, 130)], repeat=60) == [
        (0, "firing"), (70, "repeat"), (130, "repeat")]


def test_resolve_flag(spark):
    assert run(spark, [(0, True), (1, False)], resolve=True) == [(0, "firing"), (1, "resolved")]
    assert run(spark, [(0, True), (1, False)], resolve=False) == [(0, "firing")]


def test_one_shot_sends_all_bindings_once(spark):
    people = [("p", "P", [("mail", "a"), ("hook", "http://h"), ("nope", "x")], None, None)]
    channels = [("mail", "smtp", ""), ("hook", "slack", "")]
    who = audience(spark, [subscription("s", rule_id="r", once=True, repeat=0.1)], people, channels)
    plan = plan_of(spark, ticks((0, True), (1, True), (2, False), (3, True)), R, who)
    rows = plan.notifications.collect()
    assert sorted((r["channel"], r["kind"]) for r in rows) == [("hook", "firing"), ("mail", "firing")]
    again = plan_of(spark, ticks((9, True)), R, who, carried=Carried(notifications=plan.notifications))
    assert again.notifications.count() == 0
    states = {r["notify_count"] for r in plan.sub_states.collect()}
    assert states == {2, 1}  # counts advance although later sends were suppressed


def test_delivery_without_bindings_keeps_the_shot(spark):
    people = [("p", "P", [("nope", "x")], None, None)]
    who = audience(spark, [subscription("s", rule_id="r", once=True)], people)
    assert plan_of(spark, ticks((0, True)), R, who).notifications.count() == 0


def test_missing_subscriber_filter_unknown_channel_and_failures(spark):
    people = [("p", "P", [("mail", "a"), ("hook", ""), ("nope", "x")], None, None)]
    channels = [("mail", "smtp", ""), ("hook", "slack", "")]
    who = audience(spark, [subscription("gone", "ghost", "r"), subscription("all", "p", "r"),
                           subscription("some", "p", "r", only=["mail"])], people, channels)
    plan = plan_of(spark, ticks((0, True)), R, who)
    got = sorted((r["subscription_id"], r["channel"], r["status"]) for r in plan.notifications.collect())
    assert got == [("all", "hook", "error"), ("all", "mail", "ok"), ("some", "mail", "ok")]
    counters = {r["subscription_id"]: tuple(r)[1:] for r in
                delivery.delivery_counters(plan.deliveries, plan.outbox).collect()}
    assert counters == {"all": (1, 1, 1), "some": (1, 0, 2)}
    assert [r["subscription_id"] for r in delivery.missing_subscribers(who.subscriptions, who.subscribers).collect()] == ["gone"]

    def refuse(message):
        raise RuntimeError("down " + message["channel"])

    results = {(r["channel"], r["status"], r["error"]) for r in delivery.deliver(plan.outbox, refuse).collect()}
    assert ("mail", "error", "down mail") in results and ("hook", "error", "slack: no webhook url configured") in results


def test_label_matching(spark):
    rules = local_table(spark, [("r1", {"team": "ops"}), ("r2", {"team": "ops", "env": "prod"}), ("r3", {}), ("r4", None),
                                ("r5", {"env": ""})], "id string, labels map<string,string>")
    subs = audience(spark, [
        subscription("direct", rule_id="r1"), subscription("ops", selector={"team": "ops"}),
        subscription("billing", selector={"team": "billing"}), subscription("empty", selector={}),
        subscription("both", selector={"team": "ops", "env": "prod"}), subscription("no-env", selector={"env": ""}),
        subscription("ops-no-env", selector={"team": "ops", "env": ""})]).subscriptions
    got = sorted((r["subscription_id"], r["rule_id"]) for r in matching.match_subscriptions(rules, subs).collect())
    assert got == [("both", "r2"), ("direct", "r1"), ("no-env", "r1"), ("no-env", "r3"), ("no-env", "r4"), ("no-env", "r5"),
                   ("ops", "r1"), ("ops", "r2"), ("ops-no-env", "r1")]


def test_payload_trigger_time_is_send_time(spark):
    who = audience(spark, [subscription("s", rule_id="r", dwell=60)])
    row = plan_of(spark, ticks((0, True), (90, True)), R, who).outbox.select(
        F.unix_seconds("triggered_at"), F.unix_seconds("incident_triggered_at")).first()
    assert [v - T0.timestamp() for v in row] == [90, 0]


def simulate(ticks, policies):
    """The sequential meaning: one state per rule, one clock per incident and subscription."""
    out, incidents = [], []
    ms = lambda s: int(round(s * 1e6)) // 1000 * 1000
    us = lambda s: int(round(s * 1e6))
    firing, told = {}, {}
    for rule_id, now, seq, triggered in sorted(ticks, key=lambda t: (t[1], t[2])):
        if triggered is None:
            continue
        opened = closed = False
        if triggered and rule_id not in firing:
            firing[rule_id], opened = (now, seq), True
            incidents.append([rule_id, us(now), None])
        start = firing.get(rule_id)
        if not triggered and start is not None:
            closed = True
            next(i for i in reversed(incidents) if i[0] == rule_id)[2] = us(now)
            del firing[rule_id]
        if start is None:
            continue
        for sub, (for_rule, dwell, repeat, resolve) in policies.items():
            if for_rule != rule_id:
                continue
            key = (rule_id, start, sub)
            if closed:
                if key in told and resolve:
                    out.append((sub, us(now), "resolved"))
                continue
            waited = 0 if opened else us(now) - ms(start[0])
            if waited < us(dwell):
                continue
            if key not in told:
                out.append((sub, us(now), "firing"))
            elif repeat > 0 and us(now) - told[key] >= us(repeat):
                out.append((sub, us(now), "repeat"))
            else:
                continue
            told[key] = ms(now)
    return sorted(out), sorted((r, a, -1 if b is None else b) for r, a, b in incidents)


def random_world(seed):
    rng = random.Random(seed)
    rules, data, policies, subs = [], [], {}, []
    for n in range(8):
        rid = f"r{n}"
        rules.append(rule(rid))
        now, state_now = 0.0, False
        for seq in range(150):
            now += rng.choice([0, 0.0004, 0.0007, 0.25, 1, 1, 3.0005])
            if rng.random() < (0.08 if n % 2 else 0.4):
                state_now = not state_now
            data.append((rid, now, seq, None if rng.random() < 0.05 else state_now))
        for k in range(4):
            sub = f"{rid}-s{k}"
            policies[sub] = (rid, rng.choice([0, 0, 1, 2.5, 0.0003]), rng.choice([0, 1, 2, 3.0007]), rng.random() < 0.7)
            subs.append(subscription(sub, rule_id=rid, dwell=policies[sub][1], repeat=policies[sub][2], resolve=policies[sub][3]))
    return rules, data, policies, subs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_histories_equal_the_sequential_meaning(spark, seed):
    rules, data, policies, subs = random_world(seed)
    want, want_incidents = simulate(data, policies)
    who = audience(spark, subs)
    base = int(T0.timestamp() * 1e6)
    good = [t for t in data if t[3] is not None]
    cuts = random.Random(seed).sample(sorted((base + int(round(s * 1e6)), q) for _, s, q, _ in good), 12)
    for bounds in ((), sorted(set(cuts))):
        plan = plan_of(spark, good, rules, who, bounds)
        got = sorted((r["subscription_id"], r["us"] - base, r["kind"]) for r in plan.dispatched.selectExpr(
            "subscription_id", "kind", "unix_micros(now) as us").collect())
        assert got == want
        incidents = sorted((r[0], r[1] - base, -1 if r[2] is None else r[2] - base) for r in plan.incident_rows.selectExpr(
            "rule_id", "unix_micros(open_at)", "unix_micros(close.now)").collect())
        assert incidents == want_incidents


def test_slices_split_a_burst_with_one_timestamp(spark):
    rows = spark.range(3000).selectExpr(
        "'events' input_ref", "case when id < 2000 then timestamp'2024-01-01' else timestamp_seconds(1704067200 + id) end when",
        "id seq", "named_struct('v', id) record")
    timeline = plan_timeline(rows, rows_per_slice=500)
    sizes = [r["count"] for r in rows.groupBy(timeline.slice_of(F.col("when"), F.col("seq"))).count().collect()]
    assert timeline.slices >= 5 and len(sizes) == timeline.slices and max(sizes) < 1200
    order = rows.select("when", "seq", timeline.slice_of(F.col("when"), F.col("seq")).alias("s")).orderBy("when", "seq").collect()
    assert [r["s"] for r in order] == sorted(r["s"] for r in order)


def test_live_states_and_errors(spark):
    who = audience(spark, [])
    plan = plan_of(spark, ticks((0, True), (5, True)) + ticks((0, True), (6, False), rule_id="q"), R + [rule("q")], who)
    got = {r["rule_id"]: (r["state"], r["incident_id"] is not None, r["last_value"]) for r in plan.live_states.collect()}
    assert got == {"r": ("firing", True, "1 > 0"), "q": ("ok", False, "1 > 0")}
    errors = local_table(spark, [("r", at(9), "boom"), ("r", at(7), "older"), ("new", at(1), "lost")],
                         "rule_id string, now timestamp, error string")
    merged = state.live_states(state.last_verdicts(plan.verdicts), plan.incident_rows, plan.templates, errors, plan.live_states)
    got = {r["rule_id"]: (r["state"], r["last_error"], r["last_eval_at"].timestamp() - T0.timestamp()) for r in merged.collect()}
    assert got["r"] == ("firing", "boom", 9) and got["new"] == ("ok", "lost", 1) and got["q"] == ("ok", None, 6)
    # A later good tick does not clear the text.
    later = plan_of(spark, ticks((20, False)), R, who, carried=Carried(live_states=merged))
    assert {r["rule_id"]: r["last_error"] for r in later.live_states.collect()}["r"] == "boom"


def test_end_to_end_from_json(spark):
    from klaxon import PatternMatch, Threshold, plan_alerts
    from support import json_records

    level = rule("lvl", condition=PatternMatch("level", "contains", "ERROR"))
    total = rule("big", condition=Threshold("total", ">", 1000))
    bodies = ['{"level":"ERROR"}'] * 3 + ['{"level":"INFO"}']
    who = audience(spark, [subscription("a", rule_id="lvl"), subscription("b", rule_id="big", resolve=False)])
    plan = plan_alerts(json_records(spark, list(enumerate(bodies))), [level, total], who)
    assert sent(plan) == [("a", 0.0, "firing"), ("a", 3.0, "resolved")]
    orders = ['{"total":%s}' % v for v in (49.99, 500, 1500, 50, 2000)]
    plan = plan_alerts(json_records(spark, list(enumerate(orders))), [level, total], who)
    assert sent(plan) == [("b", 2.0, "firing"), ("b", 4.0, "firing")]
    assert [r["last_value"] for r in plan.incidents.orderBy("triggered_at").collect()] == ["1500 > 1000", "2000 > 1000"]
