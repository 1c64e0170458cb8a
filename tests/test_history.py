import json
from datetime import datetime, timedelta, timezone

import pytest

from klaxon.operators import config, history, payloads, retention
from klaxon.operators.sqlrules import Datasources, sql_verdicts
from klaxon import SqlReturnsRows
from klaxon.session import local_table

from support import at, audience, plan_of, rule, subscription, T0

INCIDENTS = "id string, rule_id string, triggered_at timestamp, resolved_at timestamp, last_value string"
NOTES = ("id string, incident_id string, subscription_id string, subscriber_id string, channel string, address string, "
         "kind string, sent_at timestamp, status string, error string")


def ms(n):
    return datetime.fromtimestamp(n / 1000, timezone.utc)


def tables(spark):
    incidents = local_table(spark, [("old", "r", ms(1_000_000), ms(1_001_000), "v"), ("firing", "r", ms(1_000_000), None, ""),
                                    ("new", "q", ms(3_000_000), ms(3_001_000), "")], INCIDENTS)
    notes = local_table(spark, [(f"n-{i}-{k}", i, "s", "p", "mail", "a", k, ms(t), "ok", "") for i, k, t in (
        ("old", "firing", 1_000_000), ("old", "resolved", 1_001_000), ("new", "firing", 3_000_000))], NOTES)
    states = local_table(spark, [("old", "s"), ("new", "s")], "incident_id string, subscription_id string")
    return retention.History(incidents, notes, states)


def test_retention(spark, tmp_path):
    h, cutoff = tables(spark), ms(2_500_000)
    kept = retention.keep(h, cutoff)
    assert sorted(r["id"] for r in kept.incidents.collect()) == ["firing", "new"]
    assert [r["incident_id"] for r in kept.notifications.collect()] == ["new"]
    assert [r["incident_id"] for r in kept.sub_states.collect()] == ["new"]
    assert dict(retention.counts(h, cutoff).collect()) == {"incidents": 1, "notifications": 2, "incident_sub_states": 1}
    assert retention.candidates(h.incidents, ms(1_001_000)).count() == 0  # strictly before
    folder = str(tmp_path / "archive")
    result = retention.prune(h, timedelta(seconds=500), ms(3_000_000), folder)
    assert result.incidents.count() == 2
    lines = [json.loads(r["value"]) for r in spark.read.text(folder).collect()]
    assert len(lines) == 1 and lines[0]["incident"]["id"] == "old"
    assert [n["kind"] for n in lines[0]["notifications"]] == ["firing", "resolved"]
    assert retention.prune(h, timedelta(0), ms(0)) is None
    seen = []
    (tmp_path / "file").write_text("x")
    assert retention.prune(h, timedelta(seconds=500), ms(3_000_000), str(tmp_path / "file"), seen.append).incidents.count() == 2
    assert len(seen) == 1


def test_lists_and_drilldown(spark):
    h = tables(spark)
    assert [r["id"] for r in history.recent_incidents(h.incidents, 2).collect()] == ["new", "firing"]
    assert [r["id"] for r in history.recent_incidents(h.incidents, 0, "q").collect()] == ["new"]
    row = history.incident_drilldown(h.incidents, h.notifications, "old").first()
    assert row["status"] == "resolved" and [n["kind"] for n in row["notifications"]] == ["firing", "resolved"]
    assert history.incident_drilldown(h.incidents, h.notifications, "firing").first()["notifications"] == []
    assert [history.parse_limit(x) for x in (None, "", "abc", "-1", "7", "5000")] == [100, 100, 100, 100, 7, 1000]


def test_export(spark, tmp_path):
    h = tables(spark)
    now = ms(3_600_000)
    since = history.parse_since("10m", now)
    rows = {r["id"]: tuple(r) for r in history.export_incidents(h.incidents, since).collect()}
    assert rows == {"new": ("new", "q", "1970-01-01T00:50:00Z", "1970-01-01T00:50:01Z", "")}
    assert history.export_incidents(h.incidents, history.parse_since("1970-01-01T00:50:00Z", now)).count() == 1
    assert history.export_incidents(h.incidents, rule_id="r").count() == 2 and history.parse_since(" ", now) is None
    for bad in ("-5m", "yesterday", "2024-01-01"):
        with pytest.raises(ValueError):
            history.parse_since(bad, now)
    history.write_export(h.incidents, str(tmp_path / "csv"), "csv", rule_id="r")
    text = "".join(r["value"] + "\n" for r in spark.read.text(str(tmp_path / "csv")).collect())
    assert text.startswith("id,rule_id,triggered_at,resolved_at,last_value") and "firing,r,1970-01-01T00:16:40Z,," in text
    with pytest.raises(ValueError):
        history.write_export(h.incidents, str(tmp_path / "x"), "xml")


def test_config_changes(spark):
    ddl = "id string, name string, created_at timestamp, updated_at timestamp"
    base = local_table(spark, [("a", "a0", at(0), at(0)), ("b", "b0", at(0), at(0))], ddl)
    log = [("a", "create", 1, "a1"), ("a", "update", 2, "a2"), ("b", "delete", 3, ""), ("b", "update", 4, "b?"),
           ("b", "create", 5, "b5"), ("c", "update", 6, "c?"), ("d", "create", 7, "d7"), ("d", "create", 8, "d8"),
           ("e", "create", 9, "e9"), ("e", "delete", 10, "")]
    changes = local_table(spark, [(i, op, v, at(v), n) for i, op, v, n in log],
                          "id string, op string, version bigint, at timestamp, name string")
    rows = {r["id"]: (r["name"], r["created_at"].timestamp() - T0.timestamp(), r["updated_at"].timestamp() - T0.timestamp())
            for r in config.apply_changes(base, changes).collect()}
    assert rows == {"a": ("a2", 0, 2), "b": ("b5", 5, 5), "d": ("d7", 7, 7)}
    assert sorted(map(tuple, config.rejected_creates(base, changes).collect())) == [("a", 1), ("d", 8)]


def test_rule_and_subscription_tables(spark):
    spec = lambda **kw: json.dumps(kw)
    rows = [("ok", "n", "", True, "info", {}, "events", ("threshold", spec(field="v", op=">", value=1)), 0, None, None),
            ("re", "n", "", True, "info", {}, "events", ("pattern_match", spec(field="m", kind="regex", pattern="a(?=b)")), 0, None, None),
            ("sched", "n", "", True, "x", {}, "events", ("window_aggregate", spec(field="v", agg="avg", window=5, op="<", value=1)), 0, None, None),
            ("what", "", "", True, "", {}, "", ("nope", "{}"), 0, None, None)]
    rules = config.table(spark, "rules", rows)
    errors = {r["id"]: r["errors"] for r in config.validate_rules(rules).collect()}
    assert errors["ok"] == [] and errors["re"][0].startswith("pattern_match: look-around")
    assert errors["sched"] == ["a scheduled rule needs a schedule above zero", "unknown severity"]
    assert errors["what"] == ["a rule needs a name", "a rule needs an input", "unknown condition type nope"]
    loaded = {r.id: r for r in config.load_rules(rules)}
    assert loaded["ok"].errors() == [] and loaded["what"].condition is None and loaded["re"].errors()
    subs = audience(spark, [subscription("ok", rule_id="r"), subscription("none"), subscription("two", rule_id="r", selector={"a": "b"}),
                            subscription("neg", rule_id="r", dwell=-1), subscription("who", subscriber="", rule_id="r")]).subscriptions
    bad = {r["id"]: len(r["errors"]) for r in config.validate_subscriptions(subs).collect()}
    assert bad == {"ok": 0, "none": 1, "two": 1, "neg": 1, "who": 1}


def test_sql_rules(spark):
    sources = Datasources(spark).register("db", {"errors": local_table(spark, [(1,), (2,), (3,)], "id int")})
    rules = [rule("rows", condition=SqlReturnsRows("db", "select * from {errors}"), schedule_ns=1),
             rule("few", condition=SqlReturnsRows("db", "select * from {errors} where id > 2", 2), schedule_ns=1),
             rule("lost", condition=SqlReturnsRows("nope", "select 1"), schedule_ns=1),
             rule("bad", condition=SqlReturnsRows("db", "select x from {errors}"), schedule_ns=1)]
    verdicts, errors = sql_verdicts(sources, rules, [at(0)])
    assert {r["rule_id"]: (r["triggered"], r["measure"]) for r in verdicts.collect()} == {"rows": (True, 3.0), "few": (False, 1.0)}
    assert sorted(r["rule_id"] for r in errors.collect()) == ["bad", "lost"]


def test_sms_is_cut_at_a_whole_character(spark):
    who = audience(spark, [subscription("s", rule_id="r")], [("p", "P", [("text", "+1")], None, None)], [("text", "sms", "")])
    for pad in range(4):
        r = rule("r", description="x" * pad + "é" * 400)
        body = plan_of(spark, [("r", 0, 0, True)], [r], who).messages.first()["payload"]
        raw = body.encode()
        assert body.endswith("…") and 478 <= len(raw) <= 480 and body.startswith("[INFO/FIRING] r — 1 > 0 — ")


def test_channel_registration_and_brand(spark):
    payloads.register_channel("log", lambda: payloads.email_subject())
    who = audience(spark, [subscription("s", rule_id="r")], [("p", "P", [("l", "x")], None, None)], [("l", "log", "")])
    plan = plan_of(spark, [("r", 0, 0, True)], [rule("r", severity="critical")], who)
    assert plan.messages.first()["payload"] == "[FIRING] CRITICAL: r"
    assert '"dedup_key":"acme:' in plan.outbox.select(payloads.pagerduty("acme").alias("p")).first()["p"]
