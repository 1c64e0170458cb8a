"""SQL rules as jobs of their own: failures, time limits, streams, and streams side by side."""

import threading
from datetime import timedelta

from pyspark.sql import functions as F

from klaxon import PatternMatch, Threshold, plan_alerts
from klaxon.model import SqlReturnsRows
from klaxon.operators.sqljobs import JobLimits, evaluate_sql_rules, ticks_of
from klaxon.operators.sqlrules import Datasources, sql_verdicts
from klaxon.session import local_table
from klaxon.sources.records import as_records
from klaxon.streaming.alert_stream import AlertStream

from support import SEC, at, audience, rule, subscription

DDL = "t timestamp, n bigint, v double, m string"


def warehouse(spark, n=40):
    rows = [(i, at(i), str(i) if i != 23 else "none") for i in range(n)]
    return Datasources(spark).register("db", {"readings": local_table(spark, rows, "id int, t timestamp, text string")})


def sql(rule_id, query, least=1, source="db", every=1.0):
    return rule(rule_id, condition=SqlReturnsRows(source, query, least), schedule_ns=int(every * SEC))


AT_TICK = "select 1 from {readings} where t = :tick and cast(text as int) >= 0"


def test_one_failing_rule_touches_no_other(spark):
    rules = [sql("good", "select 1 from {readings} where t <= :tick", 5), sql("once", "select * from {readings}", 40),
             sql("bad_once", "select * from {readings} where cast(text as int) > 5"), sql("bad_tick", AT_TICK),
             sql("wrong", "select nothing from {readings} where t < :tick"), sql("lost", "select 1", source="nowhere"),
             sql("lost_tick", "select 1 where :tick > date'2020-01-01'", source="nowhere"), rule("push")]
    ticks = [at(i) for i in range(20, 28)]
    verdicts, errors = evaluate_sql_rules(warehouse(spark), rules, ticks)
    got = {(r["rule_id"], r["seq"]): (r["triggered"], r["measure"]) for r in verdicts.collect()}
    assert {k: v for k, v in got.items() if k[0] == "good"} == {("good", i): (True, 21.0 + i) for i in range(8)}
    assert {k: v for k, v in got.items() if k[0] == "once"} == {("once", i): (True, 40.0) for i in range(8)}
    assert {k for k in got if k[0] == "bad_tick"} == {("bad_tick", i) for i in range(8) if i != 3}
    assert {k[0] for k in got} == {"good", "once", "bad_tick"}
    failed = {}
    for r in errors.collect():
        failed.setdefault(r["rule_id"], []).append(r["error"])
    assert {k: len(v) for k, v in failed.items()} == {"bad_once": 8, "bad_tick": 1, "wrong": 8, "lost": 8, "lost_tick": 8}
    assert all("none" in e and "INT" in e for e in failed["bad_once"] + failed["bad_tick"])
    assert all("nothing" in e for e in failed["wrong"]) and all("nowhere" in e for e in failed["lost"] + failed["lost_tick"])


def test_equal_to_the_planned_form_where_nothing_fails(spark):
    rules = [sql("good", "select 1 from {readings} where t <= :tick", 5), sql("all", "select 1 from {readings}", 41)]
    ticks = [at(i) for i in range(-2, 9, 2)]
    columns = ("rule_id", "now", "seq", "triggered", "measure")
    both = [sorted(map(tuple, run(warehouse(spark), rules, ticks)[0].select(*columns).collect())) for run in (evaluate_sql_rules, sql_verdicts)]
    assert both[0] == both[1] and len(both[0]) == 12
    verdicts, errors = evaluate_sql_rules(warehouse(spark), rules, [])
    assert verdicts.count() == errors.count() == 0


def test_a_slow_rule_is_cancelled(spark):
    slow = spark.range(0, 400, 1, 4).select("id", F.reflect(F.lit("java.lang.Thread"), F.lit("sleep"), F.lit(50).cast("bigint")).alias("z"))
    sources = warehouse(spark).register("slow", {"naps": slow})
    rules = [sql("slow", "select 1 from {naps} where z is null or z = 'x'", source="slow"), sql("quick", "select 1 from {readings}")]
    verdicts, errors = evaluate_sql_rules(sources, rules, [at(0)], JobLimits(timedelta(seconds=2)))
    assert [r["rule_id"] for r in verdicts.collect()] in (["quick"], [])
    assert [(r["rule_id"], r["error"]) for r in errors.where("rule_id = 'slow'").collect()] == [("slow", "no result within 2 s")]


def test_ticks_of_a_schedule():
    r = sql("r", "select 1", every=10)
    assert ticks_of(r, at(0), at(35)) == [at(0), at(10), at(20), at(30)]
    assert ticks_of(r, at(0), at(40), at(20)) == [at(30), at(40)]
    assert ticks_of(r, at(0), at(-1)) == [] and ticks_of(r, at(5), at(40), at(0)) == [at(5), at(15), at(25), at(35)]


def test_state_and_last_error_of_a_plan(spark):
    rules = [sql("tick", AT_TICK), sql("bad", "select * from {readings} where cast(text as int) > 5"),
             rule("odd", condition=PatternMatch("m", "regex", "(")), rule("hi", condition=Threshold("v", ">", 5))]
    records = as_records(local_table(spark, [(at(i), i, float(i), "x") for i in range(10)], DDL), "t", "n")
    plan = plan_alerts(records, rules, start=at(20), end=at(25), datasources=warehouse(spark))
    states = {r["rule_id"]: (r["state"], r["last_error"]) for r in plan.live_states.collect()}
    assert states["hi"] == ("firing", None) and states["tick"][0] == "firing" and "none" in states["tick"][1]
    assert states["bad"][0] == "ok" and "none" in states["bad"][1]
    assert plan.incidents.where("rule_id = 'tick'").count() == 1  # the failed tick between did not close it
    assert [r["rule_id"] for r in plan.skipped.collect()] == ["odd"]


def test_streams_run_sql_rules_side_by_side(spark, tmp_path):
    """Two streams in one session, each in its own thread, over the same data as one batch run."""
    rules = [sql("tick", AT_TICK, every=2), rule("hi", condition=Threshold("v", ">", 5))]
    who = audience(spark, [subscription("a", rule_id="tick"), subscription("b", rule_id="hi", repeat=4)])
    data = [(at(i), i, float(i * 7 % 11), "x") for i in range(36)]
    sources = Datasources(spark).register("db", {"readings": lambda: warehouse(spark).rows("db", "select * from {readings}")})
    streams = [AlertStream(str(tmp_path / f"s{i}"), rules, who, at(0), datasources=sources) for i in range(2)]
    problems = []

    def feed(stream, size):
        try:
            for i, low in enumerate(range(0, len(data), size)):
                stream.process(as_records(local_table(spark, data[low:low + size], DDL), "t", "n"), i)
        except Exception as err:
            problems.append(err)

    threads = [threading.Thread(target=feed, args=(s, size)) for s, size in zip(streams, (12, 18))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not problems
    batch = plan_alerts(as_records(local_table(spark, data, DDL), "t", "n"), rules, who, at(0), data[-1][0], datasources=sources)
    columns = ("id", "rule_id", "triggered_at", "resolved_at", "last_value")
    rows = lambda df, names: sorted(map(tuple, df.select(*names).collect()), key=str)
    want = rows(batch.incidents, columns)
    notes = ("incident_id", "subscription_id", "kind", "sent_at")
    for stream in streams:
        assert rows(stream.incidents(spark), columns) == want
        assert rows(stream.table(spark, "notifications"), notes) == rows(batch.notifications, notes)
    assert not set(streams[0]._scratch) & set(streams[1]._scratch) and all(s._scratch for s in streams)
