import random
from datetime import timedelta

import pytest

from klaxon import Expression, PatternMatch, Threshold, WindowAggregate, plan_alerts
from klaxon.sources.records import as_records
from klaxon.session import local_table
from klaxon.streaming.alert_stream import AlertStream, deduplicated, verdict_stream

from support import SEC, at, audience, rule, subscription

DDL = "t timestamp, n bigint, v double, m string"
RULES = [rule("hi", {"team": "ops"}, Threshold("v", ">", 5)), rule("err", condition=PatternMatch("m", "contains", "e")),
         rule("win", condition=WindowAggregate("v", "max", 20 * SEC, ">", 7), schedule_ns=5 * SEC)]


def people(spark):
    return audience(spark, [
        subscription("now", rule_id="hi"), subscription("slow", selector={"team": "ops"}, dwell=3, repeat=6),
        subscription("once", rule_id="err", once=True), subscription("win", rule_id="win", repeat=10)])


def rows(n, seed=3):
    rng = random.Random(seed)
    out, hot = [], False
    for i in range(n):
        hot = hot ^ (rng.random() < 0.15)
        out.append((at(i * 1.25), i, rng.uniform(5.5, 9) if hot else rng.uniform(0, 5), rng.choice(["err", "ok", "ok"])))
    return out


def keys(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_stream_equals_batch(spark, tmp_path):
    data = rows(120)
    src, schema = tmp_path / "in", local_table(spark, [], DDL).schema
    src.mkdir()
    for i in range(4):
        part = data[i * 30:(i + 1) * 30]
        local_table(spark, part, DDL).coalesce(1).write.json(str(tmp_path / f"w{i}"))
        name = next((tmp_path / f"w{i}").glob("*.json"))
        (src / f"{i}.json").write_text(name.read_text())
    who = people(spark)
    stream = AlertStream(str(tmp_path / "state"), RULES, who, at(0))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = (as_records(source, "t", "n").writeStream.foreachBatch(lambda df, i: stream.process(df, i) and None)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert q.awaitTermination(300)
    records = as_records(local_table(spark, data, DDL), "t", "n")
    batch = plan_alerts(records, RULES, who, at(0), data[-1][0])
    columns = ("id", "rule_id", "triggered_at", "resolved_at", "last_value")
    assert keys(stream.incidents(spark), *columns) == keys(batch.incidents, *columns)
    note = ("incident_id", "subscription_id", "kind", "sent_at")
    assert keys(stream.table(spark, "notifications"), *note) == keys(batch.notifications, *note)
    # A replayed batch overwrites its own results.
    before = stream.table(spark, "notifications").count()
    stream.process(as_records(local_table(spark, data[90:], DDL), "t", "n"), 3)
    assert stream.table(spark, "notifications").count() == before


@pytest.mark.parametrize("scheduled", [
    [rule("short", condition=WindowAggregate("v", "max", 60 * SEC, ">", 100), schedule_ns=60 * SEC),
     rule("long", condition=Expression('count_over("v", "10m") >= 3', "scheduled"), schedule_ns=60 * SEC)],
    [rule("days", condition=Expression('count_over("v", "3d") >= 3', "scheduled"), schedule_ns=12 * 3600 * SEC)],
])
def test_stream_keeps_what_expressions_read(spark, tmp_path, scheduled):
    step = 240 if len(scheduled) == 2 else 86_400
    data = [(at(i * step), i, 1.0, "") for i in range(5)]
    who = audience(spark, [subscription("s", rule_id=scheduled[-1].id)])
    stream = AlertStream(str(tmp_path / "s"), scheduled, who, at(0))
    for i, row in enumerate(data):
        stream.process(as_records(local_table(spark, [row], DDL), "t", "n"), i)
    batch = plan_alerts(as_records(local_table(spark, data, DDL), "t", "n"), scheduled, who, at(0), data[-1][0])
    columns = ("id", "rule_id", "triggered_at", "resolved_at")
    assert batch.incidents.count() and keys(stream.incidents(spark), *columns) == keys(batch.incidents, *columns)


def test_late_and_waiting_records(spark, tmp_path):
    stream = AlertStream(str(tmp_path / "s"), RULES[:1], people(spark), at(0), delay=timedelta(seconds=10))
    batch = lambda *seconds: as_records(local_table(spark, [(at(s), s, 9.0 if s == 12 else 0.0, "") for s in seconds], DDL), "t", "n")
    stream.process(batch(0, 20, 15), 0)
    assert sorted(r["seq"] for r in stream.table(spark, "pending", 0).collect()) == [15, 20]
    stream.process(batch(12, 5, 24), 1)   # 12 is in time, 5 is older than the watermark (10)
    assert [(r["seq"], r["reason"]) for r in stream.table(spark, "quarantine", 1).collect()] == [(5, "late")]
    stream.process(batch(), 2, final=True)
    got = stream.incidents(spark).selectExpr("unix_seconds(triggered_at)", "unix_seconds(resolved_at)").collect()
    assert [tuple(v - int(at(0).timestamp()) for v in r) for r in got] == [(12, 15)]


def test_stateless_stream_and_dedup(spark, tmp_path):
    local_table(spark, rows(20) + rows(20)[:5], DDL).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(local_table(spark, [], DDL).schema).parquet(str(tmp_path / "in"))
    out = verdict_stream(deduplicated(as_records(source, "t", "n"), "1 hour"), RULES[:2])
    q = out.writeStream.format("memory").queryName("verdict_rows").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("verdict_rows").count() == 40
