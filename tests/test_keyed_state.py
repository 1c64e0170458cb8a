import random

import pytest

from klaxon import PatternMatch, Threshold, plan_alerts
from klaxon.session import local_table
from klaxon.sources.records import as_records
from klaxon.streaming import keyed_state

from support import at, audience, rule, subscription

DDL = "t timestamp, n bigint, v double, m string"
RULES = [rule("hi", {"team": "ops"}, Threshold("v", ">", 5)), rule("err", condition=PatternMatch("m", "contains", "e"))]


def people(spark):
    return audience(spark, [
        subscription("now", rule_id="hi"), subscription("slow", selector={"team": "ops"}, dwell=3, repeat=6),
        subscription("quiet", rule_id="hi", dwell=2, resolve=False), subscription("often", rule_id="err", repeat=2.5)])


def rows(n, seed):
    rng, out, hot = random.Random(seed), [], False
    for i in range(n):
        hot = hot ^ (rng.random() < 0.15)
        out.append((at(i * 0.4 + rng.choice([0, 0.0004, 0.2])), i, rng.uniform(5.5, 9) if hot else rng.uniform(0, 5), rng.choice(["err", "ok", "err"])))
    return out


def run(spark, folder, parts, plan, delay):
    src = folder / "in"
    src.mkdir()
    for i, part in enumerate(parts):
        local_table(spark, part, DDL).coalesce(1).write.parquet(str(folder / f"w{i}"))
        (src / f"{i}.parquet").write_bytes(next((folder / f"w{i}").glob("*.parquet")).read_bytes())
    source = spark.readStream.schema(local_table(spark, [], DDL).schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    stream = keyed_state.rule_events(as_records(source, "t", "n"), RULES, keyed_state.policies_of(plan.policies), delay)
    q = (stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp"))
         .outputMode("append").trigger(availableNow=True).start())
    assert q.awaitTermination(300)
    return spark.read.parquet(str(folder / "out")), q


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed_state.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_events_equal_one_batch(spark, tmp_path, rocksdb):
    data = rows(160, 5)
    plan = plan_alerts(as_records(local_table(spark, data, DDL), "t", "n"), RULES, people(spark))
    # within a delay of 5 seconds records come in any order; the last file only moves the watermark
    rng, shuffled = random.Random(1), []
    for start in range(0, 160, 10):
        shuffled += rng.sample(data[start:start + 10], len(data[start:start + 10]))
    parts = [shuffled[i:i + 40] for i in range(0, 160, 40)] + [[(at(5000), 10_000, None, None)]]
    events, q = run(spark, tmp_path, parts, plan, "5 seconds")
    keys = ("incident_id", "subscription_id", "kind", "now", "seq")
    got = keyed_state.dispatches(events, plan.policies)
    want = plan.dispatched.where("now < timestamp'2024-05-01 01:00:00'")
    flat = lambda df: sorted((tuple(r) for r in df.select(*keys).collect()), key=str)
    assert flat(got) == flat(want) and {r["kind"] for r in got.collect()} == {"firing", "repeat", "resolved"}
    opened = events.where("kind = 'open'").selectExpr("incident_id", "date_trunc('millisecond', now)")
    assert sorted(map(tuple, opened.collect())) == sorted(map(tuple, plan.incidents.select("id", "triggered_at").collect()))
    assert events.where("kind = 'late'").count() == 0
    # the state holds a few values a rule, whatever the number of records
    assert q.lastProgress.stateOperators[0].numRowsTotal < 40


def test_late_ticks_change_nothing(spark, tmp_path, rocksdb):
    data = [(at(s), int(s), 9.0 if s in (10, 11, 3) else 0.0, "") for s in (0, 10, 11, 30, 60)]
    plan = plan_alerts(as_records(local_table(spark, data, DDL), "t", "n"), RULES[:1], people(spark))
    events, _ = run(spark, tmp_path, [[d] for d in data[:4]] + [[data[4]], [(at(3), 3, 9.0, "")], [(at(5000), 10_000, None, None)]], plan, "1 second")
    opened = events.where("kind = 'open' and rule_id = 'hi'").collect()
    assert [r["seq"] for r in opened] == [10]
    assert events.where("kind = 'close' and rule_id = 'hi'").first()["seq"] == 30
