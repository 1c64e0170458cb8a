from pyspark.sql import functions as F

from klaxon import Threshold
from klaxon.operators.verdicts import push_verdicts
from klaxon.session import local_table, prepare
from klaxon.sources import records as R

from support import at, rule

BODIES = ["", "not json", "[1]", "3", "null", '{"a":1}', '{"a":1,"a":2}', None]


def messages(spark):
    prepare(spark)
    return local_table(spark, [("q", at(i), i, b) for i, b in enumerate(BODIES)],
                       "input_ref string, when timestamp, seq bigint, body string")


def test_only_objects_are_records(spark):
    good = R.decode_json(messages(spark)).select("seq", F.variant_get("record", "$.a", "int")).collect()
    assert sorted(map(tuple, good)) == [(5, 1), (6, 2)]
    bad = {r["seq"]: r["reason"] for r in R.quarantine(messages(spark)).collect()}
    assert bad == {0: "empty", 1: "invalid json", 2: "not an object", 3: "not an object", 4: "not an object", 7: "empty"}


def test_table_records_treat_null_as_missing(spark):
    df = local_table(spark, [(at(0), 1, None, ""), (at(1), 2, 5.0, "x")], "t timestamp, n bigint, v double, ref string")
    records = R.as_records(df, "t", "n", F.col("ref"))
    assert sorted(r["input_ref"] for r in records.collect()) == ["events", "x"]
    rows = push_verdicts(records, [rule(condition=Threshold("v", "!=", 1))]).collect()
    assert [(r["seq"], r["triggered"]) for r in rows] == [(1, False)]


def test_kafka_shape(spark):
    df = spark.range(1).select(
        F.lit(None).cast("binary").alias("key"), F.lit(b'{"a":1}').alias("value"), F.lit("t").alias("topic"), F.lit(3).alias("partition"),
        F.lit(7).cast("bigint").alias("offset"), F.lit(at(0)).alias("timestamp"), F.lit(0).alias("timestampType"))
    row = R.kafka_records(df).select("input_ref", "seq").first()
    assert tuple(row) == ("t", 7 * 1024 + 3)


def test_scrape(spark):
    docs = local_table(spark, [("a", 200, '{"value":5}', at(0), 0), ("a", 500, '{"value":5}', at(0), 1), ("b", 204, '{"m":"x"}', at(0), 2),
                               ("b", 200, "[]", at(0), 3), ("a", 200, "{}", at(0), 4), ("z", 200, '{"value":1}', at(0), 5)],
                       "target string, status int, body string, at timestamp, seq bigint")
    targets = local_table(spark, [("a", ""), ("b", "m")], "name string, field string")
    rows = R.scrape_records(docs, targets).select("input_ref", F.to_json("record")).collect()
    assert sorted(map(tuple, rows)) == [("a", '{"source":"a","value":5}'), ("b", '{"source":"b","value":"x"}')]


def test_late_split(spark):
    on_time, late = R.late_rows(R.decode_json(messages(spark)), F.lit(at(6)))
    assert [r["seq"] for r in on_time.select("seq").collect()] == [6]
    assert [(r["seq"], r["reason"]) for r in late.select("seq", "reason").collect()] == [(5, "late")]
