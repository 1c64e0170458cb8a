"""Named queries over the sample tables: one per operator.

Rules over ``events`` and ``orders`` are written out here; rule, subscriber and subscription *tables* are
derived from part, customer and orders, so that every query grows with its input.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import durations
from ..functions.durations import DAY_NS
from ..functions.fields import compare, record_kind
from ..model import Expression, Fields, PatternMatch, Rule, SqlReturnsRows, Threshold, WindowAggregate
from ..operators import config, delivery, history, matching, payloads, retention, state, windows
from ..operators.sqljobs import evaluate_sql_rules
from ..operators.sqlrules import Datasources, sql_verdicts
from ..operators.timeline import plan_timeline
from ..operators.verdicts import extract, push_verdicts, route, table_verdicts, value_templates
from ..session import local_table, prepare
from ..sources import records as R
from .alerting import AlertPlan, Subscribers, plan_alerts

START, END = datetime(2024, 1, 1), datetime(2024, 1, 31)
CUTOFF, NOW = datetime(2024, 1, 16), datetime(2024, 2, 1)
MINUTE, HOUR = 60 * 10**9, 3600 * 10**9

RULES = (
    Rule("hi", "High value", "events", Threshold("value", ">", 100), "above 100 <hot> & rising", severity="critical",
         labels={"team": "ops", "env": "prod"}),
    Rule("errs", "Errors", "events", PatternMatch("event_type", "contains", "err"), severity="warning",
         labels={"team": "ops"}),
    Rule("buy", "Big purchase", "events", Expression('record.event_type == "purchase" && record.value > 60'),
         labels={"team": "sales", "tier": "gold"}),
    Rule("peak", "Hourly peak", "events", WindowAggregate("value", "max", HOUR, ">", 150.0),
         labels={"team": "ops", "tier": "gold"}, schedule_ns=15 * MINUTE),
)
SUBSCRIPTIONS = (
    ("s-direct", "ann", "hi", None, 0, 0, True, False, None, None, None),
    ("s-ops", "ann", None, {"team": "ops"}, 5 * MINUTE, 10 * MINUTE, True, False, [], None, None),
    ("s-prod", "bob", None, {"team": "ops", "env": "prod"}, 2 * MINUTE, 0, False, False, ["mail"], None, None),
    ("s-once", "bob", None, {"team": "ops"}, 0, 0, True, True, None, None, None),
    ("s-peak", "bob", "peak", None, 20 * MINUTE, 45 * MINUTE, True, False, ["pager", "card"], None, None),
    ("s-ghost", "nobody", "hi", None, 0, 0, True, False, None, None, None),
    ("s-untiered", "cal", None, {"tier": ""}, 0, 30 * MINUTE, True, False, None, None, None),
)
SUBSCRIBERS = (
    ("ann", "Ann", [("mail", "ann@example.org"), ("hook", ""), ("fax", "123")], None, None),
    ("bob", "Bob", [("mail", "bob@example.org"), ("pager", " KEY-1 "), ("card", "")], None, None),
    ("cal", "Cal", [("text", ""), ("web", "http://cal"), ("chat", "")], None, None),
)
CHANNELS = (
    ("mail", "smtp", ""), ("hook", "slack", "http://hooks/default"), ("pager", "pagerduty", ""),
    ("card", "teams", "http://cards/default"), ("text", "sms", ""), ("web", "webhook", ""),
    ("chat", "discord", "http://chat/default"),
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without time zone (UTC), as the tables store them."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType)
        else F.col(f"`{f.name}`") for f in df.schema])


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    prepare(spark).conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_records(spark, sf) -> DataFrame:
    return R.as_records(read(spark, sf, "events"), "ts", "event_id")


def order_records(spark, sf) -> DataFrame:
    return R.as_records(read(spark, sf, "orders"), "o_orderdate", "o_orderkey", "orders")


def audience(spark) -> Subscribers:
    return Subscribers(config.table(spark, "subscriptions", SUBSCRIPTIONS),
                       config.table(spark, "subscribers", SUBSCRIBERS), config.table(spark, "channels", CHANNELS))


def alerts(spark, sf, rules=RULES) -> AlertPlan:
    return plan_alerts(event_records(spark, sf), rules, audience(spark), START, END)


# ---- sources -------------------------------------------------------------------------------------


def json_messages(spark, sf) -> DataFrame:
    """Events as queue messages; some kinds carry bodies that are no JSON object."""
    kind = F.col("event_type")
    body = (F.when(kind == "error", F.concat(F.lit("["), F.col("user_id"), F.lit("]")))
            .when(kind == "view", F.lit("null")).when(kind == "signup", F.lit("")).otherwise(F.col("props")))
    return read(spark, sf, "events").select(
        F.concat(F.lit("q-"), kind).alias("input_ref"), body.alias("body"), F.col("ts").cast("timestamp").alias("when"),
        F.col("event_id").alias("seq"))


@query
def src_events(spark, sf):
    events = read(spark, sf, "events")
    named = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type"))
    records = R.as_records(events, "ts", "event_id", named)
    return plain(records.select("input_ref", "when", "seq", "record.user_id", "record.value"))


@query
def src_json_decode(spark, sf):
    rows = R.decode_json(json_messages(spark, sf))
    return plain(rows.select("input_ref", "when", "seq", F.variant_get("record", "$.k", "bigint").alias("k")))


@query
def src_quarantine(spark, sf):
    return plain(R.quarantine(json_messages(spark, sf)))


@query
def src_kafka_shape(spark, sf):
    e = read(spark, sf, "events")
    kafka = e.select(
        F.lit(None).cast("binary").alias("key"),
        F.to_json(F.struct("value", "event_type")).cast("binary").alias("value"), F.col("event_type").alias("topic"),
        F.pmod("user_id", F.lit(4)).cast("int").alias("partition"), F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.lit(0).alias("timestampType"))
    rows = R.kafka_records(kafka)
    return plain(rows.select("input_ref", "when", "seq", F.variant_get("record", "$.value", "double").alias("value"),
                             F.variant_get("record", "$.event_type", "string").alias("kind")))


@query
def src_queue(spark, sf):
    e = read(spark, sf, "events").select("event_type", "props", "ts", "event_id")
    rows = R.queue_records(e, "event_type", "props", "ts", "event_id")
    return plain(rows.select("input_ref", "when", "seq", F.variant_get("record", "$.k", "bigint").alias("k")))


@query
def src_scrape(spark, sf):
    targets = local_table(spark, [("click", "k"), ("view", ""), ("error", "k"), ("purchase", "k")],
                          "name string, field string")
    docs = read(spark, sf, "events").select(
        F.col("event_type").alias("target"), F.when(F.col("value") > 100, 503).otherwise(204).alias("status"),
        F.col("props").alias("body"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    rows = R.scrape_records(docs, targets)
    return plain(rows.select("input_ref", "when", "seq", F.variant_get("record", "$.value", "bigint").alias("value"),
                             F.variant_get("record", "$.source", "string").alias("source")))


def loose_records(spark, sf) -> DataFrame:
    """JSON records whose field ``x`` is a number, text, boolean, null or missing."""
    kind = F.col("event_type")
    value = F.col("value").cast("string")
    body = (F.when(kind == "click", F.concat(F.lit('{"x":'), value, F.lit("}")))
            .when(kind == "view", F.concat(F.lit('{"x":"'), value, F.lit('"}')))
            .when(kind == "signup", F.concat(F.lit('{"x":'), (F.col("value") > 50).cast("string"), F.lit("}")))
            .when(kind == "error", F.lit('{"x":null}')).otherwise(F.lit("{}")))
    messages = read(spark, sf, "events").select(
        F.lit("events").alias("input_ref"), body.alias("body"), F.col("ts").cast("timestamp").alias("when"),
        F.col("event_id").alias("seq"))
    return R.decode_json(messages)


@query
def coerce_numeric(spark, sf):
    records, fields = loose_records(spark, sf), Fields(T.VariantType())
    fields.number("x")
    return extract(records, fields, F.col("seq")).select("seq", F.col("f0").alias("x"))


@query
def coerce_string(spark, sf):
    records, fields = loose_records(spark, sf), Fields(T.VariantType())
    fields.text("x")
    return extract(records, fields, F.col("seq")).select("seq", F.col("f0").alias("x"))


# ---- push rules ----------------------------------------------------------------------------------


def paired_records(spark, sf) -> DataFrame:
    """JSON records with fields ``a`` and ``b`` of equal, different, missing and null values of several types."""
    kind, value = F.col("event_type"), F.col("value").cast("string")
    body = (F.when(kind == "click", F.concat(F.lit('{"a":'), value, F.lit(',"b":'), value, F.lit("}")))
            .when(kind == "view", F.lit('{"a":"x","b":"y"}')).when(kind == "signup", F.lit('{"a":"x","b":"x","t":"signup\\n"}'))
            .when(kind == "error", F.lit('{"a":null}')).otherwise(F.lit('{"a":5,"b":"5"}')))
    return R.decode_json(read(spark, sf, "events").select(
        F.lit("events").alias("input_ref"), body.alias("body"), F.col("ts").cast("timestamp").alias("when"), F.col("event_id").alias("seq")))


@query
def expression_fields(spark, sf):
    rules = [Rule(i, "n", "events", Expression(f"record.a {op} record.b")) for i, op in (("eq", "=="), ("ne", "!="), ("lt", "<"))]
    return verdict_rows(paired_records(spark, sf), *rules)


@query
def expression_invalid(spark, sf):
    texts = {"good": "record.value > 100", "syntax": "record.value >", "number": "record.value + 1", "unknown": "nope(record.value) > 1",
             "nested": "record.value.x == 1"}
    rules = [Rule(i, "n", "events", Expression(t)) for i, t in texts.items()]
    records = event_records(spark, sf)
    ticks = push_verdicts(records, rules).groupBy("rule_id").agg(F.count("*").alias("ticks"), F.count_if("triggered").alias("hits"))
    listed = local_table(spark, [(r.id, bool(r.errors(record_kind(records)))) for r in rules], "rule_id string, invalid boolean")
    return listed.join(ticks, "rule_id", "left").na.fill(0, ["ticks", "hits"])


@query
def pattern_dialect(spark, sf):
    rules = [Rule(f"p{i}", "n", "events", PatternMatch("event_type", "regex", p)) for i, p in enumerate(DIALECT)]
    ends = [Rule("end", "n", "events", PatternMatch("t", "regex", "p$")), Rule("dot", "n", "events", PatternMatch("t", "regex", "p.$"))]
    return verdict_rows(event_records(spark, sf), *rules).unionByName(verdict_rows(paired_records(spark, sf), *ends))


DIALECT = (r"^[[:alpha:]]+$", r"^[[:^digit:]]{5}$", r"\pL{6}", r"\p{Latin}k$", r"c(?i)LICK", r"^[a&&z]", r"[[x]", r"\Qc\Elick", r"\x{63}l",
           r"(?P<a_b>vi)(?P<ab>ew)", r"(?s)^.{4}$")


def verdict_rows(records, *rules) -> DataFrame:
    return plain(push_verdicts(records, rules).select("rule_id", "now", "seq", "triggered"))


@query
def op_compare(spark, sf):
    e = read(spark, sf, "events")
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    names = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "==", "neq": "!="}
    return e.select("event_id", *[compare(op, v, 34.59).alias(n) for n, op in names.items()])


def _threshold(name: str, op: str):
    def run(spark, sf):
        events = Rule("events-" + name, "n", "events", Threshold("value", op, 34.59))
        orders = Rule("orders-" + name, "n", "orders", Threshold("o_totalprice", op, 250000.0))
        text = Rule("text-" + name, "n", "events", Threshold("event_type", op, 1.0))
        return verdict_rows(event_records(spark, sf), events, text).unionByName(
            verdict_rows(order_records(spark, sf), orders))

    QUERIES["threshold_" + name] = run


for _name, _op in {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "==", "neq": "!="}.items():
    _threshold(_name, _op)


@query
def pattern_contains(spark, sf):
    return verdict_rows(
        event_records(spark, sf), Rule("err", "n", "events", PatternMatch("event_type", "contains", "r")),
        Rule("num", "n", "events", PatternMatch("user_id", "contains", "42")),
        Rule("missing", "n", "events", PatternMatch("nope", "contains", "x")))


@query
def pattern_regex(spark, sf):
    return verdict_rows(
        event_records(spark, sf), Rule("re", "n", "events", PatternMatch("event_type", "regex", "^(?P<a>c|p).*[ke]$")),
        Rule("all", "n", "events", PatternMatch("event_type", "regex", "")),
        Rule("digits", "n", "events", PatternMatch("value", "regex", r"\.5$")))


@query
def expression_push(spark, sf):
    return verdict_rows(
        event_records(spark, sf),
        Rule("and", "n", "events", Expression('record.event_type == "error" && record.value > 20')),
        Rule("or", "n", "events", Expression('record["value"] >= 200 || !(record.event_type != "signup")')),
        Rule("absent", "n", "events", Expression('record.level == "ERROR"')),
        Rule("no-verdict", "n", "events", Expression("record.level > 5")))


@query
def expression_regex_match(spark, sf):
    return verdict_rows(
        event_records(spark, sf), Rule("m", "n", "events", Expression('regex_match("event_type", "^(cl|vi)")')),
        Rule("none", "n", "events", Expression('regex_match("host", "^web-")')))


@query
def expression_builtins(spark, sf):
    texts = {
        "len": "len(record.event_type) > 5",
        "lower": 'upper(record.event_type) == "CLICK"',
        "in": 'record.event_type in ["click", "view"]',
        "starts": 'record.event_type startsWith "p"',
        "ends": 'record.event_type endsWith "r"',
        "contains": 'record.event_type contains "ie"',
        "matches": 'record.event_type matches "^s.*p$"',
        "case": 'CASE WHEN record.event_type == "view" THEN record.value > 50 ELSE false END',
        "math": "record.value / record.user_id > 1.5",
    }
    return verdict_rows(event_records(spark, sf), *[Rule(k, k, "events", Expression(v)) for k, v in texts.items()])


@query
def expression_push_window_zero(spark, sf):
    return verdict_rows(
        event_records(spark, sf), Rule("zero", "n", "events", Expression('avg_over("value", "1h") < 5')),
        Rule("mixed", "n", "events", Expression('count_over("value", "1h") > 0 || record.value > 100')))


@query
def rule_routing(spark, sf):
    rules = config.table(spark, "rules", [
        (r, r, "", on, "info", {}, ref, None, 0, None, None) for r, on, ref in
        (("a", True, "click"), ("b", True, "click"), ("c", False, "click"), ("d", True, "error"), ("e", True, "none"))])
    records = R.as_records(read(spark, sf, "events"), "ts", "event_id", F.col("event_type"))
    return plain(route(records, rules))


@query
def table_rules(spark, sf):
    """Threshold and contains rules read from a table: one rule per nation."""
    threshold = F.col("n_regionkey") < 3
    spec = F.when(threshold, F.concat(F.lit('{"field":"value","op":">","value":'),
                                      (F.col("n_nationkey") * 10).cast("string"), F.lit("}"))).otherwise(
        F.concat(F.lit('{"field":"event_type","kind":"contains","pattern":"'), F.lower(F.substring("n_name", 5, 1)), F.lit('"}')))
    rules = read(spark, sf, "nation").select(
        F.col("n_name").alias("id"), (F.col("n_regionkey") != 2).alias("enabled"), F.lit("events").alias("input_ref"),
        F.struct(F.when(threshold, "threshold").otherwise("pattern_match").alias("type"), spec.alias("spec"))
        .alias("condition"))
    rows = table_verdicts(event_records(spark, sf), rules, ["value", "event_type"])
    return rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("ticks"), F.count_if("triggered").alias("hits"))


# ---- windows -------------------------------------------------------------------------------------


@query
def observe_samples(spark, sf):
    return plain(windows.observe(event_records(spark, sf), ["value", "user_id", "event_type"]))


@query
def schedule_grid(spark, sf):
    e = read(spark, sf, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    rules = [Rule("ten", "n", "events", WindowAggregate("value", "avg", HOUR, ">", 0), schedule_ns=10 * MINUTE),
             Rule("odd", "n", "events", WindowAggregate("value", "avg", HOUR, ">", 0), schedule_ns=90_500_000_000)]
    return plain(windows.schedule_grid(spark, rules, e["a"], e["b"]))


def _window(agg: str):
    def run(spark, sf):
        rule = Rule("w", "n", "events", WindowAggregate("value", agg, 90 * MINUTE, ">", 0), schedule_ns=20 * MINUTE)
        rows, _ = windows.window_features(event_records(spark, sf), [rule], START, END)
        return plain(rows.select("rule_id", "now", F.round("w0", 9).alias("value")))

    QUERIES["win_" + agg] = run


for _agg in ("avg", "sum", "min", "max", "count"):
    _window(_agg)


@query
def win_boundary(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.date_trunc("hour", "ts"))
    rule = Rule("w", "n", "events", WindowAggregate("value", "count", 3 * HOUR, ">", 0), schedule_ns=HOUR)
    rows, _ = windows.window_features(R.as_records(e, "ts", "event_id"), [rule], START, END)
    return plain(rows.select("rule_id", "now", F.col("w0").cast("bigint").alias("n")))


@query
def win_max_span(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.date_trunc("hour", "ts"))
    rule = Rule("w", "n", "events", WindowAggregate("value", "count", 24 * HOUR, ">", 0), schedule_ns=HOUR)
    rows, _ = windows.window_features(R.as_records(e, "ts", "event_id"), [rule], START, END, 6 * HOUR)
    return plain(rows.select("rule_id", "now", F.col("w0").cast("bigint").alias("n")))


@query
def window_aggregate_rule(spark, sf):
    rules = [RULES[3], Rule("quiet", "n", "events", WindowAggregate("value", "max", 2 * MINUTE, "<", 20.0),
                            schedule_ns=30 * MINUTE)]
    return plain(windows.window_verdicts(event_records(spark, sf), rules, START, END)
                 .select("rule_id", "now", "triggered", "measure"))


@query
def expression_scheduled(spark, sf):
    rules = [
        Rule("both", "n", "events", Expression('max_over("value", "1h") > 150 && count_over("value", "30m") < 100',
                                               "scheduled"), schedule_ns=30 * MINUTE),
        Rule("no-data", "n", "events", Expression('max_over("nope", "1d") < 5', "scheduled"), schedule_ns=6 * HOUR),
        Rule("stub", "n", "events", Expression('regex_match("event_type", ".")', "scheduled"), schedule_ns=12 * HOUR),
        Rule("bad", "n", "events", Expression('count_over("value", "30d12h") == 0', "scheduled"), schedule_ns=12 * HOUR),
    ]
    return plain(windows.window_verdicts(event_records(spark, sf), rules, START, END)
                 .select("rule_id", "now", "triggered"))


@query
def win_long(spark, sf):
    rules = [Rule(a, "n", "events", WindowAggregate("value", a, 20 * DAY_NS, ">", 0), schedule_ns=10 * MINUTE) for a in ("avg", "sum", "min", "max", "count")]
    cents = read(spark, sf, "events").withColumn("value", F.round(F.col("value") * 100))  # whole numbers: sums are exact in any order
    rows, _ = windows.window_features(R.as_records(cents, "ts", "event_id"), rules, START, END)
    return plain(rows.select("rule_id", "now", F.col("w0").alias("v")))


@query
def expression_ratio(spark, sf):
    ratio = lambda top, over: Expression(f'count_over("{top}", "1d") / count_over("{over}", "1d") > 1.5', "scheduled")
    rules = [Rule("none", "n", "events", ratio("nope", "nope"), schedule_ns=6 * HOUR),
             Rule("infinite", "n", "events", ratio("value", "nope"), schedule_ns=6 * HOUR),
             Rule("one", "n", "events", ratio("value", "user_id"), schedule_ns=6 * HOUR)]
    return plain(windows.window_verdicts(event_records(spark, sf), rules, START, END).select("rule_id", "now", "triggered"))


ORDER_RULES = (
    Rule("late", "Late", "orders", SqlReturnsRows(
        "dw", "select 1 from {orders} where o_orderstatus = 'P' and o_orderdate < :tick "
              "and o_orderdate >= :tick - interval 30 days", 60), schedule_ns=DAY_NS),
    Rule("any", "Any", "orders", SqlReturnsRows("dw", "select * from {orders} where o_totalprice > 499000"),
         schedule_ns=DAY_NS),
    Rule("lost", "Lost", "orders", SqlReturnsRows("unknown", "select 1"), schedule_ns=DAY_NS),
)


def order_months(spark, sf) -> list[datetime]:
    """First days of all months that have orders."""
    low, high = read(spark, sf, "orders").agg(F.date_trunc("month", F.min("o_orderdate")), F.max("o_orderdate")).first()
    months = spark.range(1).select(F.explode(F.sequence(F.lit(low), F.lit(high), F.expr("interval 1 month"))).alias("m"))
    return [r["m"] for r in months.orderBy("m").collect()]


def _warehouse(spark, sf) -> Datasources:
    return Datasources(spark).register("dw", {"orders": read(spark, sf, "orders")})


@query
def sql_count_rows(spark, sf):
    return _warehouse(spark, sf).count_rows("dw", "select * from {orders} where o_totalprice > 400000")


@query
def sql_returns_rows(spark, sf):
    rows, _ = sql_verdicts(_warehouse(spark, sf), ORDER_RULES, order_months(spark, sf))
    return plain(rows.select("rule_id", "now", "triggered", F.col("measure").cast("bigint").alias("n")))


# Divides by zero at the tick half-way: a failure that no planning can see.
def _fragile(months: list[datetime]) -> Rule:
    middle = months[len(months) // 2]
    return Rule("fragile", "Fragile", "orders", SqlReturnsRows(
        "dw", "select 1 from {orders} where o_orderdate < :tick "
              f"and o_totalprice / datediff(:tick, date'{middle:%Y-%m-%d}') > 1000", 50), schedule_ns=DAY_NS)


@query
def sql_isolated(spark, sf):
    """Verdicts and errors of SQL rules of which one cannot be planned and one fails while running, at one tick."""
    months = order_months(spark, sf)
    rows, errors = evaluate_sql_rules(_warehouse(spark, sf), (*ORDER_RULES, _fragile(months)), months)
    failed = errors.select("rule_id", "now", F.lit(False).alias("triggered"), F.lit(-1).cast("bigint").alias("n"), F.lit(True).alias("failed"))
    return plain(rows.select("rule_id", "now", "triggered", F.col("measure").cast("bigint").alias("n"), F.lit(False).alias("failed")).unionByName(failed))


@query
def live_state_errors(spark, sf):
    rows, errors = sql_verdicts(_warehouse(spark, sf), ORDER_RULES, order_months(spark, sf))
    timeline = plan_timeline(rows, when="now")
    incidents = state.incidents_of(state.local_runs(state.sliced(rows, timeline)))
    states = state.live_states(state.last_verdicts(rows), incidents, value_templates(spark, ORDER_RULES), errors)
    return plain(states.select("rule_id", "state", "triggered_at", "last_eval_at", "last_value",
                               F.col("last_error").isNotNull().alias("failed")))


# ---- state ---------------------------------------------------------------------------------------


@query
def transitions(spark, sf):
    return plain(alerts(spark, sf).transitions.select("rule_id", "incident_id", "now", "prev", "next", "value"))


@query
def incidents(spark, sf):
    return plain(alerts(spark, sf).incidents)


@query
def live_states(spark, sf):
    return plain(alerts(spark, sf).live_states.select(
        "rule_id", "state", "triggered_at", "last_eval_at", "last_value", "incident_id"))


# ---- matching and configuration tables -----------------------------------------------------------


def part_rules(spark, sf) -> DataFrame:
    """A rules table: one rule per part."""
    p = read(spark, sf, "part")
    labels = F.map_filter(
        F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"),
                     F.lit("type"), F.col("p_type"), F.lit("tier"),
                     F.when(F.col("p_size") < 50, F.lit("std"))),
        lambda _, v: v.isNotNull())
    spec = (
        F.when(F.col("p_type") == "SMALL", F.format_string('{"field":"value","op":"%s","value":%d}',
               F.when(F.col("p_size") < 10, "=>").otherwise(">"), F.col("p_size")))
        .when(F.col("p_type") == "MEDIUM", F.format_string(
            '{"field":"value","agg":"%s","window":%d,"op":"<","value":5}',
            F.when(F.col("p_size") < 10, "median").otherwise("avg"), (F.col("p_size") - 20) * 1000000))
        .when(F.col("p_type") == "LARGE", F.format_string('{"field":"%s","kind":"regex","pattern":"%s"}',
              F.when(F.col("p_size") < 10, "").otherwise("msg"), F.when(F.col("p_size") > 40, "a(").otherwise("^a+$")))
        .when(F.col("p_type") == "PROMO", F.format_string('{"data_source":"%s","query":"  "}',
              F.when(F.col("p_size") < 25, "").otherwise("dw")))
        .when(F.col("p_type") == "ECONOMY", F.format_string('{"expr":"1 > 0","mode":"%s"}',
              F.when(F.col("p_size") < 20, "scheduled").when(F.col("p_size") < 30, "later").otherwise("")))
        .otherwise(F.lit("{}")))
    kind = (F.when(F.col("p_type") == "SMALL", "threshold").when(F.col("p_type") == "MEDIUM", "window_aggregate")
            .when(F.col("p_type") == "LARGE", "pattern_match").when(F.col("p_type") == "PROMO", "sql_returns_rows")
            .when(F.col("p_type") == "ECONOMY", "expression").otherwise("mystery"))
    return p.select(
        F.concat(F.lit("rule-"), "p_partkey").alias("id"), F.when(F.col("p_size") == 7, "").otherwise(F.col("p_name")).alias("name"),
        F.lit("").alias("description"), (F.col("p_size") % 2 == 0).alias("enabled"),
        F.when(F.col("p_brand") == "Brand#1", "urgent").when(F.col("p_brand") == "Brand#2", "").otherwise("warning")
        .alias("severity"), labels.alias("labels"), F.lit("events").alias("input_ref"),
        F.struct(kind.alias("type"), spec.alias("spec")).alias("condition"),
        F.when(F.col("p_size") < 15, F.lit(0)).otherwise(F.lit(60 * 10**9)).cast("bigint").alias("schedule_ns"),
        F.lit(START).alias("created_at"), F.lit(START).alias("updated_at"))


def customer_subscribers(spark, sf) -> DataFrame:
    """A subscribers table: customers with money on their account."""
    c = read(spark, sf, "customer").where("c_acctbal > 0")
    bind = lambda channel, address: F.struct(channel.alias("channel"), address.alias("address"))
    return c.select(
        F.concat(F.lit("cust-"), "c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.array(bind(F.col("c_mktsegment"), F.col("c_name")),
                bind(F.concat(F.lit("NATION_"), "c_nationkey"), F.lit("")),
                bind(F.lit("fax"), F.lit("1"))).alias("channels"))


def order_subscriptions(spark, sf) -> DataFrame:
    """A subscriptions table: one per order; by rule, by labels, or by a missing label."""
    o = read(spark, sf, "orders")
    brand = F.concat(F.lit("Brand#"), F.col("o_custkey") % 25 + 1)
    size = (F.col("o_orderkey") % 50 + 1).cast("string")
    selector = (
        F.when(F.col("o_orderstatus") == "P", F.create_map(F.lit("brand"), brand, F.lit("size"), size))
        .when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"),
              F.create_map(F.lit("tier"), F.lit("")))
        .when(F.col("o_orderstatus") == "F", F.create_map(F.lit("brand"), brand, F.lit("tier"), F.lit(""))))
    return o.select(
        F.concat(F.lit("sub-"), "o_orderkey").alias("id"), F.concat(F.lit("cust-"), "o_custkey").alias("subscriber_id"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("rule-"), "o_custkey")).alias("rule_id"),
        selector.alias("label_selector"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(-1)).otherwise(F.lit(0)).cast("bigint").alias("dwell_ns"),
        F.lit(0).cast("bigint").alias("repeat_interval_ns"), F.lit(True).alias("notify_on_resolve"),
        (F.col("o_orderpriority") == "2-HIGH").alias("one_shot"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.array(F.lit("BUILDING"), F.lit("fax")))
        .otherwise(F.array().cast("array<string>")).alias("channel_filter"))


def nation_channels(spark, sf) -> DataFrame:
    """Configured channels: one webhook per nation, one mail channel per market segment."""
    hooks = read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("webhook").alias("type"),
                                             F.concat(F.lit("http://"), "n_name").alias("default_address"))
    mails = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("smtp").alias("type"),
                                               F.lit("").alias("default_address")).distinct()
    return hooks.unionByName(mails)


@query
def match_direct(spark, sf):
    return matching.match_direct(part_rules(spark, sf), order_subscriptions(spark, sf)).select("rule_id", "subscription_id")


@query
def match_labels(spark, sf):
    return matching.match_labels(part_rules(spark, sf), order_subscriptions(spark, sf)).select("rule_id", "subscription_id")


@query
def match_subscriptions(spark, sf):
    return matching.match_subscriptions(part_rules(spark, sf), order_subscriptions(spark, sf)).select(
        "rule_id", "subscription_id", "one_shot", "dwell_ns")


@query
def subscriber_lookup(spark, sf):
    return delivery.missing_subscribers(order_subscriptions(spark, sf), customer_subscribers(spark, sf)).select(
        "subscription_id", "subscriber_id")


def _fan_out(spark, sf, channels) -> DataFrame:
    usable = delivery.bindings(order_subscriptions(spark, sf), customer_subscribers(spark, sf), channels)
    return usable.select("subscription_id", "skipped", F.inline("bindings")).select(
        "subscription_id", "skipped", "channel", "address")


@query
def channel_fanout(spark, sf):
    everything = nation_channels(spark, sf).unionByName(
        config.table(spark, "channels", [("fax", "fax", "")]))
    return _fan_out(spark, sf, everything)


@query
def channel_configured(spark, sf):
    return _fan_out(spark, sf, nation_channels(spark, sf))


@query
def channel_destination(spark, sf):
    c = read(spark, sf, "customer")
    kinds = F.create_map(*[F.lit(x) for x in ("AUTOMOBILE", "slack", "BUILDING", "teams", "FURNITURE", "pagerduty",
                                              "HOUSEHOLD", "sms", "MACHINERY", "smtp")])
    address = F.when(F.col("c_acctbal") < 0, F.lit(" ")).when(F.col("c_acctbal") < 3000, F.lit("")).otherwise(
        F.concat(F.lit(" "), "c_name"))
    default = F.when(F.col("c_nationkey") < 12, F.lit("http://default")).otherwise(F.lit(""))
    target, error = payloads.destination(F.element_at(kinds, F.col("c_mktsegment")), address, default)
    return c.select("c_custkey", target.alias("destination"), error.isNotNull().alias("failed"))


@query
def validate_rules(spark, sf):
    return config.validate_rules(part_rules(spark, sf)).select(
        "id", F.size("errors").alias("n"), F.coalesce(F.get("errors", F.lit(0)), F.lit("")).substr(1, 20).alias("first_error"))


@query
def rule_decode(spark, sf):
    return config.decode_rules(part_rules(spark, sf)).select(
        "id", "condition_type", "mode", "severity", F.col("spec.field").alias("field"), F.col("spec.op").alias("op"),
        F.col("spec.window").alias("window_ns"), F.col("spec.value").alias("value"))


@query
def validate_subscriptions(spark, sf):
    subs = order_subscriptions(spark, sf).withColumn(
        "subscriber_id", F.when(F.col("one_shot"), F.lit("")).otherwise(F.col("subscriber_id"))).withColumn(
        "rule_id", F.when(F.col("label_selector").isNotNull() & F.col("one_shot"), F.lit("rule-1")).otherwise(F.col("rule_id")))
    return config.validate_subscriptions(subs).select("id", F.concat_ws("; ", "errors").alias("errors"))


@query
def flex_duration(spark, sf):
    li = read(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int")
    text = (
        F.when(F.col("l_linenumber") == 1, F.concat(q, F.lit("d")))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit(" "), q, F.lit(".5w ")))
        .when(F.col("l_linenumber") == 3, F.concat(q, F.lit("h"), F.lit("30m"), F.lit("1.5s")))
        .when(F.col("l_linenumber") == 4, F.concat(q, F.lit("d12h")))
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("-"), q, F.lit("m")))
        .when(F.col("l_linenumber") == 6, F.concat(q, F.lit("ms"), q, F.lit("µs"), q, F.lit("ns")))
        .otherwise(F.lit("")))
    return li.select("l_orderkey", "l_linenumber", "l_quantity", durations.flex_duration(text).alias("ns"))


def rule_changes(spark, sf) -> tuple[DataFrame, DataFrame]:
    base = read(spark, sf, "customer").where("c_acctbal > 5000").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(START).alias("created_at"),
        F.lit(START).alias("updated_at"))
    ops = F.create_map(*[F.lit(x) for x in ("O", "update", "P", "create", "F", "delete")])
    changes = read(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.element_at(ops, F.col("o_orderstatus")).alias("op"),
        F.col("o_orderkey").alias("version"), F.col("o_orderdate").cast("timestamp").alias("at"),
        F.concat(F.lit("v"), "o_orderkey").alias("name"))
    return base, changes


@query
def cfg_apply_changes(spark, sf):
    return plain(config.apply_changes(*rule_changes(spark, sf)))


@query
def cfg_rejected_creates(spark, sf):
    return config.rejected_creates(*rule_changes(spark, sf))


@query
def cfg_cascade(spark, sf):
    return config.surviving_subscriptions(order_subscriptions(spark, sf), customer_subscribers(spark, sf)).select("id")


@query
def rules_by_name(spark, sf):
    return history.by_name(part_rules(spark, sf)).select("id", "name", "enabled")


@query
def rules_by_input(spark, sf):
    return config.list_rules(part_rules(spark, sf), "events").select("id", "name")


# ---- delivery ------------------------------------------------------------------------------------


@query
def dwell_first_notify(spark, sf):
    plan = alerts(spark, sf)
    firsts = delivery.first_notices(plan.stored_incidents, plan.ticks, plan.policies)
    return plain(firsts.select("rule_id", "open_at", "dwell_us", "repeat_us", "now", "seq"))


def _dispatched(spark, sf, *kinds):
    rows = alerts(spark, sf).dispatched
    return plain((rows.where(F.col("kind").isin(*kinds)) if kinds else rows).select(
        "rule_id", "open_at", "subscription_id", "kind", "now", "seq"))


@query
def notify_firing(spark, sf):
    return _dispatched(spark, sf, delivery.FIRING)


@query
def notify_repeat(spark, sf):
    return _dispatched(spark, sf, delivery.REPEAT)


@query
def notify_resolved(spark, sf):
    return _dispatched(spark, sf, delivery.RESOLVED)


@query
def one_shot(spark, sf):
    return plain(alerts(spark, sf).deliveries.where("one_shot").select(
        "subscription_id", "rule_id", "open_at", "kind", "now", F.size("bindings").alias("n_bindings")))


@query
def incident_sub_states(spark, sf):
    return plain(alerts(spark, sf).sub_states)


@query
def notification_audit(spark, sf):
    return plain(alerts(spark, sf).notifications.drop("id", "error"))


@query
def delivery_counters(spark, sf):
    plan = alerts(spark, sf)
    return delivery.delivery_counters(plan.deliveries, plan.outbox)


@query
def notification_payload(spark, sf):
    return plain(alerts(spark, sf).outbox.select(
        "incident_id", "rule_id", "rule_name", "severity", "description", "value", "kind", "address", "now",
        "triggered_at", "incident_triggered_at"))


@query
def delivery_results(spark, sf):
    def sender(message):
        if message["rule_id"] == "errs" and message["kind"] == "resolved":
            raise RuntimeError("unreachable")

    sent = delivery.deliver(alerts(spark, sf).outbox, sender)
    return plain(sent.select("subscription_id", "channel", "kind", "sent_at", "status"))


@query
def notification_plan(spark, sf):
    """Flagship: four kinds of rules over the events, planned for every subscription."""
    return plain(alerts(spark, sf).messages.select(
        "rule_id", "subscription_id", "channel", "kind", "sent_at", "value", "payload"))


def _payload(kind: str, name: str):
    def run(spark, sf):
        rows = alerts(spark, sf).messages.where(F.col("channel_type") == kind)
        return plain(rows.select("subscription_id", "rule_id", "kind", "sent_at", "payload"))

    QUERIES["payload_" + name] = run


for _kind, _label in (("slack", "slack"), ("webhook", "webhook"), ("pagerduty", "pagerduty"), ("teams", "teams"),
                      ("discord", "discord"), ("sms", "sms"), ("smtp", "email")):
    _payload(_kind, _label)


# ---- history and retention -----------------------------------------------------------------------


@query
def incidents_recent(spark, sf):
    return plain(history.recent_incidents(alerts(spark, sf).incidents))


@query
def incidents_for_rule(spark, sf):
    return plain(history.recent_incidents(alerts(spark, sf).incidents, history.parse_limit("250"), "errs"))


@query
def notifications_recent(spark, sf):
    rows = alerts(spark, sf).notifications
    # Equal send times make the cut-off arbitrary by id, so only the times are compared.
    return plain(history.recent_notifications(rows).select("sent_at"))


@query
def incident_drilldown(spark, sf):
    plan = alerts(spark, sf)
    rows = history.incident_drilldown(plan.incidents, plan.notifications)
    return plain(rows.select("id", "rule_id", "status", F.size("notifications").alias("n"),
                             F.get("notifications.kind", F.lit(0)).alias("first_kind"),
                             F.try_element_at("notifications.sent_at", F.lit(-1)).alias("last_sent")))


@query
def subscription_notified(spark, sf):
    plan = alerts(spark, sf)
    return history.notified_subscriptions(plan.audience.subscriptions, plan.notifications).select("id")


@query
def export_incidents(spark, sf):
    return history.export_incidents(alerts(spark, sf).incidents)


@query
def export_since(spark, sf):
    since = history.parse_since("168h", END)
    return history.export_incidents(alerts(spark, sf).incidents, since, "hi")


def _history(spark, sf) -> retention.History:
    plan = alerts(spark, sf)
    return retention.History(state.incident_table(plan.stored_incidents, plan.templates), plan.notifications, plan.sub_states)


@query
def retention_candidates(spark, sf):
    return plain(retention.candidates(alerts(spark, sf).incidents, CUTOFF))


@query
def retention_keep_incidents(spark, sf):
    return plain(retention.keep(_history(spark, sf), CUTOFF).incidents)


@query
def retention_keep_notifications(spark, sf):
    return plain(retention.keep(_history(spark, sf), CUTOFF).notifications.select(
        "incident_id", "subscription_id", "channel", "kind", "sent_at"))


@query
def retention_keep_sub_states(spark, sf):
    return plain(retention.keep(_history(spark, sf), CUTOFF).sub_states)


@query
def retention_counts(spark, sf):
    return retention.counts(_history(spark, sf), CUTOFF)


@query
def archive_entries(spark, sf):
    rows = retention.archive_entries(_history(spark, sf), CUTOFF, NOW)
    notes = F.from_json(F.get_json_object("entry", "$.notifications"), "array<struct<kind:string,channel:string>>")
    return plain(rows.select(
        "incident_id", "archive_date", F.get_json_object("entry", "$.incident.rule_id").alias("rule_id"),
        F.get_json_object("entry", "$.incident.resolved_at").alias("resolved_at"), F.size(notes).alias("n")))
