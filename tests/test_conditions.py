import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from klaxon import Expression, PatternMatch, Rule, SqlReturnsRows, Threshold, WindowAggregate, plan_alerts, register_condition
from klaxon.functions import expressions as X
from klaxon.functions.durations import clock_duration_ns, flex_duration, flex_duration_ns
from klaxon.functions.fields import compare
from klaxon.functions.gotext import double_literal, double_text, duration_text, quoted
from klaxon.functions.patterns import java_pattern, pattern_error
from klaxon.model import Outcome, Template, decode_condition
from klaxon.operators.verdicts import push_verdicts, table_verdicts, value_templates, with_value
from klaxon.session import local_table
from klaxon.sources.records import as_records

from support import T0, json_records, rule


def outcomes(spark, bodies, condition):
    r = rule(condition=condition)
    rows = with_value(push_verdicts(json_records(spark, list(enumerate(bodies))), [r]), value_templates(spark, [r]))
    return {x["seq"]: (x["triggered"], x["value"]) for x in rows.collect()}


def test_threshold_accepts_every_number_type(spark):
    rows = [(T0, i, d, f, n) for i, (d, f, n) in enumerate([(95.0, 1.0, 1), (50.0, 95.5, 91), (None, None, 50)])]
    df = local_table(spark, rows, "at timestamp, seq bigint, d double, f float, n int")
    rules = [rule(c, condition=Threshold(c, ">", 90)) for c in "dfn"]
    got = {(r["rule_id"], r["seq"]): r["triggered"] for r in push_verdicts(as_records(df, "at", "seq"), rules).collect()}
    assert got == {("d", 0): True, ("d", 1): False, ("d", 2): False, ("f", 0): False, ("f", 1): True, ("f", 2): False,
                   ("n", 0): False, ("n", 1): True, ("n", 2): False}


def test_threshold_missing_or_text_is_false_with_empty_value(spark):
    got = outcomes(spark, ['{"a":1}', '{"v":"high"}', '{"v":"120"}', '{"v":true}', '{"v":null}', '{"v":185}',
                           '{"v":1e25}', '{"v":{"n":200}}'], Threshold("v", ">", 100))
    assert got == {0: (False, ""), 1: (False, ""), 2: (False, ""), 3: (False, ""), 4: (False, ""),
                   5: (True, "185 > 100"), 6: (True, "1e+25 > 100"), 7: (False, "")}


def test_patterns(spark):
    bodies = ['{"m":"ERR: read timeout"}', '{"m":"INFO ok"}', "{}", '{"m":42}', '{"m":null}', '{"m":421.5}']
    got = outcomes(spark, bodies, PatternMatch("m", "regex", "ERR.+timeout"))
    assert [got[i][0] for i in range(6)] == [True, False, False, False, False, False]
    assert got[0][1] == 'm ~ "ERR.+timeout" -> true' and got[2][1] == ""
    got = outcomes(spark, bodies, PatternMatch("m", "contains", "42"))
    assert [got[i][0] for i in range(6)] == [False, False, False, True, False, True]
    assert outcomes(spark, ['{"m":null}'], PatternMatch("m", "contains", "nil"))[0][0]


def test_nan_compares_like_ieee(spark):
    df = spark.range(1).select(F.lit(float("nan")).alias("x"))
    row = df.select(*[compare(op, F.col("x"), 5.0).alias(n) for n, op in
                      zip("abcdef", (">", ">=", "<", "<=", "==", "!="))]).first()
    assert list(row) == [False] * 5 + [True]
    assert spark.range(1).select(compare("!=", F.lit(1.0), math.nan)).first()[0] is True
    with pytest.raises(ValueError):
        compare("=>", F.lit(1.0), 1)


def test_expression_verdicts(spark):
    bodies = ['{"level":"ERROR","host":"web-1","v":3,"on":true}', '{"level":"INFO","host":"db","v":"x"}', '{"host":7}']
    run = lambda text: {k: v[0] for k, v in outcomes(spark, bodies, Expression(text)).items()}
    assert run('record.level == "ERROR"') == {0: True, 1: False, 2: False}
    assert run('regex_match("host", "^web-")') == {0: True, 1: False, 2: False}
    assert run("record.v > 2") == {0: True}                      # others: no verdict at all
    assert run('record["level"] != "ERROR"') == {0: False, 1: True, 2: True}
    assert run("record.on") == {0: True}
    assert run("record.level == nil") == {0: False, 1: False, 2: True}
    assert run('record.level in ["ERROR", "WARN"] && !(record.v > 5)') == {0: True, 1: False}
    assert run('"ERROR" == record.level || false') == {0: True, 1: False, 2: False}
    assert run("record.v / 0 > 1") == {0: True}                  # floating division: infinite
    assert run('len(record.host) == 5 and record.host startsWith "web"') == {0: True, 1: False}
    assert outcomes(spark, bodies, Expression("record.v  >\n 2"))[0] == (True, "record.v > 2 -> true")
    assert outcomes(spark, bodies, Expression(lambda f: f.number("v") > 2))[0][0]


@pytest.mark.parametrize("text", ["", "reflect('a','b')", "(select 1) > 0", "a ? b : c", "record.x contains record.y",
                                  'record.x matches "("', "avg_over(record.x, 1) > 2"])
def test_expression_errors(text):
    assert Expression(text).errors()


def test_expression_modes():
    assert Expression("true").mode == "push" and Expression("true", "scheduled").mode == "scheduled"
    assert Expression("true", "later").errors()
    assert Expression("record.x > 1", "scheduled").errors()
    assert len(X.summary("x" * 200).encode()) == 82 and X.summary("é" * 60) == "é" * 39 + "…"


def test_validation():
    ok = rule()
    assert ok.errors() == []
    assert Rule("i", "", "", None).errors() == ["a rule needs a name", "a rule needs an input",
                                               "a rule needs a condition"]
    assert rule(severity="bad").errors() and not rule(severity="").errors()
    window = WindowAggregate("v", "avg", 10**9, ">", 1)
    assert rule(condition=window).errors() and not rule(condition=window, schedule_ns=1).errors()
    for bad in (Threshold("", ">", 1), Threshold("v", "~", 1), PatternMatch("m", "contains", ""), PatternMatch("m", "regex", "("),
                PatternMatch("m", "glob", "x"), WindowAggregate("v", "p95", 1, ">", 1), WindowAggregate("v", "avg", 0, ">", 1),
                SqlReturnsRows("", "select 1"), SqlReturnsRows("d", "  ")):
        assert bad.errors(), bad
    assert PatternMatch("m", "regex", "").errors() == [] and SqlReturnsRows("d", "q", -3).needed == 1
    with pytest.raises(ValueError):
        decode_condition("nope", "{}")
    assert decode_condition("threshold", '{"field":"v","op":">","value":3}') == Threshold("v", ">", 3.0)


def test_custom_condition(spark):
    class Even:
        mode = "push"

        def errors(self):
            return []

        def outcome(self, fields):
            v = fields.number("v")
            return Outcome(v % 2 == 0, None, F.format_string("even? %s", v.cast("int")))

        def template(self):
            return Template("", "measure")

    register_condition("even", lambda spec: Even())
    assert outcomes(spark, ['{"v":2}', '{"v":3}', "{}"], decode_condition("even", "{}")) == {
        0: (True, "even? 2"), 1: (False, "even? 3")}


def test_patterns_dialect():
    assert pattern_error("a(?=b)") and pattern_error(r"(a)\1") and pattern_error("a(") and not pattern_error("(?P<n>a)")
    assert pattern_error("(?U)a+") and pattern_error("[[:nope:]]") and pattern_error(r"\x{FFFFFFF}")
    assert java_pattern("(?P<na_me>a)(?P<name>b)") == "(?d)(a)(b)"
    assert java_pattern(r"^[[:digit:]&&x]+$|\Q$\E") == r"(?d)^[\p{Digit}\&\&x]+\z|\Q$\E"
    for fine in (r"\pN", r"\p{Greek}", r"a(?i)b", r"\x{41}", r"\Qa.(\E", "[[a]"):
        assert pattern_error(fine) is None, fine


def test_field_comparisons(spark):
    bodies = ['{"a":"x","b":"y"}', '{"a":"x","b":"x"}', '{"a":123,"b":"z"}', '{"a":42}', "{}", '{"a":1,"b":1.0}', '{"a":null}', '{"a":true,"b":true}']
    equal = outcomes(spark, bodies, Expression("record.a == record.b"))
    assert [equal[i][0] for i in range(8)] == [False, True, False, False, True, True, True, True]
    other = outcomes(spark, bodies, Expression("record.a != record.b"))
    assert [other[i][0] for i in range(8)] == [True, False, True, True, False, False, False, False]
    order = outcomes(spark, bodies, Expression("record.a < record.b"))
    assert {i: v[0] for i, v in order.items()} == {0: True, 1: False, 5: False}
    lower = outcomes(spark, ['{"a":"X","b":"x"}', '{"a":"X","b":1}'], Expression("lower(record.a) == record.b"))
    assert [lower[i][0] for i in sorted(lower)] == [True, False]


def test_division_and_conditionals(spark):
    bodies = ['{"a":4,"b":2}', '{"a":4,"b":0}', '{"a":0,"b":0}', '{"a":-1,"b":0}']
    ratio = outcomes(spark, bodies, Expression("record.a / record.b > 1.5"))
    assert {i: v[0] for i, v in ratio.items()} == {0: True, 1: True, 3: False}
    chosen = outcomes(spark, bodies, Expression("(record.b == 0 ? 0 - record.a : record.a) > 0"))
    assert [chosen[i][0] for i in range(4)] == [True, False, False, True]
    flags = outcomes(spark, ['{"f":true,"n":5}', '{"f":false,"n":5}'], Expression("!record.f && record.n == 5"))
    assert [flags[i][0] for i in range(2)] == [False, True]


@pytest.mark.parametrize("text", ["record.n + 1", "record.n >", "nope(record.n) > 1", "record.a.c()", "a ? b", "(record.n > 1"])
def test_bad_expressions_are_errors(spark, text):
    assert Expression(text).errors()


NUMBERS = [185.0, 100.5, 1e7, 1e-4, 123456789.125, -0.5, 0.0, 1e20, 1e21, 1.25e22, 1e-5, 2.5e-7, 123456789012345680.0,
           0.1, 1e15, 2251799813685249.5, -1e21, 5e-324, 1.7976931348623157e308, 0.00012345678901234567, 999999.0, 1e6, -1234567.5, 9999999.0]
TEXTS = ["185", "100.5", "1e+07", "0.0001", "1.23456789125e+08", "-0.5", "0", "1e+20", "1e+21",
         "1.25e+22", "1e-05", "2.5e-07", "1.2345678901234568e+17", "0.1", "1e+15", "2.2517998136852495e+15", "-1e+21",
         "5e-324", "1.7976931348623157e+308", "0.00012345678901234567", "999999", "1e+06", "-1.2345675e+06", "9.999999e+06"]


def test_number_text(spark):
    df = local_table(spark, [(i, v) for i, v in enumerate(NUMBERS)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(double_text(F.col("v"))).collect()]
    # The JVM prints the smallest subnormal with one more digit.
    assert [g.replace("4.9e-324", "5e-324") for g in got] == TEXTS
    assert [double_literal(v) for v in NUMBERS] == TEXTS
    odd = spark.range(1).select(*[double_text(F.lit(x)) for x in (math.nan, math.inf, -math.inf)]).first()
    assert list(odd) == ["NaN", "+Inf", "-Inf"] == [double_literal(x) for x in (math.nan, math.inf, -math.inf)]


def test_duration_text():
    got = [duration_text(n) for n in (0, 10**9, 60 * 10**9, 720 * 3600 * 10**9, 1_500_000_000, 100_000_000, 1500, 90 * 60 * 10**9)]
    assert got == ["0s", "1s", "1m0s", "720h0m0s", "1.5s", "100ms", "1.5µs", "1h30m0s"]
    assert quoted('a"b\\n\n\x01') == '"a\\"b\\\\n\\n\\x01"'


DURATIONS = {"30d": 30 * 86400 * 10**9, "2w": 14 * 86400 * 10**9, "5m": 300 * 10**9, "1h": 3600 * 10**9, "1h30m": 5400 * 10**9,
             "1.5s": 1_500_000_000, " 1.5d ": 129600 * 10**9, "0": 0, "+2s": 2 * 10**9, ".5h": 1800 * 10**9, "abc": None,
             "-1d": None, "-5m": None, "": None, "30d12h": None, "5": None, "d": None, "1h30": None}


def test_durations(spark):
    assert {t: flex_duration_ns(t) for t in DURATIONS} == DURATIONS
    df = local_table(spark, [(t,) for t in DURATIONS], "t string")
    assert {r[0]: r[1] for r in df.select("t", flex_duration(F.col("t"))).collect()} == DURATIONS
    assert clock_duration_ns("-1h") == -3600 * 10**9


def test_rules_from_a_table_equal_compiled_rules(spark):
    rules = [rule(f"t{i}", condition=Threshold(f, op, 20.5)) for i, (f, op) in enumerate(
        [("v", ">"), ("v", "<="), ("v", "!="), ("w", "=="), ("none", "<")])]
    rules += [rule("c", condition=PatternMatch("m", "contains", "a")), rule("off", enabled=False)]
    import json

    spec = lambda c: json.dumps(c.__dict__)
    table = local_table(spark, [(r.id, r.enabled, "events", (r.condition.type, spec(r.condition))) for r in rules],
                        "id string, enabled boolean, input_ref string, condition struct<type:string,spec:string>")
    bodies = ['{"v":%s,"m":"%s"}' % (v, m) for v, m in ((20.5, "a"), (3, "b"), (99, "ba"))] + ["{}", '{"w":20.5}']
    records = json_records(spark, list(enumerate(bodies)))
    key = lambda df: sorted(map(tuple, df.select("rule_id", "seq", "triggered", "measure").collect()), key=str)
    assert key(push_verdicts(records, rules)) == key(table_verdicts(records, table, ["v", "w", "m", "none"]))


def test_only_referenced_columns_are_read(spark, tmp_path):
    spark.range(5).selectExpr("timestamp_seconds(id) t", "id", "id * 1.0D a", "id b", "'x' c").write.parquet(str(tmp_path / "t"))
    records = as_records(spark.read.parquet(str(tmp_path / "t")), "t", "id")
    plan = push_verdicts(records, [rule(condition=Threshold("a", ">", 1))])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<t:timestamp,id:bigint,a:double>" in plan or "struct<t:timestamp,id:bigint,a:double>" in plan
    assert T.StructType  # plan text only


NESTED = ['{"user":{"name":"ann","age":30,"tags":["x","y"]},"tags":["a","b",3],"level":"ERROR","n":5}',
          '{"user":{"name":7,"tags":"x"},"tags":"a","level":"INFO","n":"5"}', '{"user":null,"level":"abc"}']


@pytest.mark.parametrize("text, want", [
    ('(record.level) == "ERROR"', {0: True, 1: False, 2: False}),
    ('"ERROR" == ((record.level))', {0: True, 1: False, 2: False}),
    ('record.user.name == "ann"', {0: True, 1: False, 2: False}),
    ('record.user?.age >= 30', {0: True}),
    ('record["user"].age + 1 > 30', {0: True}),
    ('record.tags[0] == "a"', {0: True, 1: False, 2: False}),
    ('record.user.tags[1] == "y" && record.n == 5', {0: True, 1: False, 2: False}),
    ('"a" in record.tags', {0: True}),
    ("3 in record.tags && !(4 in record.tags)", {0: True}),
    ('"x" in record.user.tags', {0: True}),
    ("len(record.tags) == 3", {0: True, 1: False}),
    ('len(record.user.name) == 3', {0: True}),
    ('string(record.n) == "5"', {0: True, 1: True}),
    ("int(record.level) > 3 || record.n == 5", {0: True}),
    ("int(record.n) == 5", {0: True, 1: True}),
    ('cast(record.level as int) > 3 || record.n == 5', {0: True}),
    ('concat(record.level, "x") == "ERRORx"', {0: True, 1: False, 2: False}),
    ('coalesce(record.user.age, 0) >= 0', {0: True, 1: True, 2: True}),
])
def test_nested_fields_and_lists(spark, text, want):
    rules = [Expression(text), Expression("record.n == 5")]
    assert not rules[0].errors()
    assert {k: v[0] for k, v in outcomes(spark, NESTED, rules[0]).items()} == want


@pytest.mark.parametrize("text, hint", [
    ("(record.a ?? 0) > 1", "coalesce"), ("record.a ** 2 > 4", "pow"), ("record.a in 1..9", "BETWEEN"), ('record.a + "x" == "ax"', "concat"),
    ("max(record.a, 2) > 1", "greatest"), ("any(record.tags, # == 1)", "in record.list"),
])
def test_other_spellings_are_named(spark, text, hint):
    assert hint in Expression(text).errors()[0]


def test_paths_through_typed_values_are_errors(spark):
    df = local_table(spark, [(T0, 0, 1.0, "a", ["x"], (5,))], "at timestamp, seq bigint, v double, m string, l array<string>, s struct<n:int>")
    records = as_records(df, "at", "seq")
    texts = ["record.v.x == 1", 'record.m["x"] == 1', "record.l.x == 1", "record.s.n.x != 1", "record.at.x == nil", "record.s[0] == 5",
             "record.s.n == 5", "record.s.other == nil", "record.none.x == nil", 'record.l[0] == "x"', "record.v == 1"]
    rules = [rule(t, condition=Expression(t)) for t in texts]
    kind = records.schema["record"].dataType
    assert [bool(r.errors(kind)) for r in rules] == [True] * 6 + [False] * 5
    assert rules[0].errors(kind) == ["expression: record.v is double, it has no member 'x'"]
    assert {r["rule_id"]: r["triggered"] for r in push_verdicts(records, rules).collect()} == dict.fromkeys(texts[6:], True)
    assert sorted(r["rule_id"] for r in plan_alerts(records, rules).skipped.collect()) == sorted(texts[:6])
    assert not any(r.errors(json_records(spark, []).schema["record"].dataType) for r in rules)
