import random
from datetime import timedelta

import pytest

from klaxon.operators import windows
from klaxon import Expression, WindowAggregate
from klaxon.operators.windows import observe, schedule_grid, window_features, window_verdicts
from klaxon.session import local_table

from support import SEC, T0, at, json_records, rule

ALL = ("avg", "sum", "min", "max", "count")


def values(spark, records, tick, window=60, field="v", max_span=None, aggs=ALL):
    rules = [rule(a, condition=WindowAggregate(field, a, window * SEC, ">", 0), schedule_ns=SEC) for a in aggs]
    rows, _ = window_features(records, rules, at(tick), at(tick), max_span)
    return {r["rule_id"]: r["w0"] for r in rows.collect()}


def test_aggregates_and_no_data(spark):
    records = json_records(spark, [(0, '{"v":%d}' % v) for v in (10, 20, 30, 40)])
    assert values(spark, records, 0) == {"avg": 25, "sum": 100, "min": 10, "max": 40, "count": 4}
    assert values(spark, records, 0, field="nope") == {"avg": None, "sum": None, "min": None, "max": None, "count": 0}


def test_range_and_closed_lower_edge(spark):
    records = json_records(spark, [(-120, '{"v":99}'), (0, '{"v":5}')])
    assert values(spark, records, 0, aggs=["avg"]) == {"avg": 5}
    assert values(spark, records, 0, window=120, aggs=["count"]) == {"count": 2}
    assert values(spark, records, 0.5, window=120, aggs=["count"]) == {"count": 1}


def test_horizon(spark):
    records = json_records(spark, [(-7200, '{"v":1}'), (0, '{"v":1}')])
    day = 24 * 3600
    assert values(spark, records, 0, window=day, max_span=3600 * SEC, aggs=["count"]) == {"count": 1}
    assert values(spark, records, 0, window=day, max_span=0, aggs=["count"]) == {"count": 2}
    assert values(spark, records, 0, window=day, max_span=7200 * SEC, aggs=["count"]) == {"count": 1}  # strictly newer
    assert values(spark, records, 0, window=7200, max_span=day * SEC, aggs=["count"]) == {"count": 2}


def test_only_top_level_numbers_are_samples(spark):
    records = json_records(spark, [(0, '{"v":3.0,"msg":"hello","struct":{"nested":1}}')])
    rows = observe(records, ["v", "msg", "struct", "nested"]).collect()
    assert [(r["field"], r["v"]) for r in rows] == [("v", 3.0)]


def test_inputs_are_separate(spark):
    records = json_records(spark, [(0, '{"v":5}')], "a").unionByName(json_records(spark, [(0, '{"v":10}')], "b"))
    cond = WindowAggregate("v", "avg", 60 * SEC, ">", 0)
    rules = [rule("a", condition=cond, schedule_ns=SEC), rule("b", condition=cond, schedule_ns=SEC)]
    rules = [r.__class__(r.id, r.name, r.id, r.condition, schedule_ns=SEC) for r in rules]
    rows, _ = window_features(records, rules, at(0), at(0))
    assert {r["rule_id"]: r["w0"] for r in rows.collect()} == {"a": 5, "b": 10}


def test_cadence_rounds_up_to_seconds(spark):
    r = rule(condition=WindowAggregate("v", "avg", SEC, ">", 0), schedule_ns=1_500_000_000)
    ticks = [x["now"] for x in schedule_grid(spark, [r], at(0), at(7)).orderBy("tick").collect()]
    assert len(ticks) == 4 and ticks[1] - ticks[0] == timedelta(seconds=2)
    later = schedule_grid(spark, [r], at(0), at(7), after=at(2)).orderBy("tick").collect()
    assert [x["tick"] for x in later] == [2, 3]


def test_verdicts(spark):
    records = json_records(spark, [(0, '{"v":50}')])
    rules = [
        rule("w", condition=WindowAggregate("v", "avg", 10 * SEC, ">", 40), schedule_ns=10 * SEC),
        rule("zero", condition=Expression('avg_over("v", "5s") < 5', "scheduled"), schedule_ns=10 * SEC),
        rule("bad-window", condition=Expression('count_over("v", "-1d") == 0', "scheduled"), schedule_ns=10 * SEC),
        rule("stub", condition=Expression('regex_match("v", ".")', "scheduled"), schedule_ns=10 * SEC),
    ]
    rows = window_verdicts(records, rules, at(0), at(20)).orderBy("rule_id", "now").collect()
    got = {}
    for r in rows:
        got.setdefault(r["rule_id"], []).append(r["triggered"])
    assert got == {"w": [True, True, False], "zero": [False, True, True], "bad-window": [True] * 3, "stub": [False] * 3}


@pytest.mark.parametrize("window,schedule,most", [(60, 20, 32), (50, 20, 32), (7, 3, 32), (1.5, 1, 32), (5, 30, 32), (50, 20, 0), (7, 3, 0),
                                                  (1.5, 1, 0), (40, 1, 32)])
def test_panes_equal_direct_sums(spark, monkeypatch, window, schedule, most):
    monkeypatch.setattr(windows, "MOST_TICKS_PER_PANE", most)
    rng = random.Random(4)
    times = sorted(rng.choice([float(rng.randint(0, 90)), rng.uniform(0, 90)]) for _ in range(120))
    data = [(t, float(rng.randint(1, 9))) for t in times]
    df = local_table(spark, [("events", at(t), i, (v,)) for i, (t, v) in enumerate(data)],
                     "input_ref string, when timestamp, seq bigint, record struct<v:double>")
    rules = [rule(a, condition=WindowAggregate("v", a, int(window * SEC), ">", 0), schedule_ns=schedule * SEC) for a in ALL]
    rows, _ = window_features(df, rules, at(0), at(90))
    for r in rows.collect():
        now = (r["now"].timestamp() - T0.timestamp())
        inside = [v for t, v in data if round(now - window, 6) <= round(t, 6) <= now]
        want = {"avg": sum(inside) / len(inside) if inside else None, "sum": sum(inside) if inside else None,
                "min": min(inside, default=None), "max": max(inside, default=None), "count": len(inside)}[r["rule_id"]]
        assert r["w0"] == (pytest.approx(want) if want is not None else None), (r, want)
