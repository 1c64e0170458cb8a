"""Label matches are the same however they are cut into blocks, and common labels are spread over tasks."""

from pyspark.sql import functions as F

from klaxon.operators import matching
from klaxon.session import local_table
from support import audience, subscription

RULES = "id string, labels map<string,string>"


def test_blocks_keep_every_match(spark, monkeypatch):
    monkeypatch.setattr(matching, "BAND", 2, raising=False)
    monkeypatch.setattr(matching, "LIST", 3, raising=False)
    labels = [{"team": "ops"}, {"team": "ops", "env": "prod"}, {"env": ""}, {"env": None, "team": "dev"}, {}, None]
    selectors = [{"team": "ops"}, {"env": "prod", "team": "ops"}, {"env": ""}, {"team": "ops", "env": ""}, {"gone": "", "env": ""},
                 {"team": None}, {"team": "dev", "gone": "x"}, {}, None]
    rules = [(f"r{i % 17}", labels[i % len(labels)]) for i in range(40)] + [(None, labels[0]), (None, labels[4])]
    subs = [(f"s{i % 31}", selectors[i % len(selectors)]) for i in range(60)]
    expected = sorted(
        (r or "", s) for r, have in rules for s, want in subs
        if want and all(v is not None and ((have or {}).get(k) or "") == v for k, v in want.items()))
    got = matching.match_labels(local_table(spark, rules, RULES),
                                audience(spark, [subscription(s, selector=want) for s, want in subs]).subscriptions)
    assert sorted((r["rule_id"] or "", r["subscription_id"]) for r in got.collect()) == expected


def test_a_common_label_is_not_left_to_one_task(spark, monkeypatch):
    monkeypatch.setattr(matching, "BAND", 50, raising=False)
    monkeypatch.setattr(matching, "LIST", 50, raising=False)
    rules = local_table(spark, [(f"r{i}", {"team": "ops"}) for i in range(400)], RULES)
    subs = audience(spark, [subscription(f"s{i}", selector={"team": "ops"}) for i in range(400)]).subscriptions
    for found in (matching.match_labels(rules, subs), matching.match_subscriptions(rules, subs)):
        rows = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(rows) == 160_000 and 5 * max(rows) < sum(rows)


def test_all_matches_are_spread_and_keep_their_settings(spark, monkeypatch):
    monkeypatch.setattr(matching, "BAND", 50, raising=False)
    monkeypatch.setattr(matching, "LIST", 50, raising=False)
    rules = local_table(spark, [(f"r{i}", {"team": "ops"}) for i in range(300)], RULES)
    subs = audience(spark, [subscription(f"s{i}", selector={"team": "ops"}, dwell=i, resolve=None, once=i % 2 == 0, only=["mail", None])
                            for i in range(300)] + [subscription("direct", rule_id="r7", repeat=5)]).subscriptions
    found = matching.match_subscriptions(rules, subs)
    by_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by_task) == 90_001 and 5 * max(by_task) < sum(by_task)
    kept = found.where("rule_id = 'r7'").collect()
    assert sorted((r["subscription_id"], r["dwell_ns"], r["repeat_interval_ns"], r["notify_on_resolve"], r["one_shot"]) for r in kept) == sorted(
        [(f"s{i}", i * 10**9, 0, True, i % 2 == 0) for i in range(300)] + [("direct", 0, 5 * 10**9, True, False)])
    assert {tuple(r["channel_filter"] or ()) for r in kept} == {("mail", None), ()}
