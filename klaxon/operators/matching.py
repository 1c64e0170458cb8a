"""Which subscriptions hear about which rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_SUB = ("subscription_id", "subscriber_id", "dwell_ns", "repeat_interval_ns", "notify_on_resolve", "one_shot",
        "channel_filter")

# Most subscriptions and rules of one block of label matches. A block is walked by one task, one subscription after the other, and
# Spark holds the rows of one subscription and one block at once.
BAND, LIST = 1024, 1024


def _settings(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.withColumnRenamed("id", "subscription_id").withColumn(
        "notify_on_resolve", F.coalesce("notify_on_resolve", F.lit(True))).withColumn(
        "one_shot", F.coalesce("one_shot", F.lit(False)))


def match_direct(rules: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Subscriptions that name the rule."""
    return _settings(subscriptions).join(rules.select(F.col("id").alias("rule_id")), "rule_id").select("rule_id", *_SUB)


def _covers(selector: Column, labels: Column) -> Column:
    """Every selector pair equals the rule's label; an absent label reads as empty text."""
    value = lambda k: F.get(F.filter(labels, lambda label: label["key"] == k), F.lit(0))["value"]
    return F.forall(selector, lambda e: F.coalesce(value(e["key"]), F.lit("")) == e["value"])


def match_labels(rules: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Subscriptions whose label selector covers the rule's labels; empty selectors match nothing.

    Equal selectors and equal label sets are matched once, and these matches are stored. A selector
    meets label sets through its rarest pair (an equi-join), and the remaining pairs are then
    checked, so common pairs such as ``env=prod`` do not blow up the join. Pairs with an empty value
    also accept a missing label; selectors made of such pairs only are keyed by label name.
    """
    canonical = lambda m: F.sort_array(F.map_entries(m))
    labelled = rules.select(
        F.col("id").alias("rule_id"), canonical(F.coalesce("labels", F.create_map())).alias("label_set"))
    sets = labelled.groupBy("label_set").agg(F.count(F.lit(1)).alias("rules"))
    subs = subscriptions.where(F.col("rule_id").isNull() & (F.size(F.col("label_selector")) > 0)).withColumn(
        "selector", canonical(F.col("label_selector")))
    selectors = subs.groupBy("selector").agg(F.count(F.lit(1)).alias("subscriptions"))
    pairs = selectors.select("selector", "subscriptions", F.inline("selector").alias("k", "v"))

    label_pairs = sets.select("label_set", "rules", F.inline("label_set").alias("k", "v"))
    frequency = label_pairs.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    anchors = (
        pairs.where("v <> ''").join(frequency, ["k", "v"], "left")
        .groupBy("selector", "subscriptions")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("k"), F.col("v"))).alias("a"))
        .where("a.n > 0").select("selector", "subscriptions", "a.k", "a.v")
    )
    by_pair = anchors.join(label_pairs, ["k", "v"]).where(_covers(F.col("selector"), F.col("label_set")))

    blank = (
        pairs.groupBy("selector", "subscriptions").agg(F.max("v").alias("top"), F.min("k").alias("k"))
        .where("top = ''").select("selector", "subscriptions", "k")
    )
    # The names used by blank selectors are a vocabulary of label keys, not data.
    names = blank.agg(F.coalesce(F.collect_set("k"), F.array().cast("array<string>")).alias("ks")).scalar()
    filled = F.transform(F.filter("label_set", lambda e: e["value"] != ""), lambda e: e["key"])
    lacking = sets.select("label_set", "rules", F.explode(F.array_except(names, filled)).alias("k"))
    by_blank = blank.join(lacking, "k").where(_covers(F.col("selector"), F.col("label_set")))

    columns = ["selector", "label_set", "subscriptions", "rules"]
    found = materialize(by_pair.select(*columns).unionByName(by_blank.select(*columns)), "label-matches")
    return _expanded(_settings(subs.drop("rule_id")), found, labelled)


def _expanded(subs: DataFrame, found: DataFrame, labelled: DataFrame) -> DataFrame:
    """Every subscription of a selector with every rule of its label sets.

    This grows with the product of both, so it is made in blocks: a selector's subscriptions are dealt into bands, its
    rules into lists, and each band meets each list in some task. Only bands and lists are shuffled, and a selector or
    label set that is shared by most of a table is not left to one task.
    """
    sizes = found.groupBy("selector").agg(
        F.ceil(F.max("subscriptions") / BAND).alias("bands"), F.ceil(F.sum("rules") / LIST).alias("lists"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    heard = (
        sizes.join(subs, "selector").withColumn("band", F.pmod(F.xxhash64("subscription_id"), "bands"))
        .select("selector", "band", numbers("lists").alias("list"), *_SUB)
    )
    told = (
        found.select("selector", "label_set").join(labelled, "label_set").join(sizes, "selector")
        .withColumn("list", F.pmod(F.xxhash64("rule_id"), "lists"))
        .groupBy("selector", "bands", "list").agg(F.collect_list(F.struct("rule_id")).alias("members"))
        .select("selector", "bands", "list", F.col("members.rule_id").alias("rule_ids"))
        .select("selector", numbers("bands").alias("band"), "list", "rule_ids")
    )
    # The bytes of a block say nothing of the rows it makes, so its partitions are counted here and not merged by size. The
    # merge join walks subscriptions; had Spark broadcast them, it would hold all rows of a block.
    spark = subs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    block = ["selector", "band", "list"]
    return heard.repartition(n, *block).join(told.repartition(n, *block).hint("merge"), block).select(
        F.explode("rule_ids").alias("rule_id"), *_SUB)


def match_subscriptions(rules: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """All matches: named rules and label selectors, which exclude each other."""
    return match_direct(rules, subscriptions).unionByName(match_labels(rules, subscriptions))
