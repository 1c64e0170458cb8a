"""Push rules: many rules over one scan of the records."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import ACCESSORS, compare, number_field, record_kind, text_field
from ..functions.gotext import double_text
from ..functions.patterns import java_pattern
from ..model import OPS, PUSH, Fields, Rule, runnable
from ..session import lenient, local_table, materialize
from .timeline import Timeline


def extract(records: DataFrame, fields: Fields, *keep: Column) -> DataFrame:
    """Project the typed fields that the conditions asked for; nothing else is read."""
    columns = [ACCESSORS[kind](F.col("record"), fields.record_type, name).alias(alias)
               for (kind, name), alias in fields.wanted.items()]
    return records.select(*keep, *columns)


def _verdict(rule: Rule, fields: Fields) -> Column:
    outcome = rule.condition.outcome(fields)
    null = F.lit(None)
    measure = null if outcome.measure is None else outcome.measure
    detail = null if outcome.detail is None else outcome.detail
    return F.struct(
        F.lit(rule.id).alias("rule_id"),
        outcome.triggered.cast("boolean").alias("triggered"),
        measure.cast("double").alias("measure"),
        detail.cast("string").alias("detail"),
    )


def push_verdicts(records: DataFrame, rules: Sequence[Rule], timeline: Timeline | None = None) -> DataFrame:
    """One verdict per record and push rule on its input; errors (NULL) are no verdict.

    With a ``timeline`` the result is partitioned by ``slice``: the narrow records are
    exchanged once, before they are multiplied by the number of rules.
    """
    fields = Fields(record_kind(records))
    by_input: dict[str, list[Column]] = {}
    for rule in runnable(rules, PUSH, fields.record_type):
        by_input.setdefault(rule.input_ref, []).append(_verdict(rule, fields))
    routed = records.where(F.col("input_ref").isin(list(by_input)))
    base = extract(routed, fields, F.col("input_ref"), F.col("when").alias("now"), F.col("seq"))
    keys = ["now", "seq"]
    if timeline is not None:
        base = base.withColumn("slice", timeline.slice_of(F.col("now"), F.col("seq"))).repartition("slice")
        keys.append("slice")
    if not by_input:
        none = F.struct(F.lit("").alias("rule_id"), F.lit(None).cast("boolean").alias("triggered"),
                        F.lit(None).cast("double").alias("measure"), F.lit(None).cast("string").alias("detail"))
        by_input[""] = [none]
    verdicts = None
    for ref, columns in by_input.items():
        row = F.array(*columns)
        test = F.col("input_ref") == ref
        verdicts = F.when(test, row) if verdicts is None else verdicts.when(test, row)
    if len(by_input) == 1:
        verdicts = row
    with lenient(records.sparkSession):
        exploded = base.select(*keys, F.inline(verdicts))
    exploded = exploded.where(F.col("triggered").isNotNull())
    return exploded.select("rule_id", *keys[:2], "triggered", "measure", "detail", *keys[2:])


def value_templates(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """How each rule prints its value (one small row per rule)."""
    rows = [(r.id, *r.condition.template()) for r in rules if hasattr(r.condition, "template")]
    return local_table(spark, rows, "rule_id string, prefix string, shows string, suffix string")


def with_value(df: DataFrame, templates: DataFrame, triggered: str = "triggered",
               measure: str = "measure", detail: str = "detail", into: str = "value") -> DataFrame:
    """Add the value text to rows that carry a rule's measure."""
    t = templates.select(F.col("rule_id"), F.col("prefix").alias("_prefix"), F.col("shows").alias("_shows"),
                         F.col("suffix").alias("_suffix"))
    shown = F.when(F.col("_shows") == "measure", double_text(F.col(measure))).otherwise(
        F.col(triggered).cast("string"))
    text = F.coalesce(
        F.col(detail),
        F.when(F.col(measure).isNull(), F.lit("")),
        F.concat("_prefix", shown, "_suffix"),
        F.lit(""),
    )
    return df.join(t, "rule_id", "left").withColumn(into, text).drop("_prefix", "_shows", "_suffix")


def route(records: DataFrame, rules_df: DataFrame) -> DataFrame:
    """Enabled rules of each record's input: one row per (record, rule)."""
    routed = (rules_df.where("enabled").groupBy("input_ref")
              .agg(F.collect_list(F.col("id")).alias("rule_ids")))
    return (records.select("input_ref", "when", "seq").join(routed, "input_ref")
            .select("input_ref", "when", "seq", F.explode("rule_ids").alias("rule_id")))


TABLE_KINDS = ("threshold", "pattern_match")


def _checked(rules_df: DataFrame) -> DataFrame:
    """Enabled rules with their ``errors``; columns that matter to compiled rules only may be missing."""
    from .config import validate_rules

    for name, default in (("name", F.col("id")), ("severity", F.lit("info")), ("schedule_ns", F.lit(0).cast("bigint"))):
        if name not in rules_df.columns:
            rules_df = rules_df.withColumn(name, default)
    return validate_rules(rules_df.where(F.col("enabled")))


def table_problems(rules_df: DataFrame) -> DataFrame:
    """(id, reason) of the enabled rules that :func:`table_verdicts` does not run: invalid ones and other kinds."""
    checked = _checked(rules_df)
    other = F.when(~F.coalesce(F.col("condition.type"), F.lit("")).isin(*TABLE_KINDS), F.lit("rules of this kind are compiled, not run from a table"))
    reason = F.when(F.size("errors") > 0, F.array_join("errors", "; ")).otherwise(other)
    return checked.select("id", reason.alias("reason")).where(F.col("reason").isNotNull())


def table_verdicts(records: DataFrame, rules_df: DataFrame, field_names: Sequence[str] | None = None, salts: int = 8) -> DataFrame:
    """Threshold and pattern rules evaluated from a rules *table* of any length.

    Invalid rules and rules of other kinds give no verdict; :func:`table_problems` lists them. Records meet rules in a join on
    the input; a busy input is dealt into ``salts`` parts, each with all of its rules. ``field_names`` are the record fields that
    rules may reference, by default all that they do (their distinct names are read first). Records lacking a field yield ``false``.
    """
    kind = record_kind(records)
    record = F.col("record")
    spec = F.from_json("condition.spec", "struct<field:string,op:string,value:double,kind:string,pattern:string>")
    rules = _checked(rules_df).where((F.size("errors") == 0) & F.col("condition.type").isin(*TABLE_KINDS))
    rules = rules.select("input_ref", "id", F.col("condition.type").alias("type"), spec.alias("s"))
    java = F.when((F.col("type") == "pattern_match") & (F.col("s.kind") == "regex"), F.col("s.pattern"))
    # checked and translated once, not below the join; the stored size also tells Spark whether the rules can be broadcast
    rules = materialize(rules.withColumn("java", _java_patterns(java)), "table-rules")
    if field_names is None:
        field_names = sorted(r[0] for r in rules.select("s.field").distinct().collect())
    rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    none = F.create_map(F.lit(""), F.lit(None).cast("double")), F.create_map(F.lit(""), F.lit(None).cast("string"))
    numbers, texts = (F.create_map(*[c for n in field_names for c in (F.lit(n), read(record, kind, n))]) if field_names else none[i]
                      for i, read in enumerate((number_field, text_field)))
    joined = records.select("input_ref", F.col("when").alias("now"), "seq", numbers.alias("nums"), texts.alias("txts"),
                            F.pmod(F.xxhash64("when", "seq"), F.lit(salts)).cast("int").alias("salt")).join(rules, ["input_ref", "salt"])
    number = F.try_element_at("nums", F.col("s.field"))
    text = F.try_element_at("txts", F.col("s.field"))
    hit = F.when(F.col("s.kind") == "regex", F.rlike(text, F.col("java"))).otherwise(F.contains(text, F.col("s.pattern")))
    const = F.col("s.value")
    test = F.lit(None).cast("boolean")
    for op in OPS:
        test = F.when(F.col("s.op") == op, _compare_columns(op, number, const)).otherwise(test)
    is_threshold = F.col("type") == "threshold"
    return joined.select(
        F.col("id").alias("rule_id"), "now", "seq",
        F.coalesce(F.when(is_threshold, test).otherwise(hit), F.lit(False)).alias("triggered"),
        F.when(is_threshold, number).otherwise(F.when(text.isNotNull(), F.lit(1.0))).alias("measure"),
        F.lit(None).cast("string").alias("detail"),
    )


def _java_patterns(patterns: Column) -> Column:
    """Patterns in Java's spelling; distinct ones of a batch are translated once."""

    @F.pandas_udf("string")
    def translate(values: pd.Series) -> pd.Series:
        known = {p: java_pattern(p) for p in values.dropna().unique()}
        return pd.Series([known.get(p) for p in values], dtype=object)

    return translate(patterns)


def _compare_columns(op: str, a: Column, b: Column) -> Column:
    plain = ~F.isnan(a) & ~F.isnan(b)
    return {">": plain & (a > b), ">=": plain & (a >= b), "<": plain & (a < b), "<=": plain & (a <= b),
            "==": plain & (a == b), "!=": ~plain | (a != b)}[op]
