"""Rules, conditions and table schemas.

A condition turns a record (push) or a set of window aggregates (scheduled) into a
verdict: ``triggered`` (NULL = no verdict), ``measure`` (the number shown in the value
text, NULL = empty text) and optionally ``detail`` (ready-made text). Value text is built
from ``measure`` by :func:`klaxon.operators.verdicts.with_value`, only for the few rows
that are kept, so it never travels through a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .functions import expressions as X
from .functions.fields import OPS, compare, unreachable
from .functions.gotext import double_literal, duration_text, quoted
from .functions.patterns import java_pattern, pattern_error

PUSH, SCHEDULED = "push", "scheduled"
SEVERITIES = ("info", "warning", "critical")
AGGREGATES = ("avg", "sum", "min", "max", "count")

SCHEMAS = {
    "rules": "id string, name string, description string, enabled boolean, severity string, "
             "labels map<string,string>, input_ref string, condition struct<type:string,spec:string>, "
             "schedule_ns bigint, created_at timestamp, updated_at timestamp",
    "subscribers": "id string, name string, channels array<struct<channel:string,address:string>>, "
                   "created_at timestamp, updated_at timestamp",
    "subscriptions": "id string, subscriber_id string, rule_id string, label_selector map<string,string>, "
                     "dwell_ns bigint, repeat_interval_ns bigint, notify_on_resolve boolean, one_shot boolean, "
                     "channel_filter array<string>, created_at timestamp, updated_at timestamp",
    "channels": "name string, type string, default_address string",
    "verdicts": "rule_id string, now timestamp, seq bigint, triggered boolean, measure double, detail string",
    "incidents": "id string, rule_id string, triggered_at timestamp, resolved_at timestamp, last_value string",
    "live_states": "rule_id string, state string, triggered_at timestamp, last_eval_at timestamp, "
                   "last_value string, last_error string, incident_id string",
    "incident_sub_states": "incident_id string, subscription_id string, last_notified_at timestamp, "
                           "notify_count bigint, resolution_sent boolean",
    "notifications": "id string, incident_id string, subscription_id string, subscriber_id string, "
                     "channel string, address string, kind string, sent_at timestamp, status string, error string",
}


class Outcome(NamedTuple):
    triggered: Column
    measure: Column | None = None
    detail: Column | None = None


class Template(NamedTuple):
    """Value text: prefix, then the measure or the boolean, then suffix."""

    prefix: str
    shows: str  # "measure" | "triggered"
    suffix: str = ""


class Fields:
    """Collects the typed record fields (or window features) that conditions use."""

    def __init__(self, record_type=None, prefix: str = "f"):
        self.record_type = record_type
        self.prefix = prefix
        self.wanted: dict[tuple, str] = {}

    def name(self, *key) -> str:
        return self.wanted.setdefault(key, f"{self.prefix}{len(self.wanted)}")

    def number(self, field_name: str) -> Column:
        return F.col(self.name("number", field_name))

    def text(self, field_name: str) -> Column:
        return F.col(self.name("text", field_name))

    def string(self, field_name: str) -> Column:
        return F.col(self.name("string", field_name))

    def boolean(self, field_name: str) -> Column:
        return F.col(self.name("boolean", field_name))


@dataclass(frozen=True)
class Threshold:
    """A numeric record field against a constant; missing or non-numeric is false."""

    field: str
    op: str
    value: float
    type = "threshold"
    mode = PUSH

    def errors(self) -> list[str]:
        return ([] if self.field else ["threshold names no field"]) + (
            [] if self.op in OPS else [f"unknown comparison {self.op!r}"])

    def outcome(self, fields: Fields) -> Outcome:
        number = fields.number(self.field)
        return Outcome(F.coalesce(compare(self.op, number, self.value), F.lit(False)), number)

    def template(self) -> Template:
        return Template("", "measure", f" {self.op} {double_literal(self.value)}")


@dataclass(frozen=True)
class PatternMatch:
    """Substring or regular expression over the text of a field; missing is false."""

    field: str
    kind: str
    pattern: str
    type = "pattern_match"
    mode = PUSH

    def errors(self) -> list[str]:
        out = [] if self.field else ["pattern_match names no field"]
        if self.kind == "contains":
            out += [] if self.pattern else ["pattern_match has no pattern"]
        elif self.kind == "regex":
            problem = pattern_error(self.pattern)
            out += [f"pattern_match: {problem}"] if problem else []
        else:
            out.append(f"pattern_match knows no kind {self.kind!r}")
        return out

    def outcome(self, fields: Fields) -> Outcome:
        text = fields.text(self.field)
        hit = (F.contains(text, F.lit(self.pattern)) if self.kind == "contains"
               else F.rlike(text, F.lit(java_pattern(self.pattern))))
        return Outcome(F.coalesce(hit, F.lit(False)), F.when(text.isNotNull(), F.lit(1.0)))

    def template(self) -> Template:
        return Template(f"{self.field} ~ {quoted(self.pattern)} -> ", "triggered")


@dataclass(frozen=True)
class WindowAggregate:
    """An aggregate of a numeric field over a trailing window, on the rule's schedule."""

    field: str
    agg: str
    window_ns: int
    op: str
    value: float
    type = "window_aggregate"
    mode = SCHEDULED

    def errors(self) -> list[str]:
        out = [] if self.field else ["window_aggregate names no field"]
        out += [] if self.window_ns > 0 else ["window_aggregate needs a window above zero"]
        out += [] if self.agg in AGGREGATES else [f"window_aggregate knows no aggregate {self.agg!r}"]
        return out + ([] if self.op in OPS else [f"unknown comparison {self.op!r}"])

    def outcome(self, features: Fields) -> Outcome:
        value = F.col(features.name(self.agg, self.field, self.window_ns))
        return Outcome(F.coalesce(compare(self.op, value, self.value), F.lit(False)), value)

    def template(self) -> Template:
        return Template(f"{self.agg}({self.field},{duration_text(self.window_ns)})=", "measure",
                        f" {self.op} {double_literal(self.value)}")


@dataclass(frozen=True)
class SqlReturnsRows:
    """Fires when a query over a registered datasource returns enough rows."""

    data_source: str
    query: str
    min_rows: int = 1
    type = "sql_returns_rows"
    mode = SCHEDULED

    @property
    def needed(self) -> int:
        return self.min_rows if self.min_rows > 0 else 1

    def errors(self) -> list[str]:
        return ([] if self.data_source else ["sql_returns_rows names no data source"]) + (
            [] if self.query.strip() else ["sql_returns_rows has no query"])

    def template(self) -> Template:
        return Template("rows=", "measure", f" (>={self.needed}?)")


_FIELD_TYPES = {"number": "double", "text": "string", "string": "string", "boolean": "boolean", "present": "boolean",
                "texts": "array<string>", "numbers": "array<double>", "length": "int"}


@lru_cache(maxsize=100_000)
def _analysed(expr: str, mode: str) -> str | None:
    """Why Spark does not accept an expression as a condition, found by analysing it alone; None when it does."""
    fields = Fields()
    sql = X.to_sql(expr, mode, fields.name, fields.name)
    columns = [F.lit(None).cast(_FIELD_TYPES.get(key[0], "double") if mode == PUSH else "double").alias(name)
               for key, name in fields.wanted.items()]
    empty = SparkSession.getActiveSession().range(0).select(F.col("id"), *columns)
    try:
        kind = empty.select(F.expr(sql).alias("result")).schema["result"].dataType.simpleString()
    except PySparkException as err:
        return str(err).strip().splitlines()[0]
    return None if kind == "boolean" else f"the result is {kind}, not boolean"


@dataclass(frozen=True)
class Expression:
    """Spark SQL boolean text, or a function from :class:`Fields` to a boolean Column."""

    expr: str | Callable[[Fields], Column]
    eval_mode: str = ""
    type = "expression"

    @property
    def mode(self) -> str:
        return SCHEDULED if self.eval_mode == SCHEDULED else PUSH

    def errors(self) -> list[str]:
        if self.eval_mode not in ("", PUSH, SCHEDULED):
            return [f"expression knows no mode {self.eval_mode!r}"]
        if callable(self.expr):
            return []
        try:
            X.to_sql(self.expr, self.mode, lambda kind, name: "f", lambda agg, name, window: "f")
        except X.ExpressionError as err:
            return [f"expression: {err}"]
        session = SparkSession.getActiveSession()
        problem = None if session is None else _analysed(self.expr, self.mode)
        return [f"expression: {problem}"] if problem else []

    def outcome(self, fields: Fields) -> Outcome:
        if callable(self.expr):
            return Outcome(self.expr(fields), F.lit(1.0))
        from .functions.fields import static_kind

        sql = X.to_sql(
            self.expr, self.mode, fields.name, fields.name,
            lambda name: static_kind(fields.record_type, name),
        )
        return Outcome(F.expr(sql), F.lit(1.0))

    def template(self) -> Template:
        text = getattr(self.expr, "__name__", "expression") if callable(self.expr) else self.expr
        return Template(f"{X.summary(text)} -> ", "triggered")


_CONDITIONS: dict[str, Callable[[Mapping[str, Any]], Any]] = {
    "threshold": lambda s: Threshold(s.get("field", ""), s.get("op", ""), float(s.get("value", 0))),
    "pattern_match": lambda s: PatternMatch(s.get("field", ""), s.get("kind", ""), s.get("pattern", "")),
    "window_aggregate": lambda s: WindowAggregate(
        s.get("field", ""), s.get("agg", ""), int(s.get("window", 0)), s.get("op", ""), float(s.get("value", 0))),
    "sql_returns_rows": lambda s: SqlReturnsRows(
        s.get("data_source", ""), s.get("query", ""), int(s.get("min_rows", 0))),
    "expression": lambda s: Expression(s.get("expr", ""), s.get("mode", "")),
}


def register_condition(type_name: str, factory: Callable[[Mapping[str, Any]], Any]) -> None:
    """Add a condition type; its objects need ``mode``, ``errors``, ``outcome``, ``template``."""
    _CONDITIONS[type_name] = factory


def decode_condition(type_name: str, spec: str | Mapping[str, Any]):
    """Condition object from its ``type`` and JSON ``spec``; unknown types are an error."""
    if type_name not in _CONDITIONS:
        raise ValueError(f"unknown condition type {type_name!r}")
    return _CONDITIONS[type_name](json.loads(spec) if isinstance(spec, str) else spec)


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    input_ref: str
    condition: Any
    description: str = ""
    enabled: bool = True
    severity: str = "info"
    labels: Mapping[str, str] = field(default_factory=dict)
    schedule_ns: int = 0

    def errors(self, record_type: DataType | None = None) -> list[str]:
        """Why this rule cannot run; empty when it can. With the type of its records also what no such record can have."""
        out = [] if self.name else ["a rule needs a name"]
        out += [] if self.input_ref else ["a rule needs an input"]
        if self.condition is None:
            return out + ["a rule needs a condition"]
        if self.condition.mode == SCHEDULED and self.schedule_ns <= 0:
            out.append("a scheduled rule needs a schedule above zero")
        if self.severity not in ("",) + SEVERITIES:
            out.append("unknown severity")
        out += self.condition.errors()
        if not out and isinstance(self.condition, Expression) and isinstance(self.condition.expr, str):
            found = (unreachable(record_type, path) for path in X.paths(self.condition.expr))
            out += [f"expression: {problem}" for problem in dict.fromkeys(found) if problem]
        return out


def runnable(rules: Sequence[Rule], mode: str | None = None, record_type: DataType | None = None) -> list[Rule]:
    """Enabled rules that validate; the others are skipped, as their errors() tell."""
    return [r for r in rules if r.enabled and not r.errors(record_type) and mode in (None, r.condition.mode)]


def skipped(rules: Sequence[Rule], record_type: DataType | None = None) -> list[tuple[str, str]]:
    """(id, reason) of the enabled rules that cannot run."""
    return [(r.id, "; ".join(r.errors(record_type))) for r in rules if r.enabled and r.errors(record_type)]
