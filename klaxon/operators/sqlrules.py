"""sql_returns_rows rules over registered datasources."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_table
from ..model import SCHEDULED, Rule, SqlReturnsRows, runnable


_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", re.DOTALL)


def _code(query: str) -> str:
    """A query without its string literals and comments."""
    return _QUOTED.sub(" ", query)


def uses_tick(query: str) -> bool:
    return re.search(r":tick\b", _code(query)) is not None


class Datasources:
    """Named sets of tables that SQL rules may query.

    A table is any DataFrame (files, catalog table, JDBC reader), or a function that gives one anew for each evaluation, as a stream
    needs it for tables that grow. Queries name tables in braces: ``select 1 from {orders} where ...``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._sources: dict[str, dict[str, DataFrame | Callable[[], DataFrame]]] = {}

    def register(self, name: str, tables: dict[str, DataFrame | Callable[[], DataFrame]]) -> "Datasources":
        self._sources[name] = dict(tables)
        return self

    def _used(self, name: str, query: str) -> dict[str, DataFrame]:
        tables = {k: v for k, v in self._sources[name].items() if "{" + k + "}" in _code(query)}
        return {k: v() if callable(v) else v for k, v in tables.items()}

    def rows(self, name: str, query: str, tick: datetime | None = None) -> DataFrame:
        """Rows of a query; ``:tick`` in it is the evaluation time."""
        if name not in self._sources:
            raise KeyError(f"datasource {name!r} is not registered")
        args = {"tick": tick} if uses_tick(query) else None
        return self.spark.sql(query, args=args, **self._used(name, query))

    def count_by_tick(self, name: str, query: str, ticks: Sequence[tuple[int, datetime]]) -> DataFrame:
        """(now, seq, n) of numbered ticks: result rows of a query at each, in one pass over its tables."""
        if name not in self._sources:
            raise KeyError(f"datasource {name!r} is not registered")
        text, at = "", 0
        for m in _QUOTED.finditer(query):
            text += re.sub(r":tick\b", "__ticks.now", query[at:m.start()]) + m.group()
            at = m.end()
        text += re.sub(r":tick\b", "__ticks.now", query[at:])
        table = local_table(self.spark, [(tick, i) for i, tick in ticks], "now timestamp, seq bigint")
        counted = self.spark.sql("select __ticks.now, __ticks.seq, __rows.n from {__t} as __ticks, lateral (select count(1) as n from ("
                                 + text + ")) as __rows", __t=table, **self._used(name, query))
        counted.schema  # analysed here, so that a query that cannot be joined is known at once
        return counted

    def count_rows(self, name: str, query: str, tick: datetime | None = None) -> DataFrame:
        """One row with the number of result rows (nothing else is fetched)."""
        return self.rows(name, query, tick).agg(F.count(F.lit(1)).alias("n"))


def sql_verdicts(
    sources: Datasources,
    rules: Sequence[Rule],
    ticks: Callable[[Rule], Sequence[datetime]] | Sequence[datetime],
) -> tuple[DataFrame, DataFrame]:
    """Evaluate SQL rules at the given ticks; returns (verdicts, errors).

    A rule whose query cannot be planned yields an error row and no verdict, so its state stays.
    Every rule is one query over all of its ticks: without ``:tick`` its rows are counted once, and with it the ticks are joined
    to the query laterally, so that its tables are read once. A query that cannot be joined so is run tick by tick.
    """
    spark, parts, errors = sources.spark, [], []
    for rule in runnable(rules, SCHEDULED):
        if not isinstance(rule.condition, SqlReturnsRows):
            continue
        c = rule.condition
        due = list(enumerate(ticks(rule) if callable(ticks) else ticks))
        if not due:
            continue
        if uses_tick(c.query):
            try:
                counted = sources.count_by_tick(c.data_source, c.query, due)
                parts.append(counted.select(
                    F.lit(rule.id).alias("rule_id"), "now", "seq", (F.col("n") >= c.needed).alias("triggered"),
                    F.col("n").cast("double").alias("measure"), F.lit(None).cast("string").alias("detail")))
                continue
            except (PySparkException, KeyError):
                pass
        for group in [[d] for d in due] if uses_tick(c.query) else [due]:
            try:
                counted = sources.count_rows(c.data_source, c.query, group[0][1])
            except Exception as err:
                problem = str(err).strip("'\"").splitlines()[0]
                errors += [(rule.id, tick, problem) for _, tick in group]
                continue
            at = F.explode(F.array(*(F.struct(F.lit(tick).cast("timestamp").alias("now"), F.lit(i).cast("bigint").alias("seq"))
                                     for i, tick in group)))
            parts.append(counted.select("n", at.alias("at")).select(
                F.lit(rule.id).alias("rule_id"), "at.now", "at.seq", (F.col("n") >= c.needed).alias("triggered"),
                F.col("n").cast("double").alias("measure"), F.lit(None).cast("string").alias("detail")))
    verdicts = parts[0] if parts else local_table(
        spark, [], "rule_id string, now timestamp, seq bigint, triggered boolean, measure double, detail string")
    for part in parts[1:]:
        verdicts = verdicts.unionByName(part)
    return verdicts, local_table(spark, errors, "rule_id string, now timestamp, error string")
