"""SQL rules as jobs of their own: one rule's failure or slowness is that rule's error and nobody else's.

A rule is evaluated at all of its ticks by one Spark job, and the jobs of several rules run at the same time in a scheduler pool. Each
job has a tag by which it is cancelled when its time is over. A job that fails while running is cut into halves of its ticks until the
ticks that fail stand alone, so f failing ticks of n cost about f log n jobs, and all others keep their verdicts.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark import InheritableThread
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SCHEDULED, Rule, SqlReturnsRows, runnable
from ..session import local_table, remove, shared_folder, track
from .sqlrules import Datasources, uses_tick
from .windows import cadence_us, micros

VERDICTS = "rule_id string, now timestamp, seq bigint, triggered boolean, measure double, detail string"
ERRORS = "rule_id string, now timestamp, error string"


@dataclass(frozen=True)
class JobLimits:
    """``evaluation`` is the time one tick may take (a job of n ticks has n times that), ``at_once`` the rules that run together, and
    ``pool`` the scheduler pool of their jobs."""

    evaluation: timedelta = timedelta(seconds=30)
    at_once: int = 8
    pool: str = "sql-rules"


def ticks_of(rule: Rule, start: datetime, end: datetime, after: datetime | None = None) -> list[datetime]:
    """Ticks of a rule's own schedule from ``start`` to ``end``, only those later than ``after`` if given."""
    every, span = cadence_us(rule.schedule_ns), micros(end) - micros(start)
    first = 0 if after is None else max(0, (micros(after) - micros(start)) // every + 1)
    return [start + timedelta(microseconds=i * every) for i in range(first, span // every + 1)]


def reason_of(err: BaseException) -> str:
    """First line of the innermost cause: what went wrong in the query, not in the job around it."""
    text, cause = str(err), getattr(err, "_origin", None) or getattr(err, "java_exception", None)
    while cause is not None:
        text = cause.getMessage() or text
        cause = cause.getCause()
    lines = text.strip("'\"").splitlines()
    return lines[0] if lines else type(err).__name__


class _Overdue(Exception):
    pass


@dataclass
class _Evaluation:
    """All ticks of one rule, in the thread it is given."""

    sources: Datasources
    rule: Rule
    folder: str
    limits: JobLimits
    written: list[str] = field(default_factory=list)
    errors: list[tuple] = field(default_factory=list)

    def run(self, due: Sequence[tuple[int, datetime]]) -> None:
        self.sources.spark.sparkContext.setLocalProperty("spark.scheduler.pool", self.limits.pool)
        lateral = uses_tick(self.rule.condition.query)
        waiting = [list(due)] if due else []
        while waiting:
            ticks = waiting.pop()
            try:
                self._job(ticks, lateral and len(ticks) > 1)
            except _Overdue:
                seconds = self.limits.evaluation.total_seconds() * len(ticks)
                self._failed(ticks, f"no result of {len(ticks)} evaluations within {seconds:g} s" if len(ticks) > 1 else
                             f"no result within {seconds:g} s")
            except Exception as err:
                if len(ticks) == 1 or not lateral or self._unplannable(err, ticks[0]):
                    self._failed(ticks, reason_of(err))
                else:
                    middle = len(ticks) // 2
                    waiting += [ticks[middle:], ticks[:middle]]

    def _unplannable(self, err: Exception, tick: tuple[int, datetime]) -> bool:
        """Whether the query cannot be planned at any tick (rather than only not be joined to ticks)."""
        if isinstance(err, KeyError):
            return True
        if not isinstance(err, AnalysisException):
            return False
        try:
            self._counts([tick], False).schema
        except Exception:
            return True
        return False

    def _failed(self, ticks: Sequence[tuple[int, datetime]], problem: str) -> None:
        self.errors += [(self.rule.id, tick, problem) for _, tick in ticks]

    def _counts(self, ticks: Sequence[tuple[int, datetime]], lateral: bool) -> DataFrame:
        c = self.rule.condition
        if lateral:
            return self.sources.count_by_tick(c.data_source, c.query, ticks)
        table = local_table(self.sources.spark, [(tick, i) for i, tick in ticks], "now timestamp, seq bigint")
        return self.sources.count_rows(c.data_source, c.query, ticks[0][1]).crossJoin(F.broadcast(table)).select("now", "seq", "n")

    def _job(self, ticks: Sequence[tuple[int, datetime]], lateral: bool) -> None:
        """Counts the rows at some ticks and writes their verdicts; ends early, and is cancelled, when its time is over."""
        context, tag = self.sources.spark.sparkContext, "rule-" + uuid.uuid4().hex
        done, overdue = threading.Event(), threading.Event()

        def watch() -> None:
            if done.wait(self.limits.evaluation.total_seconds() * len(ticks)):
                return
            overdue.set()
            while True:  # a job that starts only now has to be met as well
                context.cancelJobsWithTag(tag)
                if done.wait(0.5):
                    return

        path = f"{self.folder}/{tag}"
        watcher = threading.Thread(target=watch, daemon=True)
        context.addJobTag(tag)
        watcher.start()
        try:
            needed = self.rule.condition.needed
            self._counts(ticks, lateral).select(
                F.lit(self.rule.id).alias("rule_id"), "now", "seq", (F.col("n") >= needed).alias("triggered"),
                F.col("n").cast("double").alias("measure"), F.lit(None).cast("string").alias("detail")).write.parquet(path)
            self.written.append(path)
        except Exception:
            if overdue.is_set():
                raise _Overdue() from None
            raise
        finally:
            done.set()
            watcher.join()
            context.removeJobTag(tag)


def evaluate_sql_rules(
    sources: Datasources,
    rules: Sequence[Rule],
    ticks: Callable[[Rule], Sequence[datetime]] | Sequence[datetime],
    limits: JobLimits = JobLimits(),
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, errors) of SQL rules, each evaluated by jobs of its own when this is called.

    A tick whose evaluation fails, at planning or at run time, or takes too long has an error row and no verdict, so the rule's state stays as
    it was. Verdicts are stored in the shared folder; the driver holds ticks and errors only.
    """
    spark = sources.spark
    chosen = [r for r in runnable(rules, SCHEDULED) if isinstance(r.condition, SqlReturnsRows)]
    folder = f"{shared_folder(spark)}/sql-rules-{uuid.uuid4().hex}"
    runs = [(_Evaluation(sources, r, folder, limits), list(enumerate(ticks(r) if callable(ticks) else ticks))) for r in chosen]

    def inherited(run: _Evaluation, due: list) -> None:
        """Job tags and pools belong to the JVM thread, which an inheritable thread has to itself."""
        problems: list[BaseException] = []

        def body() -> None:
            try:
                run.run(due)
            except BaseException as err:  # handed to the caller below
                problems.append(err)

        thread = InheritableThread(target=body)
        thread.start()
        thread.join()
        if problems:
            raise problems[0]

    with ThreadPoolExecutor(max(1, limits.at_once)) as threads:
        for outcome in [threads.submit(inherited, run, due) for run, due in runs]:
            outcome.result()
    track(folder)
    written = [p for run, _ in runs for p in run.written]
    errors = [e for run, _ in runs for e in run.errors]
    verdicts = spark.read.schema(VERDICTS).parquet(*written) if written else local_table(spark, [], VERDICTS)
    return verdicts, local_table(spark, errors, ERRORS)


__all__ = ["JobLimits", "evaluate_sql_rules", "reason_of", "ticks_of"]
