"""Incremental alerting with ``foreachBatch``.

Every micro-batch runs the batch operators, seeded with the state the previous one left. State and
results are tables keyed by ``batch_id`` and overwritten when Spark replays a batch, so a restart neither
loses nor repeats anything.

The tables a batch needs only itself are removed by the next one, and of the state the last two batches are kept.

Records are taken in event-time order: those newer than the watermark wait in ``pending``, those older
than the previous watermark go to ``quarantine`` with reason ``late``. With a delay of zero a batch is
processed whole. The incidents and messages are then those of one batch run over all records.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEDULED, Fields, Rule, SqlReturnsRows, runnable
from ..operators.sqljobs import JobLimits
from ..operators.sqlrules import Datasources
from ..operators.state import incident_table
from ..operators.verdicts import push_verdicts
from ..plans.alerting import AlertPlan, Carried, Subscribers, plan_alerts
from ..session import collecting, local_table, materialize, remove

STATE_TABLES = ("open_incidents", "sub_states", "live_states", "one_shot_used", "pending", "samples", "progress")


@dataclass
class AlertStream:
    """State folder, rules and audience of one alerting stream.

    ``start`` is the origin of the scheduled ticks. ``horizon`` bounds how far back windows reach; by
    default the longest window that any scheduled rule reads, in aggregates and in expressions. With ``datasources`` SQL rules run at the
    ticks that the watermark passes, over their tables as they are then.
    """

    folder: str
    rules: Sequence[Rule]
    audience: Subscribers
    start: datetime
    delay: timedelta = timedelta(0)
    horizon: timedelta | None = None
    datasources: Datasources | None = None
    limits: JobLimits = JobLimits()
    _scratch: list[str] = field(default_factory=list, repr=False)

    def table(self, spark: SparkSession, name: str, batch_id: int | None = None) -> DataFrame:
        """A state table after a batch, or the results of all batches (``batch_id`` None)."""
        if batch_id is None:
            return spark.read.parquet(f"{self.folder}/{name}")
        return spark.read.parquet(f"{self.folder}/{name}/batch_id={batch_id}")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch_id={batch_id}")

    @property
    def _scheduled(self) -> bool:
        return any(not isinstance(r.condition, SqlReturnsRows) for r in runnable(self.rules, SCHEDULED))

    def _reach(self) -> timedelta:
        if self.horizon is not None:
            return self.horizon
        features = Fields()
        for rule in runnable(self.rules, SCHEDULED):
            if not isinstance(rule.condition, SqlReturnsRows):
                rule.condition.outcome(features)
        longest = max([window_ns for _, _, window_ns in features.wanted], default=0)
        return timedelta(microseconds=-(-longest // 1000))

    def process(self, records: DataFrame, batch_id: int, final: bool = False) -> AlertPlan | None:
        """Handle one micro-batch; pass it (or a wrapper) to ``writeStream.foreachBatch``.

        ``final`` drains the waiting records at the end of a bounded stream.
        """
        remove(records.sparkSession, *self._scratch)
        with collecting() as self._scratch:
            return self._process(records, batch_id, final)

    def _process(self, records: DataFrame, batch_id: int, final: bool) -> AlertPlan | None:
        spark = records.sparkSession
        previous = batch_id - 1
        first = batch_id == 0
        old = None if first else {n: self.table(spark, n, previous) for n in STATE_TABLES if n != "samples" or self._scheduled}
        mark = None if first else old["progress"].first()["watermark"]
        arrived = materialize(records, "arrived")
        known = arrived if first else arrived.unionByName(old["pending"])
        newest = known.agg(F.max("when").alias("w")).first()["w"]
        if newest is None or mark is not None and newest < mark:
            newest = mark
        wait = timedelta(0) if final else self.delay
        watermark = None if newest is None else newest - wait
        if mark is not None and (watermark is None or watermark < mark):
            watermark = mark
        late = arrived.where(F.col("when") < mark) if mark is not None else arrived.limit(0)
        limit = F.lit(watermark).cast("timestamp")
        lower = F.lit(True) if mark is None else F.col("when") >= F.lit(mark).cast("timestamp")
        ready = materialize(known.where((F.col("when") <= limit) & lower), "ready")

        self._write(late.withColumn("reason", F.lit("late")), "quarantine", batch_id)
        self._write(known.where(F.col("when") > limit), "pending", batch_id)
        samples = None
        if self._scheduled:
            history = ready if first else ready.unionByName(old["samples"])
            reach = F.lit(datetime(1970, 1, 1) if watermark is None else watermark - self._reach())
            self._write(history.where(F.col("when") >= reach.cast("timestamp")), "samples", batch_id)
            samples = history
        carried = Carried() if first else Carried(old["open_incidents"], old["sub_states"], old["live_states"],
                                                  old["one_shot_used"])
        utc = lambda t: None if t is None else t.astimezone(timezone.utc)
        end = self.start - timedelta(seconds=1) if watermark is None else utc(watermark)
        plan = plan_alerts(ready, self.rules, self.audience, self.start, end, carried=carried, samples=samples,
                           after=utc(mark), datasources=self.datasources, limits=self.limits)
        self._results(plan, carried, batch_id)
        self._write(local_table(spark, [(utc(watermark),)], "watermark timestamp"), "progress", batch_id)
        remove(spark, *(f"{self.folder}/{name}/batch_id={batch_id - 2}" for name in (*STATE_TABLES, "all_sub_states")))
        return plan

    def _results(self, plan: AlertPlan, carried: Carried, batch_id: int) -> None:
        self._write(incident_table(plan.stored_incidents, plan.templates), "incidents", batch_id)
        self._write(plan.notifications, "notifications", batch_id)
        self._write(plan.live_states, "live_states", batch_id)
        self._write(plan.open_incidents, "open_incidents", batch_id)
        still_open = plan.open_incidents.select("incident_id")
        self._write(plan.sub_states, "all_sub_states", batch_id)
        self._write(self.table(plan.stored_incidents.sparkSession, "all_sub_states", batch_id)
                    .join(still_open, "incident_id", "left_semi"), "sub_states", batch_id)
        used = plan.deliveries.where("one_shot").select("subscription_id")
        if carried.notifications is not None:
            used = used.unionByName(carried.notifications.select("subscription_id"))
        self._write(used.distinct(), "one_shot_used", batch_id)

    def incidents(self, spark: SparkSession) -> DataFrame:
        """Latest row of every incident over all batches."""
        rows = self.table(spark, "incidents")
        return rows.groupBy("id").agg(
            F.max_by(F.struct("rule_id", "triggered_at", "resolved_at", "last_value"), "batch_id").alias("r")
        ).select("id", "r.*")


def deduplicated(records: DataFrame, delay: str) -> DataFrame:
    """Drop records delivered twice by at-least-once sources (same input and seq within ``delay``)."""
    return records.withWatermark("when", delay).dropDuplicatesWithinWatermark(["input_ref", "seq"])


def verdict_stream(records: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Stateless push verdicts of a streaming DataFrame."""
    return push_verdicts(records, rules)


__all__ = ["AlertStream", "deduplicated", "verdict_stream"]
