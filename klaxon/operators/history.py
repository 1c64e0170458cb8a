"""Lists, drill-down and export over the history tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durations import clock_duration_ns
from .payloads import rfc3339

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
EXPORT_COLUMNS = ("id", "rule_id", "triggered_at", "resolved_at", "last_value")


def parse_limit(text: str | int | None) -> int:
    """Page size: 100 by default or when invalid, at most 1000."""
    try:
        n = int(text)
    except (TypeError, ValueError):
        return DEFAULT_LIMIT
    return DEFAULT_LIMIT if n <= 0 else min(n, MAX_LIMIT)


def _page(limit: int) -> int:
    return limit if limit > 0 else DEFAULT_LIMIT


def recent_incidents(incidents: DataFrame, limit: int = DEFAULT_LIMIT, rule_id: str | None = None) -> DataFrame:
    """Newest incidents first (per-partition top-k, then merged)."""
    rows = incidents if rule_id is None else incidents.where(F.col("rule_id") == rule_id)
    return rows.orderBy(F.desc("triggered_at"), "id").limit(_page(limit))


def recent_notifications(notifications: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return notifications.orderBy(F.desc("sent_at"), "id").limit(_page(limit))


def incident_drilldown(incidents: DataFrame, notifications: DataFrame, incident_id: str | None = None) -> DataFrame:
    """Incidents with status and their notifications in sending order."""
    if incident_id is not None:
        incidents = incidents.where(F.col("id") == incident_id)
        notifications = notifications.where(F.col("incident_id") == incident_id)
    return with_notifications(incidents, notifications).withColumn(
        "status", F.when(F.col("resolved_at").isNull(), "firing").otherwise("resolved"))


def with_notifications(incidents: DataFrame, notifications: DataFrame) -> DataFrame:
    """Incidents with their notifications as one array (bounded by what one incident sent)."""
    columns = ["sent_at", "id"] + [c for c in notifications.columns if c not in ("sent_at", "id")]
    nested = notifications.groupBy("incident_id").agg(
        F.sort_array(F.collect_list(F.struct(*columns))).alias("notifications"))
    empty = F.array().cast(nested.schema["notifications"].dataType)
    return (
        incidents.join(nested, incidents["id"] == nested["incident_id"], "left").drop("incident_id")
        .withColumn("notifications", F.coalesce("notifications", empty))
    )


def notified_subscriptions(subscriptions: DataFrame, notifications: DataFrame) -> DataFrame:
    """Subscriptions with at least one notification of any status."""
    return subscriptions.join(
        notifications.select(F.col("subscription_id").alias("id")), "id", "left_semi")


def by_name(table: DataFrame) -> DataFrame:
    """Rules or subscribers ordered by name."""
    return table.orderBy("name", "id")


def parse_since(text: str | None, now: datetime) -> datetime | None:
    """RFC 3339 time, or a non-negative duration before ``now``; None for no lower bound."""
    text = (text or "").strip()
    if not text:
        return None
    try:
        when = datetime.fromisoformat(text.replace("Z", "+00:00"))
        if when.tzinfo is not None and "T" in text:
            return when.astimezone(timezone.utc)
    except ValueError:
        pass
    ns = clock_duration_ns(text)
    if ns is None:
        raise ValueError("since: expected RFC 3339 or a duration such as 168h")
    if ns < 0:
        raise ValueError("since: duration must be non-negative")
    return now - timedelta(microseconds=ns // 1000)


def export_incidents(incidents: DataFrame, since: datetime | None = None, rule_id: str | None = None) -> DataFrame:
    """Export rows, all of them: optional rule, and incidents triggered at or after ``since``."""
    rows = incidents
    if rule_id:
        rows = rows.where(F.col("rule_id") == rule_id)
    if since is not None:
        from .windows import micros

        rows = rows.where(F.col("triggered_at") >= F.timestamp_micros(F.lit(micros(since))))
    return rows.select(
        "id", "rule_id", rfc3339(F.col("triggered_at")).alias("triggered_at"),
        F.coalesce(rfc3339(F.col("resolved_at")), F.lit("")).alias("resolved_at"),
        F.coalesce("last_value", F.lit("")).alias("last_value"))


def write_export(incidents: DataFrame, path: str, fmt: str = "json", **filters) -> None:
    """Write the export as ``json`` lines or ``csv`` with a header."""
    rows = export_incidents(incidents, **filters)
    fmt = fmt.strip().lower() or "json"
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    elif fmt == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError("format must be json or csv")
