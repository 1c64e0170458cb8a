"""Pruning and archiving of resolved incidents."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import with_notifications
from .windows import micros


@dataclass(frozen=True)
class History:
    incidents: DataFrame
    notifications: DataFrame
    sub_states: DataFrame


def candidates(incidents: DataFrame, cutoff: datetime) -> DataFrame:
    """Incidents resolved strictly before the cutoff; open ones are never candidates."""
    return incidents.where(F.col("resolved_at") < F.timestamp_micros(F.lit(micros(cutoff))))


def keep(history: History, cutoff: datetime) -> History:
    """The tables without the candidates and everything that belongs to them."""
    gone = candidates(history.incidents, cutoff).select(F.col("id").alias("incident_id"))
    limit = F.timestamp_micros(F.lit(micros(cutoff)))
    return History(
        history.incidents.where(F.col("resolved_at").isNull() | (F.col("resolved_at") >= limit)),
        history.notifications.join(gone, "incident_id", "left_anti"),
        history.sub_states.join(gone, "incident_id", "left_anti"),
    )


def counts(history: History, cutoff: datetime) -> DataFrame:
    """How many rows a prune removes: (table_name, deleted)."""
    gone = candidates(history.incidents, cutoff).select(F.col("id").alias("incident_id"))
    parts = [
        ("incidents", gone),
        ("notifications", history.notifications.join(gone, "incident_id", "left_semi")),
        ("incident_sub_states", history.sub_states.join(gone, "incident_id", "left_semi")),
    ]
    out = None
    for name, rows in parts:
        row = rows.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table_name"), "deleted")
        out = row if out is None else out.unionByName(row)
    return out


def archive_entries(history: History, cutoff: datetime, archived_at: datetime) -> DataFrame:
    """One JSON object per candidate: incident, its notifications, archived_at."""
    gone = candidates(history.incidents, cutoff)
    nested = with_notifications(gone, history.notifications.join(
        gone.select(F.col("id").alias("incident_id")), "incident_id", "left_semi"))
    at = F.timestamp_micros(F.lit(micros(archived_at)))
    incident = F.struct(*gone.columns)
    return nested.select(
        F.col("id").alias("incident_id"), F.to_date(at).alias("archive_date"),
        F.to_json(F.struct(incident.alias("incident"), "notifications", at.alias("archived_at"))).alias("entry"))


def write_archive(entries: DataFrame, path: str) -> None:
    """Append JSON lines, one folder per archive day."""
    entries.select(F.col("entry").alias("value"), "archive_date").write.mode("append").partitionBy(
        "archive_date").text(path)


def prune(history: History, window: timedelta, now: datetime, archive_path: str | None = None,
          on_archive_error=None) -> History | None:
    """One pass: archive what is due (a failed archive does not stop the prune), return what stays.

    A window of zero or less disables pruning (None). The caller writes the returned tables as the new
    snapshot and schedules the passes.
    """
    if window <= timedelta(0):
        return None
    cutoff = now - window
    if archive_path is not None:
        try:
            write_archive(archive_entries(history, cutoff, now), archive_path)
        except Exception as err:
            if on_archive_error is not None:
                on_archive_error(err)
    return keep(history, cutoff)
