"""The OK / FIRING state of each rule, its incidents and live state.

Per (slice, rule) the verdicts collapse into *runs* of equal outcome. Only the first and the
last run of a slice depend on other slices; they are stitched per rule on a table of at most
two rows per slice, while all other runs are complete incidents where they are. No task ever
holds a rule's whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timeline import Timeline


def to_ms(when: Column) -> Column:
    """History tables keep millisecond timestamps."""
    return F.date_trunc("millisecond", when)


def incident_id(rule_id: Column, open_at: Column, open_seq: Column) -> Column:
    """Deterministic id, so a rerun names the same incident the same way."""
    return F.sha2(F.concat_ws("|", rule_id, F.unix_micros(open_at).cast("string"), open_seq.cast("string")), 256)


def sliced(verdicts: DataFrame, timeline: Timeline) -> DataFrame:
    """Add the slice to verdicts that do not carry one yet (scheduled rules)."""
    if "slice" in verdicts.columns:
        return verdicts
    return verdicts.withColumn("slice", timeline.slice_of(F.col("now"), F.col("seq")))


def _in_order() -> W:
    return W.partitionBy("slice", "rule_id").orderBy("now", "seq")


def _point(*extra: str) -> Column:
    return F.struct("now", "seq", "measure", "detail", "slice", *extra)


def local_runs(verdicts: DataFrame) -> DataFrame:
    """First row of every run of equal outcomes inside a (slice, rule).

    ``first`` / ``last`` mark the outer runs of the slice; ``next`` is where the run ends.
    """
    w = _in_order()
    starts = (
        verdicts.withColumn("prev", F.lag("triggered").over(w))
        .where(F.col("prev").isNull() | (F.col("prev") != F.col("triggered")))
    )
    following = F.lead(_point()).over(w)
    return starts.select(
        "rule_id", "now", "seq", "triggered", "measure", "detail", "slice",
        F.col("prev").isNull().alias("first"), following.alias("next"),
    ).withColumn("last", F.col("next").isNull())


def open_seeds(open_incidents: DataFrame) -> DataFrame:
    """Incidents still open from an earlier batch, as runs that precede everything."""
    runs = open_incidents.select(
        "rule_id", F.col("open_at").alias("now"), F.col("open_seq").alias("seq"), F.lit(True).alias("triggered"),
        F.col("open_measure").alias("measure"), F.col("open_detail").alias("detail"), F.lit(-1).alias("slice"),
        F.lit(True).alias("first"),
    )
    return runs.withColumn("next", F.when(F.lit(False), _point())).withColumn("last", F.lit(True))


def incidents_of(runs: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Incidents: one row per firing period, with the tick that closed it (if any).

    Columns: incident_id, rule_id, open_at, open_seq, open_slice, open_measure, open_detail,
    close struct(now, seq, measure, detail, slice), carried (opened in an earlier batch).
    """
    rows = runs.withColumn("carried", F.lit(False))
    if seeds is not None:
        rows = rows.unionByName(open_seeds(seeds).withColumn("carried", F.lit(True)))
    outer = F.col("first") | F.col("last")
    rows = rows.where(outer | F.col("triggered")).withColumn(
        "group", F.when(outer, F.lit(-1)).otherwise(F.col("slice")))
    backwards = W.partitionBy("rule_id", "group").orderBy(F.desc("slice"), F.desc("now"), F.desc("seq"))
    carried_in = F.coalesce(F.lead("triggered").over(backwards), F.lit(False))
    ends = F.when(F.col("triggered"), F.col("next")).otherwise(_point())
    close = F.last(ends, ignorenulls=True).over(backwards.rowsBetween(W.unboundedPreceding, W.currentRow))
    opens = F.col("triggered") & (F.col("carried") | ~F.col("first") | ~F.col("carried_in"))
    return (
        rows.withColumn("carried_in", carried_in).withColumn("close", close).where(opens)
        .select(
            incident_id(F.col("rule_id"), F.col("now"), F.col("seq")).alias("incident_id"), "rule_id",
            F.col("now").alias("open_at"), F.col("seq").alias("open_seq"), F.col("slice").alias("open_slice"),
            F.col("measure").alias("open_measure"), F.col("detail").alias("open_detail"), "close", "carried",
        )
    )


def transitions_of(incidents: DataFrame) -> DataFrame:
    """State changes: (rule_id, now, seq, prev, next, triggered_at, incident_id, triggered, measure, detail).

    ``triggered_at`` is set on opening changes only.
    """
    text, when = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    opened = F.struct(
        F.col("open_at").alias("now"), F.col("open_seq").alias("seq"), F.lit("ok").alias("prev"),
        F.lit("firing").alias("next"), F.col("open_at").alias("triggered_at"), F.lit(True).alias("triggered"),
        F.col("open_measure").alias("measure"), F.coalesce(F.col("open_detail"), text).alias("detail"))
    closed = F.struct(
        F.col("close.now").alias("now"), F.col("close.seq").alias("seq"), F.lit("firing").alias("prev"),
        F.lit("ok").alias("next"), when.alias("triggered_at"), F.lit(False).alias("triggered"),
        F.col("close.measure").alias("measure"), F.coalesce(F.col("close.detail"), text).alias("detail"))
    changes = F.filter(
        F.array(F.when(~F.col("carried"), opened), F.when(F.col("close").isNotNull(), closed)),
        lambda c: c.isNotNull())
    return incidents.select("rule_id", "incident_id", F.inline(changes))


def firing_ticks(verdicts: DataFrame, incidents: DataFrame, timeline: Timeline) -> DataFrame:
    """Every firing tick with its incident, and the previous tick of the same run and slice."""
    w = _in_order()
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    changed = F.col("prev").isNull() | (F.col("prev") != F.col("triggered"))
    start = F.struct(F.col("now").alias("open_at"), F.col("seq").alias("open_seq"))
    ticks = (
        verdicts.withColumn("prev", F.lag("triggered").over(w))
        .withColumn("run", F.last(F.when(changed, start), ignorenulls=True).over(so_far))
        .withColumn("runs", F.sum(changed.cast("int")).over(so_far))
        .withColumn("prev_now", F.when(~changed, F.lag("now").over(w)))
        .where("triggered").drop("prev")
    )
    spans = incidents.where(
        F.coalesce(F.col("close.slice"), F.lit(timeline.slices - 1)) > F.col("open_slice")
    ).select(
        "rule_id",
        F.explode(F.sequence(F.col("open_slice") + 1, F.coalesce(F.col("close.slice"), F.lit(timeline.slices - 1))))
        .alias("slice"),
        F.struct("open_at", "open_seq").alias("span"), "carried",
    )
    began = F.when(F.col("runs") == 1, F.coalesce("span", "run")).otherwise(F.col("run"))
    carried = (F.col("runs") == 1) & F.col("span").isNotNull() & F.col("carried")
    return (
        ticks.join(spans, ["rule_id", "slice"], "left")
        .select("rule_id", "now", "seq", "measure", "detail", "prev_now",
                began["open_at"].alias("open_at"), began["open_seq"].alias("open_seq"),
                F.coalesce(carried, F.lit(False)).alias("carried"))
    )


def last_verdicts(verdicts: DataFrame) -> DataFrame:
    """Latest verdict per rule (hash aggregate, combined before the shuffle)."""
    return verdicts.groupBy("rule_id").agg(
        F.max_by(F.struct("now", "triggered", "measure", "detail"), F.struct("now", "seq")).alias("last")
    ).select("rule_id", F.col("last.now").alias("last_eval_at"), "last.triggered", "last.measure", "last.detail")


def live_states(
    last: DataFrame,
    incidents: DataFrame,
    templates: DataFrame,
    errors: DataFrame | None = None,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Current state per rule.

    ``errors`` are failed scheduled evaluations (rule_id, now, error): they move last_eval_at and
    last_error but not the state, and a later good tick does not clear the text. ``previous`` is the
    carried live_states table.
    """
    from .verdicts import with_value

    still_open = incidents.where(F.col("close").isNull()).select(
        "rule_id", to_ms(F.col("open_at")).alias("triggered_at"), "incident_id")
    now = with_value(last, templates, into="last_value").join(still_open, "rule_id", "left").select(
        "rule_id", F.when(F.col("triggered"), "firing").otherwise("ok").alias("state"), "triggered_at",
        "last_eval_at", "last_value", F.lit(None).cast("string").alias("last_error"), "incident_id")
    if errors is None and previous is None:
        return now.withColumn("last_eval_at", to_ms(F.col("last_eval_at")))
    good = F.struct("last_eval_at", "state", "triggered_at", "last_value", "incident_id")
    parts = [now.select("rule_id", good.alias("good"), F.col("last_eval_at").alias("at"),
                        F.lit(None).cast("struct<at:timestamp,error:string>").alias("bad"))]
    if previous is not None:
        bad = F.struct(F.timestamp_micros(F.lit(0)).alias("at"), F.col("last_error").alias("error"))
        parts.append(previous.select(
            "rule_id", good.alias("good"), F.col("last_eval_at").alias("at"),
            F.when(F.col("last_error").isNotNull(), bad).alias("bad")))
    if errors is not None:
        parts.append(errors.select(
            "rule_id", F.lit(None).cast(now.select(good.alias("g")).schema["g"].dataType).alias("good"),
            F.col("now").alias("at"), F.struct(F.col("now").alias("at"), "error").alias("bad")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    merged = union.groupBy("rule_id").agg(
        F.max_by("good", "good.last_eval_at").alias("good"), F.max("at").alias("at"), F.max("bad").alias("bad"))
    return merged.select(
        "rule_id", F.coalesce("good.state", F.lit("ok")).alias("state"), "good.triggered_at",
        to_ms(F.col("at")).alias("last_eval_at"), F.coalesce("good.last_value", F.lit("")).alias("last_value"),
        F.col("bad.error").alias("last_error"), "good.incident_id")


def incident_table(incidents: DataFrame, templates: DataFrame) -> DataFrame:
    """The stored form: id, rule_id, triggered_at, resolved_at, last_value (frozen when opened)."""
    from .verdicts import with_value

    shown = with_value(incidents.withColumn("triggered", F.lit(True)), templates,
                       measure="open_measure", detail="open_detail", into="last_value")
    return shown.select(F.col("incident_id").alias("id"), "rule_id", to_ms(F.col("open_at")).alias("triggered_at"),
                        to_ms(F.col("close.now")).alias("resolved_at"), "last_value")
