"""Message bodies per channel type, as string columns over outbox rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wire colours and markers the receivers know.
HEX_COLORS = {"resolved": "2EB67D", "critical": "E01E5A", "warning": "ECB22E", "other": "439FE0"}
SLACK_COLORS = {"resolved": "good", "critical": "danger", "warning": "warning", "other": "#439FE0"}
SLACK_EMOJI = {"resolved": ":white_check_mark:", "repeat": ":repeat:", "other": ":rotating_light:"}
SMS_MAX_BYTES = 480
ELLIPSIS = "…"

# Address rules: does the binding address get trimmed, is it mandatory, and the error without one.
_ROUTES = {
    "slack": (False, False, "slack: no webhook url configured"),
    "webhook": (False, False, "webhook: no url configured"),
    "pagerduty": (True, False, "pagerduty: no routing key configured"),
    "teams": (True, False, "teams: no webhook url configured"),
    "discord": (True, False, "discord: no webhook url configured"),
    "sms": (True, True, "sms: subscriber address (destination phone number) required"),
    "smtp": (False, True, "smtp: empty address"),
}


def destination(kind: Column, address: Column, default: Column) -> tuple[Column, Column]:
    """Where a message goes and, when there is nowhere, the send error."""
    target, error = F.coalesce(F.nullif(address, F.lit("")), default), F.lit(None).cast("string")
    for name, (trimmed, own, text) in _ROUTES.items():
        given = F.nullif(F.trim(address) if trimmed else address, F.lit(""))
        found = given if own else F.coalesce(given, F.nullif(default, F.lit("")))
        target = F.when(kind == name, found).otherwise(target)
        error = F.when((kind == name) & found.isNull(), F.lit(text)).otherwise(error)
    return target, error


def rfc3339(when: Column) -> Column:
    """UTC seconds, e.g. ``2024-01-01T00:00:07Z``, whatever the session time zone."""
    return F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _or(first: Column, second: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), second)


def _severity(trim: bool = True) -> Column:
    raw = F.lower(F.trim(_text("severity"))) if trim else _text("severity")
    return _or(raw, F.lit("info"))


def _pick(values: dict, severity: Column, kind: Column) -> Column:
    return (F.when(kind == "resolved", F.lit(values["resolved"])).when(severity == "critical", F.lit(values["critical"]))
            .when(severity == "warning", F.lit(values["warning"])).otherwise(F.lit(values["other"])))


def _json(column: Column) -> Column:
    return F.to_json(column, {"ignoreNullFields": "true"})


def _title() -> Column:
    return F.concat(F.lit("["), F.upper(_or(_text("kind"), F.lit("firing"))), F.lit("] "),
                    _or(_text("rule_name"), F.col("rule_id")))


def slack() -> Column:
    kind = _text("kind")
    emoji = F.when(kind == "resolved", SLACK_EMOJI["resolved"]).when(kind == "repeat", SLACK_EMOJI["repeat"]) \
        .otherwise(SLACK_EMOJI["other"])
    described = F.replace(F.replace(F.replace(_text("description"), F.lit("&"), F.lit("&amp;")),
                                    F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    text = F.concat(emoji, F.lit(" *["), _or(F.upper(_text("severity")), F.lit("INFO")), F.lit("]* `"),
                    F.upper(kind), F.lit("` — "), _text("rule_name"), F.lit("\n>"), described)
    field = lambda title, value: F.struct(
        F.lit(title).alias("title"), value.alias("value"), F.lit(True).alias("short"))
    attachment = F.struct(
        _pick(SLACK_COLORS, _text("severity"), kind).alias("color"),
        F.array(field("Value", _text("value")), field("Incident", _text("incident_id"))).alias("fields"),
        F.unix_seconds("now").alias("ts"))
    return _json(F.struct(text.alias("text"), F.array(attachment).alias("attachments")))


def webhook() -> Column:
    names = ("incident_id", "rule_id", "rule_name", "severity", "description", "value", "kind")
    return _json(F.struct(*[_text(n).alias(n) for n in names], rfc3339(F.col("now")).alias("now"),
                          rfc3339(F.col("triggered_at")).alias("triggered_at")))


def pagerduty(brand: str = "klaxon") -> Column:
    """Events v2 body; ``brand`` prefixes the dedup key and names the component."""
    name = _or(_text("rule_name"), F.col("rule_id"))
    head = F.concat(F.lit("["), _or(F.upper(_text("kind")), F.lit("FIRING")), F.lit("] "), name)
    summary = F.when(_text("value") != "", F.concat(head, F.lit(" — "), _text("value"))).otherwise(head)
    severity = _severity()
    body = F.struct(
        summary.alias("summary"), _or(_text("rule_id"), F.lit(brand)).alias("source"),
        F.when(severity.isin("critical", "warning"), severity).otherwise(F.lit("info")).alias("severity"),
        rfc3339(F.coalesce("triggered_at", "now")).alias("timestamp"), F.lit(f"{brand}-rule").alias("component"),
        F.col("rule_id").alias("group"), _text("kind").alias("class"),
        F.struct(*[_text(n).alias(n) for n in ("rule_id", "rule_name", "incident_id", "value", "description")])
        .alias("custom_details"))
    resolve = F.col("kind") == "resolved"
    return _json(F.struct(
        F.col("destination").alias("routing_key"),
        F.when(resolve, "resolve").otherwise("trigger").alias("event_action"),
        F.concat(F.lit(f"{brand}:"), _text("incident_id")).alias("dedup_key"),
        F.when(~resolve, body).alias("payload")))


def _facts(entries: list[tuple[str, Column, Column | None]], extra: dict | None = None) -> Column:
    rows = []
    for name, value, needed in entries:
        row = F.struct(F.lit(name).alias("name"), value.alias("value"),
                       *[F.lit(v).alias(k) for k, v in (extra or {}).items()])
        rows.append(row if needed is None else F.when(needed, row))
    return F.array_compact(F.array(*rows))


def teams() -> Column:
    severity = _severity()
    facts = _facts([
        ("Rule", _or(_text("rule_name"), F.col("rule_id")), None),
        ("Kind", F.upper(_or(_text("kind"), F.lit("firing"))), None),
        ("Severity", F.upper(severity), None),
        ("Value", _text("value"), _text("value") != ""),
        ("Incident", _text("incident_id"), _text("incident_id") != ""),
        ("Triggered", rfc3339(F.col("triggered_at")), F.col("triggered_at").isNotNull()),
    ])
    return _json(F.struct(
        F.lit("MessageCard").alias("@type"), F.lit("https://schema.org/extensions").alias("@context"),
        _title().alias("summary"), _pick(HEX_COLORS, severity, _text("kind")).alias("themeColor"),
        _title().alias("title"), _text("description").alias("text"),
        F.array(F.struct(facts.alias("facts"))).alias("sections")))


def discord(brand: str = "klaxon") -> Column:
    severity = _severity()
    colors = {k: int(v, 16) for k, v in HEX_COLORS.items()}
    fields = _facts([
        ("Rule", _or(_text("rule_name"), F.col("rule_id")), None),
        ("Severity", F.upper(severity), None),
        ("Value", _text("value"), _text("value") != ""),
        ("Incident", _text("incident_id"), _text("incident_id") != ""),
    ], {"inline": True})
    embed = F.struct(
        _title().alias("title"), _pick(colors, severity, _text("kind")).alias("color"),
        F.nullif(_text("description"), F.lit("")).alias("description"), fields.alias("fields"),
        rfc3339(F.col("triggered_at")).alias("timestamp"))
    return _json(F.struct(F.lit(brand).alias("username"), F.array(embed).alias("embeds")))


def sms() -> Column:
    """Text body, cut to 480 bytes at a character boundary."""
    head = F.concat(
        F.lit("["), _or(F.upper(F.trim(_text("severity"))), F.lit("INFO")), F.lit("/"),
        _or(F.upper(F.trim(_text("kind"))), F.lit("FIRING")), F.lit("] "), _or(_text("rule_name"), F.col("rule_id")))
    body = F.concat_ws(
        " — ", head, F.nullif(_text("value"), F.lit("")), F.nullif(_text("description"), F.lit("")),
        F.when(_text("incident_id") != "", F.concat(F.lit("inc:"), F.col("incident_id"))))
    return truncate_bytes(body, SMS_MAX_BYTES, SMS_MAX_BYTES - len(ELLIPSIS.encode()))


def truncate_bytes(text: Column, limit: int, keep: int) -> Column:
    """Text longer than ``limit`` bytes, cut to the last whole character within ``keep`` bytes, plus an ellipsis."""
    raw = F.encode(text, "UTF-8")
    # A UTF-8 character has at most three continuation bytes (0x80-0xBF); step back to its start.
    cut = F.lit(keep)
    for back in (3, 2, 1, 0):
        lead = F.conv(F.hex(F.substring(raw, keep + 1 - back, 1)), 16, 10).cast("int")
        whole = ~lead.between(128, 191)
        cut = F.when(whole, F.lit(keep - back)).otherwise(cut)
    head = F.decode(F.substring(raw, F.lit(1), cut), "UTF-8")
    return F.when(F.octet_length(text) > limit, F.concat(head, F.lit(ELLIPSIS))).otherwise(text)


def email_subject() -> Column:
    return F.concat(F.lit("["), F.upper(_text("kind")), F.lit("] "), F.upper(_text("severity")), F.lit(": "),
                    _text("rule_name"))


def email_body() -> Column:
    lines = [("Rule:        ", _text("rule_name")), ("Severity:    ", _text("severity")),
             ("State:       ", _text("kind")), ("Value:       ", _text("value")),
             ("Incident:    ", _text("incident_id")), ("Triggered:   ", rfc3339(F.col("triggered_at")))]
    parts = [c for label, value in lines for c in (F.lit(label), value, F.lit("\n"))]
    return F.concat(*parts, F.lit("\n"), _text("description"), F.lit("\n"))


def email() -> Column:
    return _json(F.struct(email_subject().alias("subject"), email_body().alias("body")))


_RENDERERS: dict[str, Callable[[], Column]] = {
    "slack": slack, "webhook": webhook, "pagerduty": pagerduty, "teams": teams, "discord": discord, "sms": sms,
    "smtp": email,
}


def register_channel(type_name: str, render: Callable[[], Column]) -> None:
    """Add a channel type; ``render`` returns the payload column over outbox rows."""
    _RENDERERS[type_name] = render


def render(messages: DataFrame) -> DataFrame:
    """Outbox rows with their ``payload``, by channel type."""
    payload = F.lit(None).cast("string")
    for name, make in _RENDERERS.items():
        payload = F.when(F.col("channel_type") == name, make()).otherwise(payload)
    return messages.withColumn("payload", payload)
