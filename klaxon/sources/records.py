"""Records: (input_ref, when, seq, record).

``record`` is a STRUCT for tables and a VARIANT for JSON. All adapters are plain projections and work
on static and streaming DataFrames alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_INPUT = "events"


def as_records(
    df: DataFrame,
    when: str | Column,
    seq: str | Column,
    input_ref: str | Column = DEFAULT_INPUT,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Records of a typed table. ``input_ref`` is a name or a column; blank names become the default.

    Columns no rule uses are never read: the struct is taken apart again by the optimizer.
    """
    ref = F.coalesce(F.nullif(input_ref, F.lit("")), F.lit(DEFAULT_INPUT)) if isinstance(input_ref, Column) \
        else F.lit(input_ref or DEFAULT_INPUT)
    at = F.col(when) if isinstance(when, str) else when
    order = F.col(seq) if isinstance(seq, str) else seq
    return df.select(ref.alias("input_ref"), at.cast("timestamp").alias("when"), order.cast("bigint").alias("seq"),
                     F.struct(*(fields or df.columns)).alias("record"))


def parse_object(body: Column) -> Column:
    """VARIANT of a JSON object; NULL for anything else (empty, invalid, array, scalar, null)."""
    value = F.try_parse_json(body)
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value)


def decode_json(messages: DataFrame, body: str = "body", keep: Sequence[str] = ("input_ref", "when", "seq")) -> DataFrame:
    """Messages with a JSON body as records; see :func:`quarantine` for the rest."""
    return messages.select(*keep, parse_object(F.col(body)).alias("record")).where(F.col("record").isNotNull())


def quarantine(messages: DataFrame, body: str = "body") -> DataFrame:
    """Messages that are no JSON object, as they came, with a reason."""
    value = F.try_parse_json(F.col(body))
    reason = (
        F.when(F.coalesce(F.trim(F.col(body)), F.lit("")) == "", "empty")
        .when(value.isNull(), "invalid json").otherwise("not an object")
    )
    return messages.where(parse_object(F.col(body)).isNull()).withColumn("reason", reason)


def kafka_messages(kafka: DataFrame) -> DataFrame:
    """Messages of the Kafka source schema: the topic names the input, the message time is the clock."""
    shift = F.shiftleft(F.col("offset").cast("bigint"), 10)
    return kafka.select(
        F.col("topic").alias("input_ref"), F.col("value").cast("string").alias("body"),
        F.coalesce(F.col("timestamp"), F.current_timestamp()).alias("when"),
        (shift + F.pmod(F.col("partition"), F.lit(1024))).alias("seq"), "partition", "offset")


def kafka_records(kafka: DataFrame) -> DataFrame:
    return decode_json(kafka_messages(kafka))


def queue_records(df: DataFrame, name: str, body: str, when: str | None, seq: str) -> DataFrame:
    """Messages landed from any queue. Without a message time the processing time is used."""
    at = F.coalesce(F.col(when).cast("timestamp"), F.current_timestamp()) if when else F.current_timestamp()
    return decode_json(df.select(F.col(name).alias("input_ref"), at.alias("when"),
                                 F.col(seq).cast("bigint").alias("seq"), F.col(body).alias("body")))


def scrape_records(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Metric records ``{value, source}`` of scraped documents (target, status, body, at, seq).

    ``targets`` (name, field) says which top-level field is the metric (default ``value``). Failed
    requests, bodies that are no object and missing fields give no record.
    """
    joined = documents.join(
        targets.select(F.col("name").alias("target"), F.coalesce(F.nullif("field", F.lit("")), F.lit("value")).alias("field")),
        "target")
    doc = parse_object(F.col("body"))
    # a name with both kinds of quotes cannot be addressed and gives no record
    path = F.when(~F.contains("field", F.lit("'")), F.concat(F.lit("$['"), F.col("field"), F.lit("']"))).when(
        ~F.contains("field", F.lit('"')), F.concat(F.lit('$["'), F.col("field"), F.lit('"]')))
    value = F.try_variant_get(F.col("doc"), path, "variant")
    record = F.to_variant_object(F.struct(F.col("v").alias("value"), F.col("target").alias("source")))
    return (
        joined.where(F.expr("status div 100") == 2).withColumn("doc", doc).withColumn("v", value)
        .where(F.col("v").isNotNull())
        .select(F.col("target").alias("input_ref"), F.col("at").alias("when"), "seq", record.alias("record"))
    )


def late_rows(records: DataFrame, watermark: Column) -> tuple[DataFrame, DataFrame]:
    """Split by arrival: (on time, late with a reason)."""
    on_time = records.where(F.col("when") >= watermark)
    return on_time, records.where(F.col("when") < watermark).withColumn("reason", F.lit("late"))
