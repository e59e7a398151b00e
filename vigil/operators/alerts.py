"""Notification records for newly created incidents. Delivery is left to the reader of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.schema import SEVERITIES

# The channel names and the longest subject of a topic message.
CHAT_CHANNEL = "slack"
TOPIC_CHANNEL = "sns"
SUBJECT_CHARS = 100


def outbox(merged: DataFrame, channels: list[str]) -> DataFrame:
    """One row per created incident and channel: subject (topic only) and message body."""
    known = [c for c in channels if c in (CHAT_CHANNEL, TOPIC_CHANNEL)]
    ctx = "alert.vector_context"
    confidence = F.col(f"{ctx}.confidence")
    percent = F.floor(confidence * 100 + 0.5).cast("string")
    title = F.concat(
        F.lit("["), F.upper("severity"), F.lit("]["), percent, F.lit("%] "), F.col("alert.alert_title")
    )
    groups = F.concat_ws(
        ", ",
        F.transform(
            f"{ctx}.aggregates",
            lambda g: F.concat(g["group"], F.lit("("), g["count"].cast("string"), F.lit(")")),
        ),
    )
    body = F.concat(
        F.col("alert.alert_summary"), F.lit("\nGroups: "), groups,
        F.lit("\nSamples: "), F.col(f"{ctx}.sample_count").cast("string"),
    )
    chat = F.concat(F.lit("*"), title, F.lit("*\n"), body)
    topic = F.to_json(
        F.struct(
            "id",
            title.alias("title"),
            "severity",
            confidence.alias("confidence"),
            F.col("alert.alert_summary").alias("summary"),
            F.col(f"{ctx}.aggregates").alias("aggregates"),
            F.col("alert.alert_samples").alias("samples"),
        ),
        {"ignoreNullFields": "false"},
    )
    is_topic = F.col("channel") == TOPIC_CHANNEL
    return (
        merged.where("created")
        .withColumn("severity", F.col("alert.severity"))
        .withColumn("channel", F.explode(F.array(*[F.lit(c) for c in known]).cast("array<string>")))
        .select(
            F.col("id").alias("incident_id"),
            "channel",
            "severity",
            F.when(is_topic, F.substring(title, 1, SUBJECT_CHARS)).alias("subject"),
            F.when(is_topic, topic).otherwise(chat).alias("body"),
        )
    )


def routing_table(spark: SparkSession, routes: dict[str, list[str]]) -> DataFrame:
    """Severity to channels; at most one row per severity and channel name."""
    unknown = set(routes) - set(SEVERITIES)
    if unknown:
        raise ValueError(f"unknown severities {sorted(unknown)}")
    pairs = sorted({(s, c) for s, names in routes.items() for c in names})
    return spark.createDataFrame(pairs, "severity string, channel string")


def route(out: DataFrame, routes: DataFrame) -> DataFrame:
    """Keep the outbox rows whose channel is meant for their severity.

    The routing table comes from a dict of five severities, so it is broadcast.
    """
    return out.join(F.broadcast(routes), ["severity", "channel"], "left_semi")
