"""Schemas of the stored tables and the constants shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

SEVERITIES = ("info", "low", "medium", "high", "critical")
STATUSES = ("open", "ack", "resolved")

DEFAULT_DIM = 384

LOG_EVENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("log_group", T.StringType()),
        T.StructField("log_stream", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("message", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

# The log table as ingest writes it; the last three are folder names.
INGESTED = T.StructType(
    LOG_EVENTS.fields
    + [
        T.StructField("norm", T.DoubleType()),
        T.StructField("reason", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("rejected", T.BooleanType()),
        T.StructField("day", T.DateType()),
    ]
)

GROUP_COUNT = T.StructType(
    [T.StructField("group", T.StringType()), T.StructField("count", T.LongType())]
)

VECTOR_CONTEXT = T.StructType(
    [
        T.StructField("aggregates", T.ArrayType(GROUP_COUNT)),
        T.StructField("sample_count", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

INCIDENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("created_ms", T.LongType(), False),
        T.StructField("updated_ms", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("summary", T.StringType()),
        T.StructField("affected_group", T.StringType()),
        T.StructField("affected_stream", T.StringType()),
        T.StructField("first_ts_ms", T.LongType()),
        T.StructField("last_ts_ms", T.LongType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("sample_ids", T.ArrayType(T.StringType())),
        T.StructField("vector_context", VECTOR_CONTEXT),
        T.StructField("dedupe_key", T.StringType()),
    ]
)

CURSORS = T.StructType(
    [
        T.StructField("pipeline_id", T.StringType(), False),
        T.StructField("last_ts_ms", T.LongType(), False),
        T.StructField("last_id", T.StringType()),
    ]
)

RAW_LINES = T.StructType(
    [
        T.StructField("log_group", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("line", T.StringType()),
    ]
)

# What a scorer may report per incident. Severity and confidence stay text here:
# they are normalised and clamped after parsing.
SCORED_INCIDENT = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("dedupe_key", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("suggested_actions", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
SCORER_BODY = T.StructType([T.StructField("incidents", T.ArrayType(SCORED_INCIDENT))])

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)
CONVERSATION_FILE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("endpoint", T.StringType()),
        T.StructField("createdAt", T.StringType()),
        T.StructField("updatedAt", T.StringType()),
    ]
)
