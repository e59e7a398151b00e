"""Log tables: readers, the vector column check, and the mapping of the sample tables.

Everything downstream takes a DataFrame with the log event columns, so any table
with that shape can be searched or scanned (`open_logs` takes a path or a table name).
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.text import utc_wall_clock, wall_clock_ms
from vigil.schema import CURSORS, DEFAULT_DIM, INCIDENTS, LOG_EVENTS

# Documents carry no time; event i is placed i minutes after this instant.
DOC_BASE_MS = 1_704_067_200_000


def sample(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_message() -> Column:
    return F.concat(
        "event_type", F.lit(" value="), F.col("value").cast("string"), F.lit(" props="), "props"
    )


def event_logs(events: DataFrame) -> DataFrame:
    """Event rows as log events; also used on the streaming reader."""
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("/app/"), "event_type").alias("log_group"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("log_stream"),
        wall_clock_ms("ts").alias("ts_ms"),
        event_message().alias("message"),
    )


def logs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_logs(sample(spark, sf_dir, "events"))


def document_logs(documents: DataFrame) -> DataFrame:
    """Document rows as log events; also used on the streaming reader."""
    return documents.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("log_group"),
        F.col("lang").alias("log_stream"),
        (F.lit(DOC_BASE_MS) + F.col("doc_id") * 60_000).alias("ts_ms"),
        F.col("text").alias("message"),
    )


def logs_from_documents(
    spark: SparkSession, sf_dir: str, vectors: str | None = None
) -> DataFrame:
    """Documents as log events. `vectors` is the join type for the embedding, if wanted."""
    docs = document_logs(sample(spark, sf_dir, "documents"))
    if not vectors:
        return docs
    emb = sample(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding", "label"
    )
    return docs.join(emb, "doc_id", vectors)


def union_logs(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Events and documents as one log table; document ids carry a prefix."""
    columns = ("id", "log_group", "log_stream", "ts_ms", "message")
    docs = documents.withColumn("id", F.concat(F.lit("d"), "id")).select(*columns)
    return events.select(*columns).unionByName(docs)


def all_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_logs(logs_from_events(spark, sf_dir), logs_from_documents(spark, sf_dir))


def day_of(ts_ms: Column | str) -> Column:
    """UTC date of an event, the partition column of stored log tables."""
    return F.to_date(utc_wall_clock(ts_ms))


def on_days(df: DataFrame, lo_ms: int, hi_ms: int | None = None) -> DataFrame:
    """Limit a day-partitioned table to the folders a time range can touch."""
    if "day" not in df.columns:
        return df
    day = lambda ms: F.lit(datetime.fromtimestamp(ms / 1000, timezone.utc).date())
    out = df.where(F.col("day") >= day(lo_ms))
    return out if hi_ms is None else out.where(F.col("day") <= day(hi_ms))


def open_logs(spark: SparkSession, name_or_path: str, path: bool = False) -> DataFrame:
    if path:
        return spark.read.schema(LOG_EVENTS).parquet(name_or_path)
    return spark.table(name_or_path)


def jdbc_logs(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Log rows kept in an SQL database; the vector arrives as JSON array text.

    Give partitionColumn, lowerBound, upperBound and numPartitions (ts_ms is the
    natural choice) so that the read is not one task.
    """
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    if "embedding" in rows.columns and isinstance(
        rows.schema["embedding"].dataType, T.StringType
    ):
        rows = rows.withColumn("embedding", F.from_json("embedding", "array<float>"))
    return rows


def check_vector_column(df: DataFrame, column: str = "embedding") -> None:
    """Fail early unless the column holds vectors."""
    kind = df.schema[column].dataType if column in df.columns else None
    if not (
        isinstance(kind, T.ArrayType)
        and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    ):
        raise ValueError(f"column {column!r} is not a vector column; migrate it to array<float>")


def dims(df: DataFrame, column: str = "embedding", dim: int = DEFAULT_DIM) -> DataFrame:
    """How many rows have which vector length, and whether it is the expected one."""
    return (
        df.groupBy(F.coalesce(F.size(column), F.lit(-1)).alias("dim"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("ok", F.col("dim") == dim)
    )


def ensure_store(spark: SparkSession, base: str) -> dict[str, str]:
    """Create the empty log, incident and cursor tables where they are missing."""
    from vigil.sources.store import SnapshotStore, path_exists

    logs = f"{base}/log_events"
    if not path_exists(spark, logs):
        spark.createDataFrame([], LOG_EVENTS).write.parquet(logs)
    SnapshotStore(spark, f"{base}/incidents", INCIDENTS).ensure()
    SnapshotStore(spark, f"{base}/cursors", CURSORS).ensure()
    check_vector_column(spark.read.parquet(logs))
    return {
        "log_events": logs,
        "incidents": f"{base}/incidents",
        "cursors": f"{base}/cursors",
    }


def rows_as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, null fields included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
