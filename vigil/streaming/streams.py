"""Structured Streaming forms of ingest, detection, rates and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.operators import alerts, detect, embed, incidents
from vigil.plans import ingest
from vigil.plans.detection import Scorer, Settings, folder_name, incidents_of
from vigil.schema import INCIDENTS
from vigil.session import materialize
from vigil.sources.raw_lines import number_lines
from vigil.sources.store import SnapshotStore


def _start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    """`every` is a processing time interval; without it all present data is read, then it ends."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingest_stream(
    spark: SparkSession,
    source: str,
    table: str,
    checkpoint: str,
    embedder: embed.Embedder,
    every: str | None = "8 seconds",
    max_files: int | None = None,
    group: Column | None = None,
) -> StreamingQuery:
    """Text files landing in `source` to the log table.

    A micro-batch holds whole files, which are assembled, embedded, filtered and written
    to the folder of the batch. A batch that is run again replaces its folder, so a
    restart neither loses nor repeats rows. The files of a group continue each other, in the order
    of their modification times: an event may go on in the next file and is stored when the
    next one begins. After the end of a source `ingest.flush_open` stores what is still open.
    """
    reader = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    text = reader.text(source).select("value", "_metadata")

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest.write_carried(number_lines(batch, group), embedder, table, batch_id)

    return _start(text.writeStream.foreachBatch(write), checkpoint, every)


def detect_stream(
    logs: DataFrame,
    stored_logs: Callable[[], DataFrame],
    store: SnapshotStore,
    outbox_path: str,
    checkpoint: str,
    settings: Settings = Settings(),
    delay: str = "10 minutes",
    channels: tuple[str, ...] = (),
    scorer: Scorer | None = None,
    dedupe: Column | None = None,
    every: str | None = "300 seconds",
) -> StreamingQuery:
    """Count per (tick, group), and score a tick once the watermark has passed its end.

    The state holds counts only. Sample rows of the closed ticks are read from the stored
    log table, limited to the days and times of those ticks. The outbox folder of a batch
    is written before the incident snapshot is committed with the batch number: a replay
    rewrites the one and skips the other. Batches are known by the stream's checkpoint, so ticks
    and other streams may use the same store.
    """
    writer = f"stream:{checkpoint}"
    interval = f"{settings.interval_ms} milliseconds"
    counts = (
        logs.where(F.char_length("message") >= settings.min_len)
        # one millisecond earlier, so that windows are open at the start and closed at the end
        .withColumn("event_time", F.timestamp_millis(F.col("ts_ms") - 1))
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", interval), "log_group")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(detect.tx.is_suspect("message")).alias("n_suspects"),
            F.min("ts_ms").alias("first_ts_ms"),
            F.max("ts_ms").alias("last_ts_ms"),
        )
        .select(
            F.unix_millis("window.end").alias("tick_ms"),
            "log_group", "n", "n_suspects", "first_ts_ms", "last_ts_ms",
        )
    )

    def score_closed(closed: DataFrame, batch_id: int) -> None:
        if store.has_batch(batch_id, writer):
            return
        closed = closed.persist()
        try:
            span = closed.agg(F.min("tick_ms").alias("lo"), F.max("tick_ms").alias("hi")).first()
            if span["lo"] is None:
                return
            lo = span["lo"] - settings.interval_ms
            rows = detect.on_days(stored_logs(), lo, span["hi"]).where(
                (F.col("ts_ms") > lo) & (F.col("ts_ms") <= span["hi"])
            )
            ticked = detect.with_ticks(rows, settings.interval_ms, settings.min_len)
            batch = incidents_of(ticked, settings, scorer, dedupe, counts=closed)
            # written once, so that outbox and snapshot agree whatever is lost meanwhile
            merged = materialize(incidents.merge(store.read(), batch), "merged")
            alerts.outbox(merged, list(channels)).write.mode("overwrite").parquet(
                f"{outbox_path}/writer={folder_name(writer)}/batch={batch_id}"
            )
            store.replace(merged, batch_id, writer)
        finally:
            closed.unpersist()

    return _start(
        counts.writeStream.outputMode("append").foreachBatch(score_closed), checkpoint, every
    )


def rate(logs: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Rows per time bucket. In append mode a bucket comes once, behind the watermark; for a chart of the
    newest minutes use `rate_to_table`, which takes updates.
    """
    return (
        logs.withColumn("event_time", F.timestamp_millis("ts_ms"))
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", width))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_millis("window.start").alias("bucket_ms"), "n")
    )


def rate_to_table(
    logs: DataFrame, path: str, checkpoint: str, width: str = "1 minute", delay: str = "10 minutes", every: str | None = "3 seconds"
) -> StreamingQuery:
    """Counts of all buckets that a batch touched, open ones too; a batch that is run again replaces its folder.

    The counts are gathered in few files behind a shuffle of their own, so that the state's partitions stay tasks of their own.
    """

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.hint("rebalance").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(rate(logs, width, delay).writeStream.outputMode("update").foreachBatch(write), checkpoint, every)


def read_rate(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of each bucket; counts only grow."""
    return spark.read.parquet(path).groupBy("bucket_ms").agg(F.max("n").alias("n"))


def session_incidents(logs: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of suspects per group, each once, when the watermark has passed its end."""
    return (
        detect.suspects(logs)
        .withColumn("event_time", F.timestamp_millis("ts_ms"))
        .withWatermark("event_time", delay)
        .groupBy("log_group", F.session_window("event_time", gap))
        .agg(
            F.min("ts_ms").alias("first_ts_ms"),
            F.max("ts_ms").alias("last_ts_ms"),
            F.count(F.lit(1)).alias("n"),
        )
        .select("log_group", "first_ts_ms", "last_ts_ms", "n")
    )


def dedupe_stream(logs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop rows whose id was seen within the delay; state is dropped after it."""
    return (
        logs.withColumn("event_time", F.timestamp_millis("ts_ms"))
        .withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["id"])
        .drop("event_time")
    )


def to_parquet(
    rows: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path)
    return _start(writer, checkpoint, every)


def incident_store(spark: SparkSession, base: str) -> SnapshotStore:
    return SnapshotStore(spark, base, INCIDENTS).ensure()
