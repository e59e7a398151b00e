"""A log stream in which no row is lost from sight: every row is stored, late or rejected, and every batch says how many.

A row is rejected for a reason (no time, blank message), late if its time lies behind the watermark that the batches
before have set (their greatest time less the delay), and stored otherwise. All three go to the table,
partitioned by fate. The counts come from an `Observation`, in the same pass that writes the rows, and
make one row of the batch's own metrics; for every batch n_stored + n_late + n_rejected = n_input.

A batch starts from the metrics of the batch before it alone, and replaces its own folders if it is run again, so a
restart gives the same fates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.functions import text as tx
from vigil.sources.store import path_exists

STORED, LATE, REJECTED = "stored", "late", "rejected"
METRICS = "n_input long, n_stored long, n_late long, n_rejected long, max_ts_ms long, watermark_ms long"


def judged(rows: DataFrame, watermark_ms: int | None) -> DataFrame:
    """Adds fate and reason."""
    reason = F.when(F.col("ts_ms").isNull(), "no time").when(~F.coalesce(tx.not_blank("message"), F.lit(False)), "blank message")
    late = F.lit(False) if watermark_ms is None else F.col("ts_ms") < watermark_ms
    fate = F.when(F.col("reason").isNotNull(), REJECTED).when(late, LATE).otherwise(STORED)
    return rows.withColumn("reason", reason).withColumn("fate", fate)


def write_batch(rows: DataFrame, table: str, batch: int, delay_ms: int) -> None:
    spark = rows.sparkSession
    before = spark.read.schema(METRICS).parquet(f"{table}/metrics/batch={batch - 1}").first() if batch else None
    seen = Observation()
    count = lambda fate: F.count_if(F.col("fate") == fate).alias(f"n_{fate}")
    out = judged(rows, before["watermark_ms"] if before else None).observe(
        seen, F.count(F.lit(1)).alias("n_input"), count(STORED), count(LATE), count(REJECTED),
        F.max(F.when(F.col("fate") != REJECTED, F.col("ts_ms"))).alias("max_ts_ms"),
    )
    out.write.mode("overwrite").partitionBy("fate").parquet(f"{table}/rows/batch={batch}")
    counts = seen.get
    greatest = max((x for x in (counts["max_ts_ms"], before["max_ts_ms"] if before else None) if x is not None), default=None)
    line = (*(counts[c] for c in ("n_input", "n_stored", "n_late", "n_rejected")), greatest, None if greatest is None else greatest - delay_ms)
    spark.createDataFrame([line], METRICS).coalesce(1).write.mode("overwrite").parquet(f"{table}/metrics/batch={batch}")


def audited_stream(logs: DataFrame, table: str, checkpoint: str, delay_ms: int, every: str | None = "8 seconds") -> StreamingQuery:
    """Write every batch of a stream of log rows with `write_batch`."""

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, table, number, delay_ms)

    writer = logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_fate(spark: SparkSession, table: str, fate: str) -> DataFrame:
    return spark.read.parquet(f"{table}/rows").where(F.col("fate") == fate)


def read_metrics(spark: SparkSession, table: str) -> DataFrame:
    """One row a batch."""
    if not path_exists(spark, f"{table}/metrics"):
        return spark.createDataFrame([], f"{METRICS}, batch int")
    return spark.read.schema(f"{METRICS}, batch int").parquet(f"{table}/metrics")
