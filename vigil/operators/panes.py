"""Look-back windows that overlap, added up from panes: one definition for batch and stream.

A pane is the counts of a group in one slide (start, end]; a window of `width_ms` that ends with a pane is the sum of
the width / slide panes up to it. So an event is read and counted once, however many windows it lies in, and a
stream appends the panes of each micro-batch, which add up to the same windows; late events only add.

Defined cases: rows without a time take no part; a null group is a group; windows without events have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.operators import detect

PANE = "pane_ms long, log_group string, n long, n_suspects long, first_ts_ms long, last_ts_ms long"


def _added(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "log_group").agg(
        F.sum("n").alias("n"), F.sum("n_suspects").alias("n_suspects"),
        F.min("first_ts_ms").alias("first_ts_ms"), F.max("last_ts_ms").alias("last_ts_ms"),
    )


def panes(df: DataFrame, slide_ms: int) -> DataFrame:
    """Partial counts of (start, end] slides by their end."""
    rows = df.where("ts_ms IS NOT NULL").withColumn("pane_ms", detect.tick_of("ts_ms", slide_ms))
    return detect.group_counts(rows, "pane_ms")


def windows(paned: DataFrame, width_ms: int, slide_ms: int) -> DataFrame:
    """window_ms (its end), log_group, counts and the share of suspects; partial panes may repeat."""
    if width_ms % slide_ms:
        raise ValueError("the slide has to divide the width")
    ends = F.sequence(F.col("pane_ms"), F.col("pane_ms") + F.lit(width_ms - slide_ms), F.lit(slide_ms).cast("long"))
    # partial panes of the batches first, then each to its windows
    spread = _added(paned, "pane_ms").select(F.explode(ends).alias("window_ms"), "log_group", "n", "n_suspects", "first_ts_ms", "last_ts_ms")
    return _added(spread, "window_ms").withColumn("rate", F.col("n_suspects") / F.col("n"))


def panes_to_table(logs: DataFrame, path: str, checkpoint: str, slide_ms: int, every: str | None = "30 seconds") -> StreamingQuery:
    """The panes of each micro-batch in a folder of its own; a batch that is run again replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        panes(batch, slide_ms).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_windows(spark: SparkSession, path: str, width_ms: int, slide_ms: int, lo_ms: int | None = None, hi_ms: int | None = None) -> DataFrame:
    """The windows that end in [lo_ms, hi_ms], from the stored panes that they need."""
    stored = spark.read.schema(PANE).parquet(path)
    if lo_ms is not None:
        stored = stored.where(F.col("pane_ms") > lo_ms - width_ms)
    if hi_ms is not None:
        stored = stored.where(F.col("pane_ms") <= hi_ms)
    found = windows(stored, width_ms, slide_ms)
    if lo_ms is not None:
        found = found.where(F.col("window_ms") >= lo_ms)
    return found if hi_ms is None else found.where(F.col("window_ms") <= hi_ms)
