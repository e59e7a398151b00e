"""From raw lines to the stored log table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.vectors import norm
from vigil.operators import assemble, embed
from vigil.schema import INGESTED
from vigil.session import materialize
from vigil.sources.store import path_exists
from vigil.sources.tables import day_of

STORED = ("id", "log_group", "log_stream", "ts_ms", "message", "embedding", "norm")


def prepare(lines: DataFrame, embedder: embed.Embedder) -> DataFrame:
    """Lines to rows ready to store."""
    return finish(assemble.assemble_events(lines), embedder, "file", "event_no")


def finish(events: DataFrame, embedder: embed.Embedder, *position: str) -> DataFrame:
    """Events to log rows with vector, vector norm, day and, where unfit, the reason.

    The id is made of the content and the position in the source, so reading a file again
    gives the same ids and equal lines stay apart.
    """
    identified = events.withColumn("id", assemble.stable_id(*position))
    return (
        embed.embed(identified, embedder)
        .withColumn("norm", norm("embedding"))
        .withColumn("reason", assemble.reject_reason())
        .withColumn("rejected", F.col("reason").isNotNull())
        .withColumn("day", day_of("ts_ms"))
        .select(*STORED, "reason", "rejected", "day")
    )


OPEN_EVENTS = (
    "file string, event_no long, log_group string, log_stream string, ts_ms long, "
    "message string, opened long"
)
OPEN_POSITION = ("file", "event_no", "opened")


def write_carried(lines: DataFrame, embedder: embed.Embedder, table: str, batch: int) -> None:
    """Write the complete events of a batch, keep the newest of each group for the next one.

    Lines before the first header of a group, with no event open, go to the rejects.

    Files of a group continue each other in the order of their modification times, then names. The open events of
    a batch are a folder of their own, so a batch that is run again starts from the same.
    """
    spark = lines.sparkSession
    by_group = lines.withColumn("chunk", F.struct("modified", "file", "chunk")).withColumn("file", F.col("log_group"))
    events = assemble.assemble_events(by_group, strays=True).withColumn(
        "opened", F.lit(batch).cast("long")
    )
    before = (
        spark.read.schema(OPEN_EVENTS).parquet(f"{table}-open/batch={batch - 1}")
        if batch > 0
        else spark.createDataFrame([], OPEN_EVENTS)
    )
    # read several times, so written once
    events = materialize(events, "events")
    complete, still_open = assemble.carry_over(events, before)
    still_open.write.mode("overwrite").parquet(f"{table}-open/batch={batch}")
    headless = events.where("event_no = 0").join(before.select("file").distinct(), "file", "left_anti")
    lost = finish(headless.select(complete.columns), embedder, *OPEN_POSITION).withColumns(
        {"reason": F.lit("no header"), "rejected": F.lit(True)}
    )
    write_batch(finish(complete, embedder, *OPEN_POSITION).unionByName(lost), table, batch)


def last_open(spark: SparkSession, table: str) -> int | None:
    """The newest batch of a table that has open events."""
    if not path_exists(spark, f"{table}-open"):
        return None
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{table}-open")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    names = [f.getPath().getName() for f in found]
    return max((int(n.split("=")[1]) for n in names if n.startswith("batch=")), default=None)


def flush_open(spark: SparkSession, embedder: embed.Embedder, table: str, last_batch: int | None = None) -> None:
    """Store the events left open after a stream has been stopped at `last_batch`, or at its newest batch."""
    last_batch = last_open(spark, table) if last_batch is None else last_batch
    if last_batch is None:
        return
    folder = f"{table}-open/batch={last_batch}"
    left = spark.read.schema(OPEN_EVENTS).parquet(folder)
    if left.isEmpty():
        return
    write_batch(finish(left, embedder, *OPEN_POSITION), table, -2 - last_batch)
    spark.createDataFrame([], OPEN_EVENTS).write.mode("overwrite").parquet(folder)


def write_batch(rows: DataFrame, table: str, batch: int, rebalance: bool = False) -> None:
    """One pass writes kept and rejected rows; writing a batch again replaces it.

    Rows are sorted by group and time inside each file, so the row group statistics serve
    filters on both; the writer needs a sort by folder anyway. `rebalance` is for loads
    that span many days: it gathers a day in few files and splits large days.
    """
    if rebalance:
        rows = rows.hint("rebalance", "rejected", "day")
    ordered = rows.sortWithinPartitions("rejected", "day", "log_group", "ts_ms")
    ordered.write.mode("overwrite").partitionBy("rejected", "day").parquet(f"{table}/batch={batch}")


def new_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose id is not stored yet, for batch loads of files that may be repeated."""
    return rows.join(stored.select("id"), "id", "left_anti")


def _read(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(INGESTED).parquet(table)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    return _read(spark, table).where(~F.col("rejected")).select(*STORED, "day")


def read_rejects(spark: SparkSession, table: str) -> DataFrame:
    return _read(spark, table).where("rejected")
