"""Multi-line event assembly and the ingest filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import text as tx
from vigil.functions import vectors as vx


def parse_header(lines: DataFrame) -> DataFrame:
    """Adds is_header, ts_ms, log_stream and rest; the line loses its trailing space.

    The header pattern is applied once per line: its groups are written out as lines and
    split again, which is safe since neither a line nor a group holds a line feed. Lines
    without the dash of a date are not tried.
    """
    groups = F.split(F.regexp_replace("line", tx.HEADER, "\n$1\n$2\n$3"), "\n")
    parts = F.when(F.substring("line", 5, 1) == "-", groups)
    is_header = F.coalesce(F.size("_parts") == 4, F.lit(False))

    def group(number: int) -> Column:
        return F.when(F.col("is_header"), F.get("_parts", F.lit(number)))

    return (
        lines.withColumn("line", tx.trim_end("line"))
        .withColumn("_parts", parts)
        .withColumn("is_header", is_header)
        .withColumns(
            {"ts_ms": tx.iso_to_ms(group(1)), "log_stream": group(2), "rest": group(3)}
        )
        .drop("_parts")
    )


def assemble_events(lines: DataFrame, strays: bool = False) -> DataFrame:
    """Lines (file, chunk, line_no) to events; a header starts one, other lines continue it.

    A file is never put into one task. Headers are numbered inside each chunk, the
    numbers of the chunks before it are added from a table with one row per chunk,
    and the lines of an event are joined per chunk first and then over its chunks.
    Blank lines are dropped, and so are lines before the first header of a file, unless
    `strays` asks for them as event number 0: one row for each chunk of them, with its `chunk`
    (null for events), so a file without headers is never one value.
    """
    parsed = parse_header(lines).where(F.col("line") != "")

    within = (
        Window.partitionBy("file", "chunk")
        .orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    pieces = (
        parsed.withColumn("local_no", F.sum(F.col("is_header").cast("long")).over(within))
        .groupBy("file", "chunk", "local_no")
        .agg(
            F.min("log_group").alias("log_group"),
            F.min("ts_ms").alias("ts_ms"),
            F.min("log_stream").alias("log_stream"),
            _ordered_text(
                F.struct("line_no", F.coalesce("rest", "line").alias("part"))
            ).alias("piece"),
        )
    )

    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        parsed.groupBy("file", "chunk")
        .agg(F.count_if(F.col("is_header")).alias("headers"))
        .select(
            "file",
            "chunk",
            F.coalesce(F.sum("headers").over(before), F.lit(0)).alias("earlier"),
        )
    )

    numbered = pieces.join(offsets, ["file", "chunk"]).withColumn(
        "event_no", F.col("earlier") + F.col("local_no")
    )
    begun = numbered.where(F.col("event_no") > 0)
    events = begun.groupBy("file", "event_no").agg(
        F.min("log_group").alias("log_group"),
        F.max("log_stream").alias("log_stream"),
        F.max("ts_ms").alias("ts_ms"),
        _ordered_text(F.struct("chunk", F.col("piece").alias("part"))).alias("message"),
    )
    if not strays:
        return events
    loose = numbered.where(F.col("event_no") == 0).select(
        "file", "event_no", "log_group", "log_stream", "ts_ms", F.col("piece").alias("message"), "chunk"
    )
    return events.withColumn("chunk", F.lit(None).cast(loose.schema["chunk"].dataType)).unionByName(loose)


def carry_over(events: DataFrame, open_before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete, still open) for files that continue each other over batches.

    `events` come from `assemble_events(..., strays=True)` with one `file` per source, both
    inputs have the column `opened` (the batch an event began in). Stray lines continue the
    open event of their source; the newest event of each source stays open.
    """
    columns = open_before.columns
    # only of sources with an open event, whose text they are a part of
    loose = events.where(F.col("event_no") == 0).join(open_before.select("file").distinct(), "file", "left_semi")
    strays = loose.groupBy("file").agg(_ordered_text(F.struct("chunk", F.col("message").alias("part"))).alias("more"))
    last = events.groupBy("file").agg(F.max("event_no").alias("last_no")).where(F.col("last_no") > 0)

    grown = (
        open_before.join(strays, "file", "left")
        .withColumn("message", F.concat_ws("\n", "message", "more"))
        .select(columns)
    )
    begun = events.where(F.col("event_no") > 0).select(columns).join(last, "file")
    complete = grown.join(last, "file", "left_semi").unionByName(
        begun.where(F.col("event_no") < F.col("last_no")).select(columns)
    )
    still_open = grown.join(last, "file", "left_anti").unionByName(
        begun.where(F.col("event_no") == F.col("last_no")).select(columns)
    )
    return complete, still_open


def _ordered_text(piece: Column) -> Column:
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["part"]), "\n"
    )


def stable_id(*extra: str) -> Column:
    """Repeatable row id. `extra` names position columns, so equal lines stay distinct."""
    parts = ["log_group", "log_stream", F.col("ts_ms").cast("string"), "message", *extra]
    texts = [
        F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts
    ]
    return F.sha2(F.concat_ws("\u0001", *texts), 256)


def reject_reason(
    message: Column | str = "message", vector: Column | str = "embedding", ts: Column | str = "ts_ms"
) -> Column:
    """Null for a row that may be stored. A row without a time could not be found by any time filter."""
    time = F.col(ts) if isinstance(ts, str) else ts
    return F.when(~F.coalesce(tx.not_blank(tx.strip_ansi(message)), F.lit(False)), "blank message").when(
        ~vx.is_usable(vector), "no embedding"
    ).when(time.isNull(), "no time")


def quality_filter(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with the reason)."""
    judged = df.withColumn("reason", reject_reason())
    return (
        judged.where(F.col("reason").isNull()).drop("reason"),
        judged.where(F.col("reason").isNotNull()),
    )


def reject_counts(df: DataFrame) -> DataFrame:
    """One row per log group: how many rows, how many of them are not stored, and why."""
    reason = reject_reason()
    return (
        df.select("log_group", reason.alias("reason"), vx.is_usable("embedding").alias("usable"))
        .groupBy("log_group")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(~F.col("usable")).alias("failed_embeddings"),
            F.count_if(F.col("reason") == "blank message").alias("blank_messages"),
            F.count_if(F.col("reason").isNull()).alias("kept"),
        )
    )
