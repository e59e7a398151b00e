"""Raw log lines with a position that survives splitting a file over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.text import iso_time


def number_lines(text: DataFrame, group: Column | None = None) -> DataFrame:
    """Give lines of a text reader a (file, chunk, line_no) position.

    A chunk is one split of the file, identified by its byte offset. Within a task
    the generated ids rise in reading order, so (chunk, line_no) orders the lines of
    a file without reading it in one piece.
    """
    group = F.regexp_extract("file", r"([^/]+)/[^/]*$", 1) if group is None else group
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ).select(group.alias("log_group"), "file", "chunk", "line_no", "line", "modified")


def read_lines(spark: SparkSession, path: str, group: Column | None = None) -> DataFrame:
    """Lines of the text files below `path`; the parent folder names the log group."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    return number_lines(reader.text(path), group)


def line_text(logs: DataFrame, headed: Column | None = None) -> Column:
    """A log row written out as text again: time, stream and row number, then the message.

    Rows that are not `headed` get no header, so their lines continue the event before.
    """
    header = F.concat_ws(
        " ",
        iso_time("ts_ms"),
        "log_stream",
        F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]")),
        "message",
    )
    return header if headed is None else F.when(headed, header).otherwise(F.col("message"))


def document_lines(logs: DataFrame) -> DataFrame:
    """Document rows as raw lines: one file per log group, one chunk per row.

    Only rows in English start an event.
    """
    return logs.select(
        "log_group",
        F.col("log_group").alias("file"),
        F.col("doc_id").alias("chunk"),
        F.posexplode(
            F.split(line_text(logs, F.col("log_stream") == "en"), "\n")
        ).alias("line_no", "line"),
    )


def write_line_files(logs: DataFrame, path: str) -> None:
    """Document rows as text files below one folder per log group."""
    logs.select("log_group", line_text(logs).alias("value")).write.partitionBy("log_group").text(path)
