"""Conversation files (one JSON document each) and the flat turn table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.schema import CONVERSATION_FILE


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONVERSATION_FILE).option("multiLine", "true").json(path)


def to_turns(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("id").alias("conv_id"),
        F.col("updatedAt").alias("updated_at"),
        F.posexplode("messages").alias("turn", "m"),
    ).select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.col("m.role").alias("role"),
        F.col("m.content").alias("text"),
        "updated_at",
    )


def to_files(turns: DataFrame) -> DataFrame:
    """Turn rows as one document per conversation, in the shape that `read_files` reads."""
    message = F.struct("turn", F.struct(F.col("role"), F.col("text").alias("content")).alias("m"))
    updated = [F.max("updated_at").alias("updatedAt")] if "updated_at" in turns.columns else []
    return turns.groupBy(F.col("conv_id").cast("string").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(message)), lambda t: t["m"]).alias("messages"), *updated
    )


def write_turns(turns: DataFrame, path: str) -> None:
    """Conversations as JSON documents, one a line, many in a file.

    `path` must be new: turns that were read from a folder are written to another one and then
    read from there, so a failed write loses nothing.
    """
    to_files(turns).write.mode("errorifexists").json(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turn rows of what `write_turns` wrote."""
    return to_turns(spark.read.schema(CONVERSATION_FILE).json(path))
