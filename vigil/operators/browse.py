"""Newest rows, substring filters, streams and groups of a log table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import text as tx
from vigil.functions.timeparse import since_ms
from vigil.sources.tables import on_days

# How many characters a list view shows of each column.
LIST_CUTS = {"log_group": 19, "log_stream": 19, "message": 59}


def newest(df: DataFrame, n: int) -> DataFrame:
    """The newest n rows. A table stored by day is read from its newest day on, as far as needed.

    The number of days doubles with each try; rows without a time come last and are only
    reached if all days together hold fewer than n rows.
    """
    order = (F.col("ts_ms").desc(), "id")
    if "day" in df.columns:
        found = {m[1] for f in df.inputFiles() if (m := re.search(r"/day=(\d{4}-\d\d-\d\d)/", f))}
        days, width = sorted(found, reverse=True), 1
        while width < len(days):
            part = df.where(F.col("day") >= F.lit(days[width - 1]).cast("date"))
            if part.limit(n).count() >= n:
                return part.orderBy(*order).limit(n)
            width *= 2
    return df.orderBy(*order).limit(n)


def browse(df: DataFrame, n: int = 50, like: str | None = None) -> DataFrame:
    """The newest n rows, optionally those whose group, stream or message matches."""
    out = df
    if like and like.strip():
        out = df.where(tx.like_any(like, "log_group", "log_stream", "message"))
    return newest(out, n)


def list_view(df: DataFrame) -> DataFrame:
    cut = {c: F.substring(F.coalesce(c, F.lit("")), 1, n) for c, n in LIST_CUTS.items()}
    return df.select("id", "ts_ms", *[e.alias(c) for c, e in cut.items()])


def latest_stream(df: DataFrame) -> DataFrame:
    """Per group the stream with the newest event.

    Reduced per (group, stream) first: a number per key is a hash aggregate, while
    picking a stream name straight from the events would sort them.
    """
    newest = F.max(F.struct("last_ts_ms", "log_stream")).alias("newest")
    return (
        df.groupBy("log_group", "log_stream")
        .agg(F.max("ts_ms").alias("last_ts_ms"))
        .groupBy("log_group")
        .agg(newest)
        .select("log_group", "newest.log_stream", "newest.last_ts_ms")
    )


def latest_events(
    df: DataFrame,
    n: int = 50,
    group: str | None = None,
    stream: str | None = None,
    start: str | None = None,
    as_of_ms: int | None = None,
) -> DataFrame:
    """The last n events of one stream per group, from an optional start, in time order.

    `recency` is 1 for the newest. The rank limit is applied in each map task before
    the shuffle, so a group of any size sends n rows per task.
    """
    rows = df.where(F.col("log_group") == group) if group else df
    if start:
        if as_of_ms is None:
            raise ValueError("as_of_ms is needed with start")
        # also before the stream is chosen: one with events before the start only gives no row either way
        cutoff = since_ms(start, as_of_ms, dialect="c")
        rows = on_days(rows, cutoff).where(F.col("ts_ms") >= cutoff)
    if stream:
        chosen = rows.where(F.col("log_stream") == stream)
    else:
        chosen = rows.join(
            latest_stream(rows).select("log_group", "log_stream"), ["log_group", "log_stream"]
        )
    newest_first = Window.partitionBy("log_group").orderBy(F.col("ts_ms").desc(), F.col("id").desc())
    return (
        chosen.withColumn("recency", F.row_number().over(newest_first))
        .where(F.col("recency") <= n)
        .select("log_group", "log_stream", "id", "ts_ms", "message", "recency")
        .orderBy("log_group", "ts_ms", "id")
    )


def group_catalog(df: DataFrame, name_contains: str = "") -> DataFrame:
    """All group names with their counts and time span, optionally by a part of the name."""
    wanted = name_contains.strip().lower()
    rows = df.where(F.contains(F.lower("log_group"), F.lit(wanted))) if wanted else df
    return rows.groupBy("log_group").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts_ms").alias("first_ts_ms"),
        F.max("ts_ms").alias("last_ts_ms"),
    )


def split_groups(text: str) -> list[str]:
    return [name.strip() for name in text.split(",") if name.strip()]


def fan_out(df: DataFrame, groups: str) -> DataFrame:
    """Rows of the groups in a comma list; one job serves all of them."""
    return df.where(F.col("log_group").isin(split_groups(groups)))


def recent_errors(df: DataFrame, n: int = 5) -> DataFrame:
    """The last n messages that mention an error."""
    return newest(df.where(F.col("message").rlike("(?i)error")), n)


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns computed from SQL expressions."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})
