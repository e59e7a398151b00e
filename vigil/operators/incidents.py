"""Incident records: build, merge by dedupe key, list, resolve evidence, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import text as tx
from vigil.schema import INCIDENTS, STATUSES, VECTOR_CONTEXT


def dedupe_key(
    given: Column | str, title: Column | str, aggregates: Column | str, now_ms: Column | str
) -> Column:
    """The scorer's key, else title, a hash of the busiest groups and the UTC hour."""
    given, title = (F.col(c) if isinstance(c, str) else c for c in (given, title))
    own_title = F.coalesce(F.nullif(title, F.lit("")), F.lit("incident"))
    shape = tx.sha1_prefix(F.substring(F.to_json(aggregates), 1, 300))
    return F.coalesce(
        F.nullif(given, F.lit("")), F.concat_ws("|", own_title, shape, tx.iso_hour(now_ms))
    )


def incident_id(key: Column | str = "dedupe_key") -> Column:
    """Repeatable id: the dedupe key is unique in the incident table."""
    return F.substring(F.sha2(F.col(key) if isinstance(key, str) else key, 256), 1, 32)


def build(gated: DataFrame) -> DataFrame:
    """Gated scorer rows next to the context of their tick, as rows ready to merge.

    `ord_key` orders the rows of one tick, `now_ms` is the time of the tick. The sample
    rows and the uncut title go along for the notification.
    """
    title = F.nullif("title", F.lit(""))
    return gated.select(
        F.struct("tick_ms", "ord").alias("ord_key"),
        F.col("tick_ms").alias("now_ms"),
        dedupe_key("dedupe_key", "title", "aggregates", "tick_ms").alias("dedupe_key"),
        F.lit("open").alias("status"),
        "severity",
        tx.truncate(F.coalesce(title, F.lit("Detected issue")), 255).alias("title"),
        tx.truncate(F.coalesce("summary", F.lit("")), 1000).alias("summary"),
        F.try_element_at(F.transform("aggregates", lambda g: g["group"]), F.lit(1)).alias("affected_group"),
        F.lit(None).cast("string").alias("affected_stream"),
        "first_ts_ms",
        "last_ts_ms",
        "event_count",
        F.transform("samples", lambda s: s["id"]).alias("sample_ids"),
        F.struct(
            "aggregates",
            F.size("samples").alias("sample_count"),
            "confidence",
            "tags",
        ).cast(VECTOR_CONTEXT).alias("vector_context"),
        F.coalesce(title, F.lit("Issue detected")).alias("alert_title"),
        F.coalesce("summary", F.lit("")).alias("alert_summary"),
        F.slice("samples", 1, 2).alias("alert_samples"),
    )


ALERT_COLUMNS = ("severity", "alert_title", "alert_summary", "alert_samples", "vector_context")


def fold(batch: DataFrame) -> DataFrame:
    """All rows of a batch with one key as one change, as if applied one after another.

    Every part is a partial aggregate, so a key with many rows is reduced in the map
    tasks. `first` holds what only an insert writes, the rest what an update writes.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord_key"))).alias(c)
    return batch.groupBy("dedupe_key").agg(
        F.min_by(
            F.struct(
                "severity", "title", "status", "first_ts_ms", "last_ts_ms", "sample_ids", "now_ms",
                F.struct(*ALERT_COLUMNS).alias("alert") if "alert_title" in batch.columns
                else F.lit(None).alias("alert"),
            ),
            "ord_key",
        ).alias("first"),
        F.count(F.lit(1)).alias("n_rows"),
        F.max("last_ts_ms").alias("max_last"),
        F.count_if(F.col("last_ts_ms").isNull()).alias("n_null_last"),
        F.max(F.coalesce("last_ts_ms", "now_ms")).alias("update_last"),
        F.max_by(
            F.when(F.col("last_ts_ms").isNull(), F.col("now_ms")),
            F.when(F.col("last_ts_ms").isNull(), F.col("ord_key")),
        ).alias("null_now"),
        F.max_by("now_ms", "ord_key").alias("now_ms"),
        F.sum(F.coalesce("event_count", F.lit(0))).alias("event_count"),
        last("summary"), last("affected_group"), last("affected_stream"), last("vector_context"),
    )


def merge(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Incident table after the batch, plus `created`, `touched` and the alert fields.

    Existing keys keep severity, title, status, first time and samples; the last time
    is the greatest, counts add up, other fields take the newest non-null value.
    """
    old = snapshot.select("dedupe_key", F.struct(*snapshot.columns).alias("old"))
    joined = old.join(fold(batch).alias("new"), "dedupe_key", "full_outer")
    created = F.col("old").isNull()
    touched = F.col("first").isNotNull()

    rest_null = F.col("n_null_last") > F.when(F.col("first.last_ts_ms").isNull(), 1).otherwise(0)
    insert_last = F.when(F.col("n_rows") == 1, F.col("first.last_ts_ms")).otherwise(
        F.greatest(F.coalesce("max_last", F.lit(0)), F.when(rest_null, F.col("null_now")).otherwise(0))
    )
    update_last = F.greatest(F.coalesce("old.last_ts_ms", F.lit(0)), "update_last")

    def pick(insert: Column, update: Column, name: str) -> Column:
        return (
            F.when(created, insert).when(touched, update).otherwise(F.col(f"old.{name}")).alias(name)
        )

    def kept(name: str) -> Column:
        return pick(F.col(f"first.{name}"), F.col(f"old.{name}"), name)

    def newest(name: str) -> Column:
        return pick(F.col(f"new.{name}"), F.coalesce(f"new.{name}", f"old.{name}"), name)

    columns = {
        "id": pick(incident_id(), F.col("old.id"), "id"),
        "created_ms": pick(F.col("first.now_ms"), F.col("old.created_ms"), "created_ms"),
        "updated_ms": pick(F.col("new.now_ms"), F.col("new.now_ms"), "updated_ms"),
        "status": pick(F.coalesce("first.status", F.lit("open")), F.col("old.status"), "status"),
        "severity": kept("severity"),
        "title": kept("title"),
        "summary": newest("summary"),
        "affected_group": newest("affected_group"),
        "affected_stream": newest("affected_stream"),
        "first_ts_ms": kept("first_ts_ms"),
        "last_ts_ms": pick(insert_last, update_last, "last_ts_ms"),
        "event_count": pick(
            F.col("new.event_count"),
            F.coalesce("old.event_count", F.lit(0)) + F.col("new.event_count"),
            "event_count",
        ),
        "sample_ids": kept("sample_ids"),
        "vector_context": newest("vector_context"),
        "dedupe_key": F.col("dedupe_key"),
    }
    ordered = [columns[name] for name in INCIDENTS.fieldNames()]
    return joined.select(
        *ordered, created.alias("created"), touched.alias("touched"), F.col("first.alert").alias("alert")
    )


def empty_snapshot(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], INCIDENTS)


def incident_list(incidents: DataFrame, status: str = "open", n: int | None = None) -> DataFrame:
    """Incidents of a status, newest first."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    out = incidents.where(F.col("status") == status).orderBy(F.col("created_ms").desc(), "id")
    return out.limit(n) if n else out


def evidence(incidents: DataFrame, logs: DataFrame) -> DataFrame:
    """The log rows behind the sample ids of each incident.

    Samples lie between the first and the last time of their incident, so the log table is read for the time that the
    incidents span (all of it, where the incidents come without times or one has none).
    """
    wanted = incidents.select(
        F.col("id").alias("incident_id"), F.posexplode("sample_ids").alias("pos", "id")
    )
    rows = logs
    if {"first_ts_ms", "last_ts_ms"} <= set(incidents.columns):
        known = F.count("first_ts_ms") + F.count("last_ts_ms") == 2 * F.count(F.lit(1))
        span = incidents.agg(F.when(known, F.min("first_ts_ms")).alias("lo"), F.when(known, F.max("last_ts_ms")).alias("hi"))
        lo, hi = F.coalesce(span.select("lo").scalar(), F.lit(-(2**62))), F.coalesce(span.select("hi").scalar(), F.lit(2**62))
        rows = rows.where(F.col("ts_ms").between(lo, hi))
        if "day" in logs.columns:
            # one-row subqueries, so the folders of other days are not read
            first, last = (tx.utc_wall_clock(span.select(c).scalar()).cast("date") for c in ("lo", "hi"))
            rows = rows.where((F.col("day") >= F.coalesce(first, F.col("day"))) & (F.col("day") <= F.coalesce(last, F.col("day"))))
    return wanted.join(rows.select("id", "log_group", "log_stream", "ts_ms", "message"), "id").select(
        "incident_id", "pos", "id", "log_group", "log_stream", "ts_ms", "message"
    )


def report(incidents: DataFrame, rolled: DataFrame, top: int | None = None) -> DataFrame:
    """One row per incident with its groups, streams (the `top` busiest, or all), timeline and sample rows.

    `incidents` are built rows (with now_ms), `rolled` is the stored rollup of the events,
    so the lists are made from counts and not from the events again.
    """
    slots = rolled.groupBy("tick_ms", "slot_ms").agg(
        F.sum("n").alias("n"), F.sum("n_suspects").alias("n_suspects")
    )
    timeline = slots.groupBy(F.col("tick_ms").alias("now_ms")).agg(
        F.array_sort(F.collect_list(F.struct("slot_ms", "n", "n_suspects"))).alias("timeline")
    )
    busiest = Window.partitionBy("tick_ms").orderBy(F.col("n").desc(), "log_group", "log_stream")
    streams = (
        rolled.groupBy("tick_ms", "log_group", "log_stream")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(busiest))
        .where(F.lit(True) if top is None else F.col("rank") <= top)
        .groupBy(F.col("tick_ms").alias("now_ms"))
        .agg(
            F.array_sort(F.collect_list(F.struct("rank", "log_group", "log_stream", "n"))).alias("streams")
        )
    )
    return incidents.join(timeline, "now_ms").join(streams, "now_ms").select(
        incident_id().alias("incident_id"),
        "severity",
        "title",
        "summary",
        F.col("vector_context.confidence").alias("confidence"),
        "first_ts_ms",
        "last_ts_ms",
        "event_count",
        F.col("vector_context.aggregates").alias("groups"),
        "streams",
        "timeline",
        "alert_samples",
        "sample_ids",
    )


def upsert_cursors(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or overwrite cursor rows by pipeline."""
    new = changes.select(
        "pipeline_id", F.struct("last_ts_ms", "last_id").alias("new")
    )
    old = current.select("pipeline_id", F.struct("last_ts_ms", "last_id").alias("old"))
    chosen = F.coalesce("new", "old")
    return old.join(new, "pipeline_id", "full_outer").select(
        "pipeline_id",
        F.coalesce(chosen["last_ts_ms"], F.lit(0)).alias("last_ts_ms"),
        chosen["last_id"].alias("last_id"),
    )


def read_cursor(cursors: DataFrame, pipeline_id: str) -> int:
    """Last timestamp of a pipeline, 0 where there is none."""
    row = cursors.where(F.col("pipeline_id") == pipeline_id).agg(F.max("last_ts_ms").alias("t")).first()
    return row["t"] or 0
