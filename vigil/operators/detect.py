"""Time windows over the log table: suspects, counts, samples, rates, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import text as tx
from vigil.functions.timeparse import HOUR_MS, MINUTE_MS
from vigil.sources.tables import on_days

TOP_GROUPS = 5
MAX_SAMPLES = 5
SAMPLE = ("id", "log_group", "log_stream", "ts_ms", "message")


def window_start(as_of_ms: int, cursor_ms: int | None, window_min: int) -> int:
    start = as_of_ms - window_min * MINUTE_MS
    return max(start, cursor_ms or start)


def window_scan(
    df: DataFrame,
    as_of_ms: int,
    cursor_ms: int | None = None,
    window_min: int = 10,
    max_events: int | None = 1000,
    min_len: int = 10,
    ties: bool = True,
) -> DataFrame:
    """Events after the cursor, oldest first, at most `max_events`.

    With `ties` the rows sharing the last timestamp stay in, so a cursor moved to that
    timestamp skips nothing. The limit is found by a bounded top-n, not by ranking.
    """
    lo = window_start(as_of_ms, cursor_ms, window_min)
    rows = (
        on_days(df, lo, as_of_ms)
        .where((F.col("ts_ms") > lo) & (F.col("ts_ms") <= as_of_ms))
        .where(F.char_length("message") >= min_len)
        .select(*SAMPLE)
    )
    if max_events is None:
        return rows
    first = rows.orderBy("ts_ms", "id").limit(max_events)
    if not ties:
        return first
    last = first.agg(F.max("ts_ms")).scalar()
    return rows.where(F.col("ts_ms") <= last)


def next_cursor(window: DataFrame, as_of_ms: int, pipeline_id: str = "alerts") -> DataFrame:
    """The cursor row after a tick: the last row read, or the tick's time if none was."""
    last = F.max(F.struct("ts_ms", "id"))
    return window.agg(last.alias("last")).select(
        F.lit(pipeline_id).alias("pipeline_id"),
        F.coalesce("last.ts_ms", F.lit(as_of_ms)).alias("last_ts_ms"),
        F.col("last.id").alias("last_id"),
    )


def tick_of(ts_ms: Column | str, interval_ms: int) -> Column:
    """End of the interval (start, end] an event falls in."""
    ts = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    return F.call_function("div", ts + F.lit(interval_ms - 1), F.lit(interval_ms)) * interval_ms


def bucket_of(ts_ms: Column | str, width_ms: int) -> Column:
    """Start of the interval [start, end) an event falls in."""
    ts = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    return F.call_function("div", ts, F.lit(width_ms)) * width_ms


def with_ticks(df: DataFrame, interval_ms: int, min_len: int = 10) -> DataFrame:
    """All ticks of a table at once: every event gets the tick that reads it."""
    return df.where(F.char_length("message") >= min_len).withColumn(
        "tick_ms", tick_of("ts_ms", interval_ms)
    )


def suspects(df: DataFrame, pattern: str = tx.SUSPECT) -> DataFrame:
    return df.where(tx.is_suspect("message", pattern))


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Events per (keys, log group), with what later steps need from the same pass."""
    return df.groupBy(*keys, "log_group").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(tx.is_suspect("message")).alias("n_suspects"),
        F.min("ts_ms").alias("first_ts_ms"),
        F.max("ts_ms").alias("last_ts_ms"),
    )


def _rank_order() -> list[Column]:
    return [F.col("n").desc(), F.col("first_ts_ms"), F.col("log_group")]


def top_groups(counts: DataFrame, n: int = TOP_GROUPS, key: str = "tick_ms") -> DataFrame:
    """The n busiest groups per tick from `group_counts(df, key)`."""
    ranked = Window.partitionBy(key).orderBy(*_rank_order())
    return counts.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)


def group_counts_json(df: DataFrame, n: int = TOP_GROUPS) -> DataFrame:
    """The busiest groups of the whole input as one JSON array."""
    top = group_counts(df).orderBy(*_rank_order()).limit(n)
    listed = F.array_sort(
        F.collect_list(F.struct((-F.col("n")).alias("o"), "first_ts_ms", "log_group", "n"))
    )
    return top.agg(
        F.to_json(
            F.transform(listed, lambda g: F.struct(g["log_group"].alias("group"), g["n"].alias("count")))
        ).alias("aggregates")
    )


def samples(df: DataFrame, n: int = MAX_SAMPLES, key: str = "tick_ms") -> DataFrame:
    """The first n suspects per tick. The rank limit also runs before the shuffle."""
    in_order = Window.partitionBy(key).orderBy("ts_ms", "id")
    return (
        suspects(df)
        .select(key, *SAMPLE)
        .withColumn("sample_no", F.row_number().over(in_order))
        .where(F.col("sample_no") <= n)
    )


def evidence_samples(df: DataFrame, n: int = 3) -> DataFrame:
    """The first n suspects of every group in every tick."""
    in_order = Window.partitionBy("tick_ms", "log_group").orderBy("ts_ms", "id")
    return (
        suspects(df)
        .select("tick_ms", *SAMPLE)
        .withColumn("sample_no", F.row_number().over(in_order))
        .where(F.col("sample_no") <= n)
    )


def window_summary(counts: DataFrame, key: str = "tick_ms", top: int = TOP_GROUPS) -> DataFrame:
    """One row per tick from `group_counts(df, key)`: span, totals and the busiest groups."""
    ranked = Window.partitionBy(key).orderBy(*_rank_order())
    listed = F.struct("rank", F.col("log_group").alias("group"), F.col("n").alias("count"))
    return (
        counts.withColumn("rank", F.row_number().over(ranked))
        .groupBy(key)
        .agg(
            F.min("first_ts_ms").alias("first_ts_ms"),
            F.max("last_ts_ms").alias("last_ts_ms"),
            F.sum("n").alias("event_count"),
            F.sum("n_suspects").alias("suspect_count"),
            F.array_sort(F.collect_list(F.when(F.col("rank") <= top, listed))).alias("ranked"),
        )
        .select(
            "*",
            F.transform("ranked", lambda g: F.struct(g["group"].alias("group"), g["count"].alias("count"))).alias("aggregates"),
        )
        .drop("ranked")
    )


def with_window(counts: DataFrame, key: str = "tick_ms", top: int = TOP_GROUPS) -> DataFrame:
    """`window_summary` next to every (tick, group) row, for scoring per group in one pass."""
    whole = Window.partitionBy(key)
    ranked = whole.orderBy(*_rank_order())
    listed = F.struct("rank", F.col("log_group").alias("group"), F.col("n").alias("count"))
    return (
        counts.withColumn("rank", F.row_number().over(ranked))
        .withColumn("ranked", F.array_sort(F.collect_list(F.when(F.col("rank") <= top, listed)).over(whole)))
        .select(
            key,
            "log_group",
            "n",
            "n_suspects",
            F.min("first_ts_ms").over(whole).alias("first_ts_ms"),
            F.max("last_ts_ms").over(whole).alias("last_ts_ms"),
            F.sum("n").over(whole).alias("event_count"),
            F.transform("ranked", lambda g: F.struct(g["group"].alias("group"), g["count"].alias("count"))).alias("aggregates"),
        )
    )


def sample_lists(df: DataFrame, n: int = MAX_SAMPLES) -> DataFrame:
    """The samples of each tick as one array; ticks without suspects are absent."""
    ordered = F.array_sort(F.collect_list(F.struct("sample_no", *SAMPLE)))
    return samples(df, n).groupBy("tick_ms").agg(
        F.transform(ordered, lambda s: F.struct(*[s[c].alias(c) for c in SAMPLE])).alias("samples")
    )


def join_samples(ticks: DataFrame, lists: DataFrame) -> DataFrame:
    empty = F.array().cast(lists.schema["samples"].dataType)
    return ticks.join(lists, "tick_ms", "left").withColumn("samples", F.coalesce("samples", empty))


def tick_context(
    df: DataFrame,
    counts: DataFrame | None = None,
    top: int = TOP_GROUPS,
    max_samples: int = MAX_SAMPLES,
) -> DataFrame:
    """Summary and samples per tick: the input of prompting, and of building for a scorer.

    `df` has tick_ms. `counts` is `group_counts(df, "tick_ms")` where it is known already.
    """
    counts = group_counts(df, "tick_ms") if counts is None else counts
    return join_samples(window_summary(counts, top=top), sample_lists(df, max_samples))


def rollup(df: DataFrame, slot_ms: int) -> DataFrame:
    """Counts per (tick, time slot, group, stream), from which the other counts follow."""
    return df.groupBy(
        "tick_ms", bucket_of("ts_ms", slot_ms).alias("slot_ms"), "log_group", "log_stream"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(tx.is_suspect("message")).alias("n_suspects"),
        F.min("ts_ms").alias("first_ts_ms"),
        F.max("ts_ms").alias("last_ts_ms"),
    )


def counts_of(rolled: DataFrame) -> DataFrame:
    """`group_counts(df, "tick_ms")` from a rollup."""
    return rolled.groupBy("tick_ms", "log_group").agg(
        F.sum("n").alias("n"),
        F.sum("n_suspects").alias("n_suspects"),
        F.min("first_ts_ms").alias("first_ts_ms"),
        F.max("last_ts_ms").alias("last_ts_ms"),
    )


def error_rate(df: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Share of suspect events per group, stream and time bucket."""
    return (
        df.groupBy("log_group", "log_stream", bucket_of("ts_ms", width_ms).alias("bucket_ms"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(tx.is_suspect("message")).alias("n_suspects"),
        )
        .withColumn("rate", F.col("n_suspects") / F.col("total"))
    )


def error_trend(df: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Error rate per group and bucket next to the rate of the group's bucket before."""
    in_order = Window.partitionBy("log_group").orderBy("bucket_ms")
    return (
        df.groupBy("log_group", bucket_of("ts_ms", width_ms).alias("bucket_ms"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(tx.is_suspect("message")).alias("n_suspects"),
        )
        .withColumn("rate", F.col("n_suspects") / F.col("total"))
        .withColumn("previous_rate", F.lag("rate").over(in_order))
        .withColumn("change", F.col("rate") - F.col("previous_rate"))
    )


def ingest_rate(
    df: DataFrame, as_of_ms: int, buckets: int = 5, width_ms: int = MINUTE_MS
) -> DataFrame:
    """Rows per time bucket up to `as_of_ms`, oldest bucket first, empty ones included.

    An event exactly as old as the whole span still counts in the oldest bucket.
    """
    span = buckets * width_ms
    age = F.lit(as_of_ms) - F.col("ts_ms")
    slot = F.least(F.call_function("div", age, F.lit(width_ms)), F.lit(buckets - 1))
    recent = df.where(
        (F.col("ts_ms") >= as_of_ms - span) & (F.col("ts_ms") <= as_of_ms)
    ).withColumn("slot", F.lit(buckets - 1) - slot)
    counts = [F.count_if(F.col("slot") == i) for i in range(buckets)]
    return recent.agg(F.array(*counts).alias("counts")).select(
        F.posexplode("counts").alias("bucket", "n")
    )


def message_templates(df: DataFrame) -> DataFrame:
    """Messages grouped by their shape: how often, when, in how many groups."""
    per_group = (
        df.groupBy(tx.message_template("message").alias("template"), "log_group")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("ts_ms").alias("first_ts_ms"),
            F.max("ts_ms").alias("last_ts_ms"),
        )
    )
    return per_group.groupBy("template").agg(
        F.sum("n").alias("n"),
        F.min("first_ts_ms").alias("first_ts_ms"),
        F.max("last_ts_ms").alias("last_ts_ms"),
        F.count(F.lit(1)).alias("n_groups"),
        F.max_by("log_group", F.struct("n", "log_group")).alias("main_group"),
    )


def incident_timeline(df: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """Every event with the gap to the event before it in the same group.

    Gaps are worked out between distinct timestamps, which are at most `bucket_ms` per
    group and bucket however many events share them. Inside a bucket a window finds the
    previous timestamp; the first one of a bucket takes it from the group's bucket
    before. Then the first event of each timestamp gets its gap, further ones get zero.
    """
    stamps = (
        df.groupBy("log_group", "ts_ms")
        .agg(F.min("id").alias("first_id"))
        .withColumn("bucket", bucket_of("ts_ms", bucket_ms))
    )
    inside = Window.partitionBy("log_group", "bucket").orderBy("ts_ms")
    across = Window.partitionBy("log_group").orderBy("bucket")
    carried = (
        stamps.groupBy("log_group", "bucket")
        .agg(F.max("ts_ms").alias("last_ts"))
        .select("log_group", "bucket", F.lag("last_ts").over(across).alias("carried_ts"))
    )
    previous = (
        stamps.withColumn("inner_ts", F.lag("ts_ms").over(inside))
        .join(carried, ["log_group", "bucket"])
        .select(
            "log_group", "ts_ms", "first_id",
            F.coalesce("inner_ts", "carried_ts").alias("previous_ts_ms"),
        )
    )
    gap = F.when(F.col("id") == F.col("first_id"), F.col("ts_ms") - F.col("previous_ts_ms")).otherwise(
        F.lit(0)
    )
    return (
        df.select("id", "log_group", "ts_ms")
        .join(previous, ["log_group", "ts_ms"])
        .select("id", "log_group", "ts_ms", gap.alias("gap_ms"))
    )


def incident_sessions(df: DataFrame, gap: str = "30 minutes", gap_ms: int = 30 * MINUTE_MS) -> DataFrame:
    """Runs of suspects of a group with no pause longer than the gap.

    Suspects are first merged per (group, gap-wide bucket): events in one bucket are
    always in one session. A session of merged rows starts at the earliest event and
    its gap is counted from the latest one.
    """
    merged = (
        suspects(df)
        .groupBy("log_group", bucket_of("ts_ms", gap_ms).alias("bucket"))
        .agg(
            F.min("ts_ms").alias("lo"),
            F.max("ts_ms").alias("hi"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("ts", F.timestamp_millis("lo"))
    )
    length = F.concat((F.col("hi") - F.col("lo") + gap_ms).cast("string"), F.lit(" milliseconds"))
    return (
        merged.groupBy("log_group", F.session_window("ts", length))
        .agg(F.min("lo").alias("first_ts_ms"), F.max("hi").alias("last_ts_ms"), F.sum("n").alias("n"))
        .select("log_group", "first_ts_ms", "last_ts_ms", "n")
    )


def alert_prompt(
    context: DataFrame, interval_ms: int, header: str, footer: str, start_ms: int | None = None
) -> DataFrame:
    """One prompt per tick for an external scorer: range, busiest groups, sample lines.

    The range begins at `start_ms`, where a stored tick's window really began, or one interval back.
    """
    began = F.col("tick_ms") - interval_ms if start_ms is None else F.lit(start_ms).cast("long")
    line = lambda s: F.concat(
        F.lit("- ["), tx.iso_time(s["ts_ms"]), F.lit("] "), s["log_group"], F.lit(" "),
        s["log_stream"], F.lit(": "), tx.truncate(s["message"], 500),
    )
    body = F.concat_ws(
        "\n",
        F.lit(header),
        F.concat(
            F.lit("Time range: "), tx.iso_time(began),
            F.lit(" .. "), tx.iso_time("tick_ms"),
        ),
        F.concat(F.lit("Aggregates: "), F.substring(F.to_json("aggregates"), 1, 1500)),
        F.concat(F.lit("Samples ("), F.size("samples").cast("string"), F.lit("):")),
        F.transform("samples", line),
        F.lit(footer),
    )
    return context.select("tick_ms", body.alias("prompt"))
