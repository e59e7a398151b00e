"""Detection: one tick behind a cursor, or all ticks of a table at once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.timeparse import MINUTE_MS
from vigil.operators import alerts, detect, incidents, score
from vigil.session import materialize
from vigil.sources.store import SnapshotStore

# Instructions around the rows of a prompt; any scorer that answers in this shape fits.
PROMPT_HEADER = (
    "You judge recent log events. Name the incidents in them.\n"
    'Answer with JSON only: {"incidents": [{"title", "severity", "confidence", '
    '"dedupe_key", "summary", "suggested_actions", "tags"}]}\n'
    "severity is info, low, medium, high or critical; confidence is between 0 and 1."
)
PROMPT_FOOTER = "Give one entry for each distinct problem, and an empty list if there is none."

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Settings:
    interval_ms: int = 5 * MINUTE_MS
    window_min: int = 10
    #: a tick reads all events behind its cursor, or the oldest so many
    max_events: int | None = None
    max_samples: int = 5
    top_groups: int = 5
    min_len: int = 10
    min_severity: str = "medium"
    min_confidence: float = 60


CONTEXT = ("first_ts_ms", "last_ts_ms", "event_count", "aggregates")


def incidents_of(
    ticked: DataFrame,
    settings: Settings = Settings(),
    scorer: Scorer | None = None,
    dedupe: Column | None = None,
    counts: DataFrame | None = None,
    start_ms: int | None = None,
) -> DataFrame:
    """Built incident rows of all ticks in `ticked` (log rows with tick_ms).

    The rule scorer works on the counts per (tick, group), which carry the summary of
    their tick, so the events are read once for counts and once for samples. An external
    scorer gets one prompt per tick and its answers are joined with the tick again.
    """
    counts = detect.group_counts(ticked, "tick_ms") if counts is None else counts
    bounds = (settings.min_severity, settings.min_confidence)
    if scorer is None:
        window = detect.with_window(counts, top=settings.top_groups)
        gated = score.gate(score.rule_incidents(window, dedupe, CONTEXT), *bounds)
        lists = detect.sample_lists(ticked, settings.max_samples)
        return incidents.build(detect.join_samples(gated, lists))
    context = detect.tick_context(ticked, counts, settings.top_groups, settings.max_samples)
    prompts = detect.alert_prompt(context, settings.interval_ms, PROMPT_HEADER, PROMPT_FOOTER, start_ms)
    gated = score.gate(score.parse_incidents(scorer(prompts)), *bounds)
    return incidents.build(gated.join(context, "tick_ms"))


def replay(
    logs: DataFrame,
    settings: Settings = Settings(),
    scorer: Scorer | None = None,
    dedupe: Column | None = None,
) -> DataFrame:
    """Incidents of every tick of a table in one job."""
    ticked = detect.with_ticks(logs, settings.interval_ms, settings.min_len)
    return incidents_of(ticked, settings, scorer, dedupe)


def tick_window(
    logs: DataFrame, as_of_ms: int, cursor_ms: int | None, settings: Settings
) -> DataFrame:
    """The events one tick reads, marked with the tick."""
    return detect.window_scan(
        logs, as_of_ms, cursor_ms, settings.window_min, settings.max_events, settings.min_len
    ).withColumn("tick_ms", F.lit(as_of_ms))


def tick(
    logs: DataFrame,
    as_of_ms: int,
    cursor_ms: int | None = None,
    settings: Settings = Settings(),
    scorer: Scorer | None = None,
    dedupe: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(incident rows, cursor row) of one tick at `as_of_ms`."""
    window = tick_window(logs, as_of_ms, cursor_ms, settings)
    start = detect.window_start(as_of_ms, cursor_ms, settings.window_min)
    return (
        incidents_of(window, settings, scorer, dedupe, start_ms=start),
        detect.next_cursor(window, as_of_ms),
    )


def run_tick(
    logs: DataFrame,
    store: SnapshotStore,
    cursors: SnapshotStore,
    outbox_path: str,
    as_of_ms: int,
    settings: Settings = Settings(),
    channels: tuple[str, ...] = (),
    scorer: Scorer | None = None,
    dedupe: Column | None = None,
    pipeline_id: str = "alerts",
) -> int:
    """One stored tick: read behind the cursor, merge incidents, write alerts, move the cursor.

    The commit of the incident table carries the pipeline's new cursor, so both move together:
    a tick that fails anywhere is simply run again. The cursor table is a copy for readers.
    Window and merged rows are written to the shared folder, so that outbox, snapshot
    and cursor agree whatever is lost meanwhile.
    """
    writer = f"tick:{pipeline_id}"
    cursor = store.position(writer)
    window = materialize(tick_window(logs, as_of_ms, cursor, settings), "tick")
    moved = detect.next_cursor(window, as_of_ms, pipeline_id)
    position = moved.first()["last_ts_ms"]
    start = detect.window_start(as_of_ms, cursor, settings.window_min)
    built = incidents_of(window, settings, scorer, dedupe, start_ms=start)
    merged = materialize(incidents.merge(store.read(), built), "tick")
    if merged.where("touched").isEmpty():
        store.mark(position, writer)
    else:
        alerts.outbox(merged, list(channels)).write.mode("overwrite").parquet(
            f"{outbox_path}/writer={folder_name(writer)}/batch={position}"
        )
        store.replace(merged, position, writer)
    cursors.replace(incidents.upsert_cursors(cursors.read(), moved))
    return position


def folder_name(writer: str) -> str:
    """A writer's id as the name of a folder."""
    return hashlib.sha1(writer.encode()).hexdigest()[:12]


def passed_over(logs: DataFrame, as_of_ms: int, cursor_ms: int, settings: Settings = Settings()) -> int:
    """Events between a cursor and the window of the next tick, which that tick will not read.

    More than none means that ticks come too rarely for the look-back of `window_min`.
    """
    start = detect.window_start(as_of_ms, cursor_ms, settings.window_min)
    missed = logs.where((F.col("ts_ms") > cursor_ms) & (F.col("ts_ms") <= start))
    return missed.where(F.char_length("message") >= settings.min_len).count()
