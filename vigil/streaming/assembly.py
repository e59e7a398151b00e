"""Multi-line events from a stream of lines, with state: an event that nothing ends is closed by a timer.

Lines of a file split stay in their task, in order, and are put together there; what a split cannot know is how the
event before it ends and whether its own last event goes on. So of a split only its border pieces meet the state of
their source: the lines before its first header, and its last event. All events between are complete and
are passed on under spread keys, so a hot source is no hot state. The state of a source is its open event, as a
list of pieces; border pieces of a batch are put in the order of files (modification time, name) and splits.

An event ends with the next header of its source, or by an event-time timer `idle_ms` after the arrival of its last
line, when the watermark over arrival times (of all sources) passes that. Spark keeps state and timers in
the checkpoint, so a restart loses and repeats nothing.

Defined cases: blank lines are skipped; lines before the first header of a source have no event and come out with
`strays` and a null time, in pieces of bounded size; an empty file changes nothing; a null group is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigil.operators import assemble

PIECE = (
    "log_group string, slot int, modified timestamp, file string, chunk long, no int, closes boolean, head boolean, "
    "ts_ms long, log_stream string, message string"
)
EVENT = "log_group string, log_stream string, ts_ms long, message string, strays boolean"
#: Keys that complete events are spread over, and characters of a piece of lines that go on.
SLOTS, PIECE_CHARS = 64, 1 << 20


def text_lines(text: DataFrame, group: Column | None = None) -> DataFrame:
    """Lines of a streaming text reader (value, _metadata) with their split; the parent folder names the log group."""
    named = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"), F.col("value").alias("line"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )
    group = F.regexp_extract("file", r"([^/]+)/[^/]*$", 1) if group is None else group
    return named.select(group.alias("log_group"), "file", "chunk", "line", "modified")


def pieces(lines: DataFrame) -> DataFrame:
    """The events and border pieces of each split; lines (log_group, file, chunk, line, modified) in the order of reading."""
    parsed = assemble.parse_header(lines.where(F.col("log_group").isNotNull())).where(F.col("line") != "")
    columns = ["log_group", "file", "chunk", "modified", "is_header", "ts_ms", "log_stream"]
    parsed = parsed.select(*columns, F.coalesce("rest", "line").alias("text"))
    kind = pa.schema([
        ("log_group", pa.string()), ("slot", pa.int32()), ("modified", pa.timestamp("us", "UTC")), ("file", pa.string()), ("chunk", pa.int64()),
        ("no", pa.int32()), ("closes", pa.bool_()), ("head", pa.bool_()), ("ts_ms", pa.int64()), ("log_stream", pa.string()), ("message", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None  # the split being read: group, file, chunk, modified
        head, held, size, no = None, [], 0, 0
        out: list[tuple] = []

        def put(slot: int, closes: bool) -> None:
            nonlocal no
            ts, stream = head or (None, None)
            out.append((split[0], slot, split[3], split[1], split[2], no, closes, head is not None, ts, stream, "\n".join(held) if held else None))
            no += 1

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)
                out.clear()

        for batch in batches:
            values = [c.to_pylist() for c in batch.columns]
            for group, file, chunk, modified, is_header, ts, stream, text in zip(*values):
                if split is None or (file, chunk, group) != (split[1], split[2], split[0]):
                    if split is not None and (head or held):
                        put(0, False)
                    split, head, held, size, no = (group, file, chunk, modified), None, [], 0, 0
                if is_header:
                    if head is None:
                        put(0, True)  # what stood before the first header ends the event before it
                    else:
                        put(1 + no % SLOTS, True)
                    head, held, size = (ts, stream), [text], len(text)
                else:
                    if head is None and size > PIECE_CHARS:
                        put(0, False)
                        held, size = [], 0
                    held.append(text)
                    size += len(text)
                if len(out) >= 1000:
                    yield from flush()
        if split is not None and (head or held):
            put(0, False)
        yield from flush()

    return parsed.mapInArrow(run, PIECE)


class Assembler(StatefulProcessor):
    """The open event of a source: its header as a value, its texts as a list."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "log_stream string, ts_ms long, last_ms long")
        self.texts = handle.getListState("texts", "text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        group, slot = key
        if slot:
            for part in rows:
                yield _events([(group, *r, False) for r in part[["log_stream", "ts_ms", "message"]].itertuples(index=False)])
            return
        # two pieces a split, and those of long runs of lines without a header
        border = pd.concat(list(rows)).sort_values(["modified", "file", "chunk", "no"])
        out = []
        for r in border.itertuples(index=False):
            text = None if r.message is None or r.message != r.message else r.message
            if r.head:
                out += self._close(group)
                self._open(r, text)
            elif text is not None:
                if self.head.exists():
                    self.texts.appendValue((text,))
                    self._touch(r)
                else:
                    out.append((group, None, None, text, True))
            if r.closes and not r.head:
                out += self._close(group)
        yield _events(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        # an older timer of an event that went on, or of another one, does nothing
        due = self.head.exists() and self.head.get()[2] + self.idle_ms <= at
        yield _events(self._close(key[0]) if due else [])

    def _open(self, r, text: str | None) -> None:
        self.head.update((r.log_stream, _number(r.ts_ms), 0))
        self.texts.put([(text or "",)])
        self._touch(r)

    def _touch(self, r) -> None:
        stream, ts, _ = self.head.get()
        last = int(pd.Timestamp(r.modified).timestamp() * 1000)
        self.head.update((stream, ts, last))
        self.handle.registerTimer(last + self.idle_ms)

    def _close(self, group: str) -> list[tuple]:
        if not self.head.exists():
            return []
        stream, ts, _ = self.head.get()
        message = "\n".join(t for (t,) in self.texts.get())
        self.head.clear()
        self.texts.clear()
        return [(group, stream, ts, message, False)]

    def close(self) -> None:
        pass


def _number(x) -> int | None:
    return None if x is None or x != x else int(x)


def _events(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["log_group", "log_stream", "ts_ms", "message", "strays"])
    return out.astype({"ts_ms": "Int64"})


def assemble_stream(lines: DataFrame, idle_ms: int = 10_000, delay: str = "0 seconds") -> DataFrame:
    """log_group, log_stream, ts_ms, message, strays of the events that ended."""
    cut = pieces(lines).withWatermark("modified", delay)
    return cut.groupBy("log_group", "slot").transformWithStateInPandas(
        statefulProcessor=Assembler(idle_ms), outputStructType=EVENT, outputMode="Append", timeMode="EventTime"
    )
