import os

import pytest
from pyspark.sql import functions as F

from vigil.functions.timeparse import MINUTE_MS
from vigil.operators import detect, embed, incidents
from vigil.plans import detection, ingest
from vigil.schema import CURSORS, INCIDENTS, INGESTED, LOG_EVENTS
from vigil.sources import tables
from vigil.sources.store import SnapshotStore
from vigil.streaming import streams

SCHEMA = "id string, log_group string, log_stream string, ts_ms long, message string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def log_rows(n, start=0, step=20_000):
    return [
        (f"{start + i:05d}", f"g{i % 3}", f"s{i % 2}", 1 + start + i * step, "an error came up" if i % 3 == 0 else "nothing here")
        for i in range(n)
    ]


def landing(tmp_path, name, text):
    folder = tmp_path / "in" / "group-a"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_ingest_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    lines = "stray\n2025-01-01T00:00:00Z s1 one\n two\n2025-01-02T00:00:00Z s2 \x1b[31mthree\x1b[0m\n"
    landing(tmp_path, "a.log", lines)
    source, table, ckpt = (str(tmp_path / n) for n in ("in", "table", "ckpt"))
    def run():
        streams.ingest_stream(
            spark, source, table, ckpt, embed.hash_embedder(16), every=None, max_files=1
        ).awaitTermination()
        ingest.flush_open(spark, embed.hash_embedder(16), table)

    run()
    first = {r.id: r.message for r in ingest.read_table(spark, table).collect()}
    assert sorted(first.values()) == ["\x1b[31mthree\x1b[0m", "one\n two"]
    run()
    assert {r.id: r.message for r in ingest.read_table(spark, table).collect()} == first
    landing(tmp_path, "b.log", "2025-01-01T00:00:05Z s1 one\n2025-01-01T00:00:06Z s1 \x1b[0m\n")
    run()
    stored = ingest.read_table(spark, table)
    assert stored.count() == 3 and stored.select("id").distinct().count() == 3
    rejects = {r.reason: r.message for r in ingest.read_rejects(spark, table).collect()}
    assert set(rejects) == {"blank message", "no header"} and rejects["no header"] == "stray"
    assert stored.where("day = '2025-01-02'").count() == 1
    assert ingest.new_rows(stored, stored).count() == 0
    rows = spark.read.schema(INGESTED).parquet(table).drop("batch")
    ingest.write_batch(rows, str(tmp_path / "again"), 0, rebalance=True)
    assert ingest.read_table(spark, str(tmp_path / "again")).count() == 3


def test_events_go_on_in_the_next_file(spark, tmp_path):
    source, table, ckpt = (str(tmp_path / n) for n in ("in", "table", "ckpt"))
    embedder = embed.hash_embedder(16)
    files = [
        ("1.log", "stray\n2025-01-01T00:00:00Z s one\n more of one\n"),
        ("2.log", " still one\n"),
        ("3.log", " end of one\n2025-01-01T00:00:01Z s two\n2025-01-01T00:00:01Z s two\n"),
        ("4.log", "2025-01-01T00:00:02Z s three\n"),
        ("5.log", " tail of three\n"),
    ]
    query = None
    for name, text in files:
        landing(tmp_path, name, text)
        query = streams.ingest_stream(spark, source, table, ckpt, embedder, every=None)
        query.awaitTermination()
    messages = lambda: sorted(r.message for r in ingest.read_table(spark, table).collect())
    done = ["one\n more of one\n still one\n end of one", "two", "two"]
    assert messages() == done
    for _ in range(2):
        ingest.flush_open(spark, embedder, table, 4)
        assert messages() == [done[0], "three\n tail of three", "two", "two"]
    stored = ingest.read_table(spark, table)
    assert stored.select("id").distinct().count() == stored.count()


def test_files_continue_in_the_order_they_were_written(spark, tmp_path):
    source, table, ckpt = (str(tmp_path / n) for n in ("in", "table", "ckpt"))
    for i, name in enumerate(("2.log", "10.log")):
        text = "2025-01-01T00:00:00Z s first\n" if not i else " tail\n2025-01-01T00:00:01Z s second\n"
        landing(tmp_path, name, text)
        os.utime(next(p for p in (tmp_path / "in").rglob(name)), (1_700_000_000 + i, 1_700_000_000 + i))
    streams.ingest_stream(spark, source, table, ckpt, embed.hash_embedder(16), every=None).awaitTermination()
    ingest.flush_open(spark, embed.hash_embedder(16), table)
    assert sorted(r.message for r in ingest.read_table(spark, table).collect()) == ["first\n tail", "second"]


def test_several_rotated_files_in_one_batch(spark, tmp_path):
    source, table, ckpt = (str(tmp_path / n) for n in ("in", "table", "ckpt"))
    for i in range(6):
        landing(tmp_path, f"{i}.log", f" tail of {i - 1}\n2025-01-01T00:00:0{i}Z s event {i}\n")
    streams.ingest_stream(
        spark, source, table, ckpt, embed.hash_embedder(16), every=None
    ).awaitTermination()
    got = sorted(r.message for r in ingest.read_table(spark, table).collect())
    assert got == [f"event {i}\n tail of {i}" for i in range(5)]


def closed_only(df, settings, delay_ms):
    last = df.agg(F.max("ts_ms")).first()[0] - 1
    built = detection.replay(df, settings)
    return built.where(F.col("now_ms") <= last - delay_ms)


def snapshot_rows(df):
    return sorted(
        map(tuple, df.select("dedupe_key", "severity", "title", "event_count", "first_ts_ms", "last_ts_ms", "sample_ids").collect())
    )


def test_detect_stream_equals_batch(spark, tmp_path):
    settings = detection.Settings(interval_ms=5 * MINUTE_MS, min_severity="low", min_confidence=10)
    folder = str(tmp_path / "logs")
    rows = log_rows(200)
    put(spark, folder, rows)
    store = streams.incident_store(spark, str(tmp_path / "incidents"))
    run = lambda: streams.detect_stream(
        stream(spark, folder), lambda: spark.read.schema(SCHEMA).parquet(folder), store, str(tmp_path / "out"),
        str(tmp_path / "ckpt"), settings, channels=("slack",), dedupe=F.col("log_group"), every=None,
    ).awaitTermination()
    run()
    df = spark.createDataFrame(rows, SCHEMA)
    expected = closed_only(df, settings, 10 * MINUTE_MS).withColumn("dedupe_key", F.lit("g0"))
    twin = incidents.merge(incidents.empty_snapshot(expected), expected)
    assert snapshot_rows(store.read()) == snapshot_rows(twin)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    version = store.head()[0]
    run()
    assert store.head()[0] == version
    # more rows close more ticks of the same incident: counts grow, nobody is told again
    more = log_rows(100, start=200 * 20_000)
    put(spark, folder, more)
    run()
    expected = closed_only(spark.createDataFrame(rows + more, SCHEMA), settings, 10 * MINUTE_MS).withColumn("dedupe_key", F.lit("g0"))
    twin = incidents.merge(incidents.empty_snapshot(expected), expected)
    assert snapshot_rows(store.read()) == snapshot_rows(twin)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_store_keeps_old_versions_and_knows_its_batches(spark, tmp_path):
    schema = "a long, b string"
    store = SnapshotStore(spark, str(tmp_path / "s"), spark.createDataFrame([], schema).schema).ensure()
    assert store.read().count() == 0 and not store.has_batch(0)
    old = store.read()
    store.replace(spark.createDataFrame([(1, "x")], schema), batch_id=0)
    assert store.has_batch(0) and not store.has_batch(1)
    assert old.count() == 0 and store.read().count() == 1
    store.replace(store.read().unionByName(spark.createDataFrame([(2, "y")], schema)), batch_id=3)
    assert store.read().count() == 2 and store.has_batch(2)
    assert SnapshotStore(spark, str(tmp_path / "s"), store.schema).ensure().head()[0] == 2


def test_stored_ticks_move_the_cursor_with_the_incidents(spark, tmp_path):
    settings = detection.Settings(interval_ms=300_000, min_severity="low", min_confidence=10, max_events=20)
    logs = spark.createDataFrame(log_rows(60, step=10_000), SCHEMA)
    paths = tables.ensure_store(spark, str(tmp_path / "base"))
    store = streams.incident_store(spark, paths["incidents"])
    cursors = SnapshotStore(spark, paths["cursors"], CURSORS)
    go = lambda now, df=logs: detection.run_tick(
        df, store, cursors, str(tmp_path / "out"), now, settings, ("slack",), dedupe=F.col("log_group")
    )
    assert go(600_000) == 190_001  # at most 20 events, then the cursor stands at the last of them
    assert go(600_000) == 390_001
    (row,) = store.read().collect()
    assert (row.dedupe_key, row.event_count, row.created_ms) == ("g0", 40, 600_000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1

    class Broken(SnapshotStore):
        def replace(self, rows, batch_id=-1, writer_id=""):
            raise OSError("disk gone")

    with pytest.raises(OSError):
        detection.run_tick(
            logs, Broken(spark, paths["incidents"], INCIDENTS), cursors, str(tmp_path / "out"), 600_000,
            settings, ("slack",), dedupe=F.col("log_group"),
        )
    assert go(600_000) == 590_001
    assert store.read().first().event_count == 60
    assert go(700_000) == 700_000  # nothing new: the cursor is the time of the tick
    assert store.read().first().event_count == 60
    assert incidents.read_cursor(cursors.read(), "alerts") == 700_000
    # another pipeline on the same store has a cursor of its own, and batches of streams are not taken for done
    other = lambda now: detection.run_tick(
        logs, store, cursors, str(tmp_path / "out"), now, settings, dedupe=F.lit("other"), pipeline_id="b"
    )
    assert other(600_000) == 190_001 and store.read().where("dedupe_key = 'other'").first().event_count == 20
    assert not store.has_batch(0, "stream:x") and go(800_000) == 800_000
    assert detection.passed_over(logs, 1_500_000, 1, settings) == 59


def test_unfinished_version_is_not_seen(spark, tmp_path):
    schema = "a long"
    store = SnapshotStore(spark, str(tmp_path / "s"), spark.createDataFrame([], schema).schema).ensure()
    spark.createDataFrame([(9,)], schema).write.parquet(str(tmp_path / "s" / "v=1"))
    assert store.read().count() == 0
    store.replace(spark.createDataFrame([(1,)], schema))
    assert [r.a for r in store.read().collect()] == [1]


def drain(spark, df, tmp_path):
    streams.to_parquet(df, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / "o"))


def test_rate_and_late_rows(spark, tmp_path):
    folder = str(tmp_path / "logs")
    put(spark, folder, log_rows(30, step=20_000))
    put(spark, folder, log_rows(30, start=3_600_000, step=20_000))
    put(spark, folder, [("late", "g", "s", 5, "late row")])
    # the files are read in the order they were written, one per batch
    files = sorted((f for f in os.listdir(folder) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{folder}/{f}"))
    for i, f in enumerate(files):
        os.utime(f"{folder}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    query = streams.to_parquet(streams.rate(stream(spark, folder), delay="1 minute"), str(tmp_path / "o"), str(tmp_path / "c"))
    query.awaitTermination()
    got = {r.bucket_ms: r.n for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got[0] == 3 and sum(n for b, n in got.items() if b < 3_600_000) == 30
    streams.rate_to_table(stream(spark, folder), str(tmp_path / "r"), str(tmp_path / "rc"), delay="1 minute", every=None).awaitTermination()
    shown = {r.bucket_ms: r.n for r in streams.read_rate(spark, str(tmp_path / "r")).collect()}
    assert sum(shown.values()) == 60 and max(shown) > 3_600_000
    dropped = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    assert dropped == 1


def test_sessions_equal_batch_for_closed_ones(spark, tmp_path):
    folder = str(tmp_path / "logs")
    rows = [(str(i), "g", "s", t * MINUTE_MS, "error") for i, t in enumerate([0, 10, 25, 70, 71, 200, 500])]
    put(spark, folder, rows)
    got = drain(spark, streams.session_incidents(stream(spark, folder), "30 minutes"), tmp_path)
    assert sorted((r.first_ts_ms // MINUTE_MS, r.n) for r in got.collect()) == [(0, 3), (70, 2), (200, 1)]
    twin = detect.incident_sessions(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.first_ts_ms // MINUTE_MS, r.n) for r in twin.collect()) == [(0, 3), (70, 2), (200, 1), (500, 1)]


def test_repeated_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "logs")
    put(spark, folder, log_rows(20))
    put(spark, folder, log_rows(20))
    assert drain(spark, streams.dedupe_stream(stream(spark, folder)), tmp_path).count() == 20


def test_ensure_store(spark, tmp_path):
    paths = tables.ensure_store(spark, str(tmp_path / "base"))
    assert tables.ensure_store(spark, str(tmp_path / "base")) == paths
    assert tables.open_logs(spark, paths["log_events"], path=True).schema.fieldNames() == LOG_EVENTS.fieldNames()
    assert SnapshotStore(spark, paths["incidents"], INCIDENTS).read().count() == 0
    spark.range(1).createOrReplaceTempView("some_table")
    assert tables.open_logs(spark, "some_table").count() == 1


def test_shared_dir_follows_the_session(spark):
    from vigil.session import shared_dir

    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(base + "/x-")
    with pytest.raises(AssertionError):
        assert shared_dir(spark, "x") == shared_dir(spark, "x")
