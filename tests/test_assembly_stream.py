"""Stateful assembly of events, and files that grow."""

import os

import pytest
from pyspark.sql import functions as F

from vigil.operators import assemble
from vigil.sources import growing_files, raw_lines
from vigil.streaming import assembly

HEAD = "2025-01-01T00:00:{:02d}.000Z app-{} "


@pytest.fixture(autouse=True)
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def put(root, group, name, text, at):
    folder = root / group
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text(text)
    os.utime(path, (at, at))


def stream(spark, root, out, checkpoint, idle_ms=10_000, per_batch=1, **options):
    text = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch)
    lines = assembly.text_lines(text.text(str(root)).select("value", "_metadata"))
    query = assembly.assemble_stream(lines, idle_ms).writeStream.format("parquet").option("path", str(out)).option(
        "checkpointLocation", str(checkpoint)
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(assembly.EVENT).parquet(str(out))


def events(df, strays=False):
    return sorted((r.log_group, r.message) for r in df.collect() if r.strays == strays)


def test_an_idle_source_flushes_itself_and_a_restart_repeats_nothing(spark, tmp_path):
    root, out, chk = tmp_path / "in", tmp_path / "out", tmp_path / "chk"
    put(root, "a", "1.log", "stray\n" + HEAD.format(1, 1) + "first\n  more\n\n" + HEAD.format(2, 1) + "second\n", 1000)
    put(root, "a", "2.log", "goes on\nand on\n", 1005)
    got = stream(spark, root, out, chk)
    assert events(got) == [("a", "first\n  more")] and events(got, True) == [("a", "stray")]
    # a restart with a line that another source brings much later: the open event closes by its timer
    put(root, "b", "1.log", HEAD.format(3, 2) + "other\n", 1100)
    got = stream(spark, root, out, chk)
    assert events(got) == [("a", "first\n  more"), ("a", "second\ngoes on\nand on")]
    row = got.where("message LIKE 'second%'").first()
    assert (row.log_stream, row.ts_ms) == ("app-1", 1_735_689_602_000)
    # lines behind that have no event any more; the other source's event is still open, and goes on
    put(root, "a", "3.log", "too late\n", 1101)
    put(root, "b", "2.log", "tail\n" + HEAD.format(4, 2) + "last\n", 1102)
    got = stream(spark, root, out, chk)
    assert events(got, True) == [("a", "stray"), ("a", "too late")]
    assert ("b", "other\ntail") in events(got) and not any("last" in m for _, m in events(got))
    assert events(stream(spark, root, out, chk)) == events(got)


def test_an_event_that_goes_on_moves_its_timer(spark, tmp_path):
    root, out, chk = tmp_path / "in", tmp_path / "out", tmp_path / "chk"
    put(root, "a", "1.log", HEAD.format(1, 1) + "open\n", 1000)
    put(root, "a", "2.log", "still\n", 1008)
    put(root, "b", "1.log", HEAD.format(1, 1) + "x\n", 1012)  # behind the first timer, before the second
    assert events(stream(spark, root, out, chk)) == []
    put(root, "b", "2.log", HEAD.format(2, 1) + "y\n", 1030)
    assert events(stream(spark, root, out, chk)) == [("a", "open\nstill"), ("b", "x")]


@pytest.mark.parametrize("per_batch", [1, 3, 100])
def test_same_rows_as_in_batch(spark, tmp_path, per_batch):
    root = tmp_path / "in"
    for f in range(6):
        for group in ("hot", "cold"):
            n = 40 if group == "hot" else 1
            lines = [f"{HEAD.format(i % 60, f)}message {f} {i}\n  at line {i}\n" if i % 3 else f"continues {f} {i}\n" for i in range(n)]
            put(root, group, f"{f}.log", "".join(lines), 1000 + f)
    put(root, "end", "z.log", "nothing here\n", 2000)  # a later arrival closes what is open
    got = stream(spark, root, tmp_path / "out", tmp_path / "chk", per_batch=per_batch)
    lines = raw_lines.number_lines(
        spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(str(root)).select("value", "_metadata")
    )
    by_group = lines.withColumn("chunk", F.struct("modified", "file", "chunk")).withColumn("file", F.col("log_group"))
    want = assemble.assemble_events(by_group)
    assert events(got) == sorted((r.log_group, r.message) for r in want.collect())


def test_long_runs_without_a_header_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(assembly, "PIECE_CHARS", 50)
    root = tmp_path / "in"
    put(root, "a", "1.log", "".join(f"line number {i}\n" for i in range(30)), 1000)
    got = stream(spark, root, tmp_path / "out", tmp_path / "chk")
    parts = [m for _, m in events(got, True)]
    assert len(parts) > 3 and sum(p.count("\n") + 1 for p in parts) == 30


# --- growing files ------------------------------------------------------------


def grown(spark, root, out, checkpoint, split=growing_files.SPLIT_BYTES):
    lines = growing_files.growing_lines(spark, str(root), split_bytes=split)
    lines.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(
        availableNow=True
    ).start().awaitTermination()
    rows = spark.read.schema(f"log_group string, {growing_files.SCHEMA}").parquet(str(out)).collect()
    return sorted((r.log_group, os.path.basename(r.file), r.line_no, r.line) for r in rows)


def test_appended_lines_come_once(spark, tmp_path):
    root, out, chk = tmp_path / "in", tmp_path / "out", tmp_path / "chk"
    (root / "g").mkdir(parents=True)
    log = root / "g" / "a.log"
    log.write_bytes("one\nzwei ä\n\nhalf".encode())
    (root / "g" / "empty.log").write_bytes(b"")
    (root / "g" / ".hidden").write_bytes(b"x\n")
    first = [("g", "a.log", 0, "one"), ("g", "a.log", 4, "zwei ä"), ("g", "a.log", 12, "")]
    assert grown(spark, root, out, chk) == first
    assert grown(spark, root, out, chk) == first  # a restart repeats nothing
    with log.open("ab") as f:
        f.write(b" a line\nlast\n\xff\n")
    (root / "g" / "b.log").write_bytes(b"new\n")
    second = first + [("g", "a.log", 13, "half a line"), ("g", "a.log", 25, "last"), ("g", "a.log", 30, "�"), ("g", "b.log", 0, "new")]
    assert grown(spark, root, out, chk) == second
    log.write_bytes(b"rotated\n")  # shorter: another file under the name
    assert grown(spark, root, out, chk) == sorted([*second, ("g", "a.log", 0, "rotated")])


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_every_line_is_in_one_partition(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(growing_files, "BLOCK", 5)
    path = tmp_path / "g" / "x.log"
    path.parent.mkdir()
    lines = ["", "a", "bc" * 9, "", "", "ü" * 4, "end"]
    path.write_text("".join(f"{x}\n" for x in lines) + "unfinished")
    reader = growing_files.Reader(str(tmp_path), split)
    end = reader.latestOffset()
    got = [row for p in reader.partitions(reader.initialOffset(), end) for row in reader.read(p)]
    assert [r[3] for r in sorted(got, key=lambda r: r[2])] == lines
    assert [p for p in reader.partitions(end, end) if p.start < p.end] == []


def test_growing_files_feed_the_assembly(spark, tmp_path):
    root, out, chk = tmp_path / "in", tmp_path / "out", tmp_path / "chk"

    def run():
        lines = growing_files.growing_lines(spark, str(root), split_bytes=40)
        assembly.assemble_stream(lines).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(chk)).trigger(
            availableNow=True
        ).start().awaitTermination()
        return events(spark.read.schema(assembly.EVENT).parquet(str(out)))

    put(root, "a", "1.log", HEAD.format(1, 1) + "first\n" + HEAD.format(2, 1) + "sec", 1000)
    assert run() == []
    with (root / "a" / "1.log").open("a") as f:
        f.write("ond\n  detail\n" + HEAD.format(3, 1) + "third\n")
    os.utime(root / "a" / "1.log", (1010, 1010))
    assert run() == [("a", "first"), ("a", "second\n  detail")]
    put(root, "b", "1.log", "later\n", 1100)
    run()
    # with this source a batch without lines is not run, so the timer fires in the next one that has some
    put(root, "b", "2.log", "later\n", 1101)
    assert run() == [("a", "first"), ("a", "second\n  detail"), ("a", "third")]
