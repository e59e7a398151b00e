import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import browse, detect
from vigil.sources import tables

AS_OF = 600_000


def at(*times, message="ERROR long enough"):
    return [(f"{i:03d}", "g", "s", t, message) for i, t in enumerate(times)]


def test_window_is_open_at_the_start_and_closed_at_the_end(logs):
    df = logs(*at(0, 1, 300_000, 600_000, 600_001))
    got = lambda cursor: [r.ts_ms for r in detect.window_scan(df, AS_OF, cursor).orderBy("ts_ms").collect()]
    assert got(None) == [1, 300_000, 600_000]
    assert got(0) == [1, 300_000, 600_000]
    assert got(300_000) == [600_000]
    assert got(900_000) == []


def test_short_messages_are_left_out(logs):
    df = logs(("a", "g", "s", 5, "x" * 9), ("b", "g", "s", 5, "x" * 10))
    assert [r.id for r in detect.window_scan(df, AS_OF).collect()] == ["b"]


def test_ties_at_the_limit(logs):
    df = logs(*at(10, 20, 30, 30, 30, 40))
    ids = lambda **kw: sorted(r.id for r in detect.window_scan(df, AS_OF, max_events=3, **kw).collect())
    assert ids() == ["000", "001", "002", "003", "004"]
    assert ids(ties=False) == ["000", "001", "002"]
    window = detect.window_scan(df, AS_OF, max_events=3)
    cursor = detect.next_cursor(window, AS_OF).first()
    assert (cursor.last_ts_ms, cursor.last_id) == (30, "004")
    assert [r.id for r in detect.window_scan(df, AS_OF, cursor.last_ts_ms, max_events=3).collect()] == ["005"]


def test_cursor_of_an_empty_window_is_the_tick(logs):
    window = detect.window_scan(logs(*at(700_000)), AS_OF)
    assert detect.next_cursor(window, AS_OF).first().last_ts_ms == AS_OF


def test_top_groups_break_ties_by_first_seen(logs):
    rows = [("1", "b", "s", 5, "m" * 10), ("2", "a", "s", 6, "m" * 10), ("3", "c", "s", 1, "m" * 10), ("4", "c", "s", 9, "m" * 10)]
    ticked = detect.with_ticks(logs(*rows), 100)
    top = detect.top_groups(detect.group_counts(ticked, "tick_ms"), n=2).orderBy("rank").collect()
    assert [(r.log_group, r.n) for r in top] == [("c", 2), ("b", 1)]
    assert detect.group_counts_json(logs(*rows), n=2).first()[0] == '[{"group":"c","count":2},{"group":"b","count":1}]'


def test_ticks_take_the_right_edge(logs):
    ticked = detect.with_ticks(logs(*at(1, 100, 101, 200)), 100).orderBy("ts_ms").collect()
    assert [r.tick_ms for r in ticked] == [100, 100, 200, 200]


def test_rank_limits_run_before_the_shuffle(logs, capsys):
    detect.samples(detect.with_ticks(logs(*at(1, 2, 3)), 100)).explain()
    plan = capsys.readouterr().out
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def brute_gaps(rows):
    out, last = {}, {}
    for id_, group, _, ts, _ in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        out[id_] = ts - last[group] if group in last else None
        last[group] = ts
    return out


def test_timeline_equals_one_pass_even_with_a_hot_timestamp(logs):
    rng = random.Random(2)
    rows = [(f"{i:04d}", rng.choice("ab"), "s", rng.choice([7, 7, rng.randint(0, 90_000)]), "m") for i in range(600)]
    got = detect.incident_timeline(logs(*rows), bucket_ms=1000).collect()
    assert {r.id: r.gap_ms for r in got} == brute_gaps(rows)
    assert len(got) == len(rows)


def test_sessions_equal_one_pass(logs):
    rng = random.Random(4)
    gap = 60_000
    rows = [(str(i), rng.choice("ab"), "s", rng.randint(0, 6_000_000), rng.choice(["error", "fine"])) for i in range(250)]
    wanted = []
    for group in "ab":
        current = None
        for ts in sorted(r[3] for r in rows if r[1] == group and r[4] == "error"):
            if current and ts - current[2] <= gap:
                current[2], current[3] = ts, current[3] + 1
            else:
                current = [group, ts, ts, 1]
                wanted.append(current)
    got = detect.incident_sessions(logs(*rows), gap_ms=gap).collect()
    assert sorted([r.log_group, r.first_ts_ms, r.last_ts_ms, r.n] for r in got) == sorted(wanted)


def test_ingest_rate_keeps_empty_buckets(logs):
    df = logs(*at(300_000, 300_001, 599_999, 600_000, 299_999, 600_001))
    got = detect.ingest_rate(df, AS_OF).orderBy("bucket").collect()
    assert [r.n for r in got] == [2, 0, 0, 0, 2]


def test_trend_looks_at_the_bucket_before(logs):
    df = logs(("1", "g", "s", 0, "error"), ("2", "g", "s", 1, "fine"), ("3", "g", "s", 3_600_000, "error"))
    got = detect.error_trend(df).orderBy("bucket_ms").collect()
    assert [(r.rate, r.previous_rate, r.change) for r in got] == [(0.5, None, None), (1.0, 0.5, 0.5)]


def test_prompt(logs):
    ticked = detect.with_ticks(logs(("1", "g", "s", 1_735_689_600_000, "error " + "x" * 600)), 60_000)
    prompt = detect.alert_prompt(detect.tick_context(ticked), 60_000, "HEAD", "TAIL").first().prompt
    lines = prompt.split("\n")
    assert lines[0] == "HEAD" and lines[-1] == "TAIL"
    assert lines[1] == "Time range: 2024-12-31T23:59:00.000Z .. 2025-01-01T00:00:00.000Z"
    assert lines[2] == 'Aggregates: [{"group":"g","count":1}]'
    assert lines[3] == "Samples (1):"
    assert lines[4].startswith("- [2025-01-01T00:00:00.000Z] g s: error xx") and lines[4].endswith("x...")


def test_window_rows_agree_with_the_summary(logs):
    rng = random.Random(8)
    rows = [(str(i), f"g{rng.randint(0, 8)}", f"s{i % 3}", rng.randint(1, 1000), rng.choice(["an error here", "all is fine"])) for i in range(400)]
    ticked = detect.with_ticks(logs(*rows), 200)
    counts = detect.counts_of(detect.rollup(ticked, 50))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, detect.group_counts(ticked, "tick_ms").collect()))
    summary = {r.tick_ms: (r.first_ts_ms, r.last_ts_ms, r.event_count, r.aggregates) for r in detect.window_summary(counts).collect()}
    for r in detect.with_window(counts).collect():
        assert summary[r.tick_ms] == (r.first_ts_ms, r.last_ts_ms, r.event_count, r.aggregates)


def test_browse(logs):
    rows = [(f"{i}", "/app/A" if i % 2 else "/app/b", f"s{i % 3}", i, f"message {i}" + " error" * (i % 2)) for i in range(10)]
    df = logs(*rows)
    assert [r.id for r in browse.browse(df, 3).collect()] == ["9", "8", "7"]
    assert [r.id for r in browse.browse(df, 3, like="s1").collect()] == ["7", "4", "1"]
    assert [r.id for r in browse.browse(df, 2, like="  ").collect()] == ["9", "8"]
    assert {r.log_group: r.log_stream for r in browse.latest_stream(df).collect()} == {"/app/A": "s0", "/app/b": "s2"}
    assert [r.id for r in browse.latest_events(df, n=2, group="/app/A").collect()] == ["3", "9"]
    assert [r.id for r in browse.latest_events(df, n=2, group="/app/A", stream="s1").collect()] == ["1", "7"]
    assert [r.log_group for r in browse.group_catalog(df, "APP/B").collect()] == ["/app/b"]
    assert browse.fan_out(df, " /app/b ,, /none").count() == 5
    assert [r.id for r in browse.recent_errors(df, 2).collect()] == ["9", "7"]
    assert browse.derive(df, {"twice": "ts_ms * 2"}).agg(F.sum("twice")).first()[0] == 90


def test_day_folders_are_pruned(spark, logs, tmp_path, capsys):
    day = 86_400_000
    df = logs(*at(day + 5, 2 * day + 5, 3 * day + 5)).withColumn("day", tables.day_of("ts_ms"))
    df.write.partitionBy("day").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    found = detect.window_scan(table, 2 * day + 10, window_min=1, max_events=None)
    assert found.count() == 1
    found.explain()
    plan = capsys.readouterr().out
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThan(ts_ms" in plan


def test_unknown_day_column_is_no_problem(logs):
    df = logs(*at(1))
    assert tables.on_days(df, 0).count() == 1
    with pytest.raises(ValueError):
        browse.latest_events(df, start="1h")
