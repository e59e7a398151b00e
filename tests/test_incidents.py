import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import alerts, detect, incidents, score
from vigil.plans import detection
from vigil.schema import INCIDENTS, VECTOR_CONTEXT


def test_severity_and_confidence(spark):
    rows = spark.createDataFrame([("INFO",), ("High",), ("unknown",), (None,), ("critical",)], "s string")
    got = [r[0] for r in rows.select(score.normalize_severity("s")).collect()]
    assert got == ["info", "high", "medium", "medium", "critical"]
    assert rows.select(score.normalize_severity("s", compat=True)).first()[0] == "medium"
    ranks = spark.createDataFrame([("info",), ("critical",), ("x",)], "s string").select(score.severity_rank("s"))
    assert [r[0] for r in ranks.collect()] == [0, 4, -1]
    texts = [("0.7", 0.7), (" 0.7 ", 0.7), ("7", 1.0), ("-1", 0.0), ("abc", 0.0), (None, 0.0), ("NaN", 0.0), ("Infinity", 0.0), ("5f", 0.0), ("0.5d", 0.0), ("1e-1", 0.1), (".5", 0.5)]
    rows = spark.createDataFrame([(t,) for t, _ in texts], "c string")
    assert [r[0] for r in rows.select(score.clamp_confidence("c")).collect()] == [w for _, w in texts]


def test_parse_scorer_bodies(spark):
    good = (
        '{"incidents": [{"title": "A", "severity": "High", "confidence": 0.9, "tags": ["x"]},'
        ' {"title": "B", "confidence": "0.7", "dedupe_key": ""}]}'
    )
    bodies = spark.createDataFrame(
        [(1, good), (2, "not json"), (3, "{}"), (4, '{"incidents": "x"}'), (5, None)], "tick_ms long, body string"
    )
    rows = score.parse_incidents(bodies).orderBy("ord").collect()
    assert [(r.tick_ms, r.title, r.severity, r.confidence, r.dedupe_key, r.tags) for r in rows] == [
        (1, "A", "High", "0.9", None, ["x"]), (1, "B", None, "0.7", "", []),
    ]
    assert tuple(score.broken_bodies(bodies).first()) == (5, 4)
    kept = score.gate(score.parse_incidents(bodies), "medium", 80).collect()
    assert [(r.title, r.severity, r.confidence) for r in kept] == [("A", "high", 0.9)]
    with pytest.raises(ValueError):
        score.gate(score.parse_incidents(bodies), "loud")


def test_dedupe_key_fallback(spark):
    rows = spark.createDataFrame(
        [("k1", "T", 0), ("", "T", 0), (None, "", 3_600_000)], "given string, title string, t long"
    ).withColumn("agg", F.array(F.struct(F.lit("g").alias("group"), F.lit(2).cast("long").alias("count"))))
    got = [r[0] for r in rows.select(incidents.dedupe_key("given", "title", "agg", "t")).collect()]
    import hashlib

    shape = hashlib.sha1(b'[{"group":"g","count":2}]').hexdigest()[:16]
    assert got == ["k1", f"T|{shape}|1970-01-01T00", f"incident|{shape}|1970-01-01T01"]


BATCH = (
    "ord_key long, now_ms long, dedupe_key string, status string, severity string, title string, summary string, "
    "affected_group string, affected_stream string, first_ts_ms long, last_ts_ms long, event_count long, "
    f"sample_ids array<string>, vector_context {VECTOR_CONTEXT.simpleString()}"
)
COLUMNS = [c.split()[0] for c in BATCH.split(", ")][:13] + ["vector_context"]


def make(ord_key, key, **kw):
    row = dict(
        ord_key=ord_key, now_ms=1000 + ord_key, dedupe_key=key, status="open", severity="high", title=f"t{ord_key}",
        summary=None, affected_group=None, affected_stream=None, first_ts_ms=1, last_ts_ms=10, event_count=2,
        sample_ids=["a"], vector_context=None,
    )
    row.update(kw)
    return tuple(row[c] for c in COLUMNS)


def one_by_one(store, rows):
    """The upsert rules applied to one row after another."""
    for r in (dict(zip(COLUMNS, row)) for row in rows):
        key, now = r["dedupe_key"], r["now_ms"]
        if key not in store:
            store[key] = {**r, "created_ms": now, "updated_ms": now, "event_count": r["event_count"] or 0}
            continue
        old = store[key]
        old["updated_ms"] = now
        last = r["last_ts_ms"] if r["last_ts_ms"] is not None else now
        old["last_ts_ms"] = max(old["last_ts_ms"] or 0, last)
        old["event_count"] = (old["event_count"] or 0) + (r["event_count"] or 0)
        for c in ("summary", "affected_group", "affected_stream", "vector_context"):
            if r[c] is not None:
                old[c] = r[c]
    return store


CHECKED = (
    "created_ms", "updated_ms", "status", "severity", "title", "summary", "affected_group", "affected_stream",
    "first_ts_ms", "last_ts_ms", "event_count", "sample_ids",
)


def test_merging_batches_equals_one_by_one(spark):
    rng = random.Random(1)
    maybe = lambda *v: rng.choice([None, *v])
    rows = [
        make(
            i, f"k{rng.randint(0, 25)}", severity=rng.choice(["low", "high"]), summary=maybe("", "s1", "s2"),
            affected_group=maybe("g1", "g2"), affected_stream=maybe("x"), first_ts_ms=rng.randint(0, 9),
            last_ts_ms=maybe(rng.randint(0, 3000)), event_count=maybe(rng.randint(0, 9)), sample_ids=[str(i)],
            vector_context=maybe(([("g", i)], 1, 0.5, ["t"])),
        )
        for i in range(150)
    ]
    snapshot = incidents.empty_snapshot(spark.createDataFrame([], BATCH))
    store = {}
    for part in (rows[:50], rows[50:60], rows[60:]):
        known = set(store)
        merged = incidents.merge(snapshot, spark.createDataFrame(part, BATCH)).collect()
        one_by_one(store, part)
        touched = {r[2] for r in part}
        assert {r.dedupe_key for r in merged} == set(store)
        for r in merged:
            assert tuple(r[c] for c in CHECKED) == tuple(store[r.dedupe_key][c] for c in CHECKED), r.dedupe_key
            context = store[r.dedupe_key]["vector_context"]
            assert (r.vector_context and r.vector_context.aggregates[0]["count"]) == (context and context[0][0][1])
            assert r.created == (r.dedupe_key not in known)
            assert r.touched == (r.dedupe_key in touched)
        names = INCIDENTS.fieldNames()
        snapshot = spark.createDataFrame([tuple(r[c] for c in names) for r in merged], INCIDENTS)


def logs_of(logs, n=60):
    rng = random.Random(3)
    return logs(*[
        (f"{i:03d}", f"g{i % 4}", f"s{i % 2}", 1 + i * 1000, "an error happened" if i % 4 == 0 or rng.random() < 0.1 else "all is fine")
        for i in range(n)
    ])


SET = detection.Settings(interval_ms=20_000, min_severity="low", min_confidence=10)


def test_replay_and_alerts(logs):
    built = detection.replay(logs_of(logs), SET)
    merged = incidents.merge(incidents.empty_snapshot(built), built)
    # all three ticks lie in one hour with the same counts, so they share a key
    hot = merged.where("title like '%g0' and created_ms = 20000").first()
    assert (hot.severity, hot.event_count, hot.first_ts_ms, hot.last_ts_ms) == ("critical", 60, 1, 59001)
    assert hot.sample_ids[0] == "000" and len(hot.sample_ids) == 5
    assert [g["count"] for g in hot.vector_context.aggregates] == [5, 5, 5, 5]
    out = alerts.outbox(merged, ["slack", "sns", "pager"]).where(F.col("incident_id") == hot.id)
    rows = {r.channel: r for r in out.collect()}
    assert set(rows) == {"slack", "sns"}
    assert rows["sns"].subject == "[CRITICAL][50%] 5 suspect events in g0"
    assert rows["slack"].body.startswith("*[CRITICAL][50%] 5 suspect events in g0*\n5 of 5 events matched\nGroups: g0(5), g1(5)")
    assert rows["slack"].body.endswith("\nSamples: 5")
    assert rows["sns"].body.count('"message"') == 2
    again = incidents.merge(merged.select(*INCIDENTS.fieldNames()), built)
    assert alerts.outbox(again, ["slack"]).count() == 0
    routes = alerts.routing_table(logs_of(logs).sparkSession, {"critical": ["sns"]})
    assert {(r.severity, r.channel) for r in alerts.route(alerts.outbox(merged, ["slack", "sns"]), routes).collect()} == {("critical", "sns")}
    with pytest.raises(ValueError):
        alerts.routing_table(logs_of(logs).sparkSession, {"loud": ["sns"]})


def test_tick_with_an_external_scorer(logs):
    def load():
        def judge(prompt):
            assert "Samples (" in prompt
            return '{"incidents": [{"title": "Broken", "severity": "HIGH", "confidence": 0.8, "dedupe_key": "k"}]}'

        return judge

    found, cursor = detection.tick(logs_of(logs), 40_000, 20_000, SET, score.external_scorer(load))
    (row,) = found.collect()
    assert (row.dedupe_key, row.severity, row.title, row.event_count) == ("k", "high", "Broken", 20)
    assert row.affected_group == "g0" and row.vector_context.confidence == 0.8
    assert cursor.first().last_ts_ms == 39_001


def test_a_failing_scorer_fails_the_tick(logs):
    def load():
        def judge(prompt):
            raise RuntimeError("scorer down")

        return judge

    found, _ = detection.tick(logs_of(logs), 40_000, 20_000, SET, score.external_scorer(load))
    with pytest.raises(Exception, match="scorer down"):
        found.collect()


def test_tick_equals_replay(logs):
    df = logs_of(logs)
    columns = ["dedupe_key", "severity", "title", "event_count", "first_ts_ms", "sample_ids"]
    one, _ = detection.tick(df, 40_000, 20_000, SET)
    every = detection.replay(df, SET).where("now_ms = 40000")
    assert sorted(map(tuple, one.select(*columns).collect())) == sorted(map(tuple, every.select(*columns).collect()))


def test_list_evidence_report_cursor(spark, logs):
    df = logs_of(logs)
    built = detection.replay(df, SET)
    merged = incidents.merge(incidents.empty_snapshot(built), built).select(*INCIDENTS.fieldNames())
    listed = incidents.incident_list(merged).collect()
    assert [r.created_ms for r in listed] == sorted((r.created_ms for r in listed), reverse=True)
    assert incidents.incident_list(merged, "resolved").count() == 0
    found = incidents.evidence(merged, df).collect()
    assert len(found) == sum(len(r.sample_ids) for r in listed)
    # the log table is read for the time of the incidents only, if they tell it
    plan = incidents.evidence(merged, df)._jdf.queryExecution().optimizedPlan().toString()
    assert "ts_ms" in plan and "scalar-subquery" in plan
    timeless = merged.withColumn("first_ts_ms", F.lit(None).cast("long"))
    assert incidents.evidence(timeless, df).count() == incidents.evidence(merged.drop("last_ts_ms"), df).count() == len(found)
    rolled = detect.rollup(detect.with_ticks(df, SET.interval_ms), 5_000)
    one = incidents.report(built, rolled).first()
    assert sum(s.n for s in one.timeline) == one.event_count and len(one.streams) == 4
    cursors = spark.createDataFrame([("a", 5, "x"), ("b", 7, None)], "pipeline_id string, last_ts_ms long, last_id string")
    change = spark.createDataFrame([("b", 9, "y"), ("c", 1, None)], cursors.schema)
    after = incidents.upsert_cursors(cursors, change)
    assert sorted(map(tuple, after.collect())) == [("a", 5, "x"), ("b", 9, "y"), ("c", 1, None)]
    assert incidents.read_cursor(after, "b") == 9 and incidents.read_cursor(after, "none") == 0
