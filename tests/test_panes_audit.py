"""Overlapping windows from panes, and what became of every row of a stream."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.functions.text import SUSPECT_KEYWORDS
from vigil.operators import panes
from vigil.streaming import audit

LOG = "id string, log_group string, log_stream string, ts_ms long, message string"


def rows(seed, n, hot=0):
    rng = random.Random(seed)
    out = [(str(i), rng.choice(["a", "b", None]), "s", rng.randrange(-50, 400), rng.choice(["ok fine", "an error"])) for i in range(n)]
    return out + [(f"h{i}", "hot", "s", 100, "panic") for i in range(hot)] + [("x", "a", "s", None, "error")]


def brute(data, width, slide):
    out = {}
    for _, group, _, ts, message in data:
        if ts is None:
            continue
        bad = any(k in message for k in SUSPECT_KEYWORDS)
        end = -(-ts // slide) * slide
        while end - width < ts:
            n, s, lo, hi = out.get((end, group), (0, 0, ts, ts))
            out[end, group] = (n + 1, s + bad, min(lo, ts), max(hi, ts))
            end += slide
    return out


def got(df):
    return {(r.window_ms, r.log_group): (r.n, r.n_suspects, r.first_ts_ms, r.last_ts_ms) for r in df.collect()}


@pytest.mark.parametrize("width, slide", [(10, 5), (60, 10), (7, 7)])
def test_windows_agree_with_brute_force(spark, width, slide):
    data = [r for r in rows(1, 200, hot=300) if r[3] is None or r[3] >= 0]
    df = spark.createDataFrame(data, LOG).repartition(4)
    paned = panes.panes(df, slide)
    assert got(panes.windows(paned, width, slide)) == brute(data, width, slide)
    # panes of parts of the rows add up
    parts = panes.panes(df.where("length(id) > 2"), slide).unionByName(panes.panes(df.where("length(id) <= 2"), slide))
    assert got(panes.windows(parts, width, slide)) == brute(data, width, slide)
    assert panes.windows(panes.panes(df.limit(0), slide), width, slide).count() == 0
    with pytest.raises(ValueError):
        panes.windows(paned, 10, 3)


def landing(spark, path, data, parts):
    for k in range(parts):
        spark.createDataFrame(data[k::parts], LOG).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_stream_gives_the_same_windows(spark, tmp_path):
    data = [r for r in rows(2, 150) if r[3] is None or r[3] >= 0]
    logs = landing(spark, str(tmp_path / "in"), data, 3)
    for _ in range(2):  # a restart finds nothing new
        panes.panes_to_table(logs, str(tmp_path / "out"), str(tmp_path / "chk"), 5, every=None).awaitTermination()
    assert got(panes.read_windows(spark, str(tmp_path / "out"), 10, 5)) == brute(data, 10, 5)
    some = {k: v for k, v in brute(data, 10, 5).items() if 50 <= k[0] <= 100}
    assert got(panes.read_windows(spark, str(tmp_path / "out"), 10, 5, 50, 100)) == some


def test_every_row_has_a_fate(spark, tmp_path):
    data = rows(3, 100) + [("b1", "a", "s", 10, "  "), ("b2", "a", "s", 10, None), ("late", "a", "s", -1000, "fine")]
    table, chk = str(tmp_path / "table"), str(tmp_path / "chk")
    logs = landing(spark, str(tmp_path / "in"), data, 4)
    for _ in range(2):
        audit.audited_stream(logs, table, chk, 100, every=None).awaitTermination()
    watermark, want = None, []
    for k in range(4):
        part = data[k::4]
        bad = [r for r in part if r[3] is None or not (r[4] or "").strip()]
        good = [r for r in part if r not in bad]
        late = [r for r in good if watermark is not None and r[3] < watermark]
        want.append((k, len(part), len(good) - len(late), len(late), len(bad)))
        newest = max(r[3] for r in good) - 100
        watermark = newest if watermark is None else max(watermark, newest)
    metrics = audit.read_metrics(spark, table).orderBy("batch").collect()
    assert [(r.batch, r.n_input, r.n_stored, r.n_late, r.n_rejected) for r in metrics] == want
    assert all(r.n_stored + r.n_late + r.n_rejected == r.n_input for r in metrics) and sum(r.n_late for r in metrics) > 0
    stored = {f: audit.read_fate(spark, table, f).count() for f in (audit.STORED, audit.LATE, audit.REJECTED)}
    assert stored == {"stored": sum(w[2] for w in want), "late": sum(w[3] for w in want), "rejected": 3}
    assert {r.reason for r in audit.read_fate(spark, table, "rejected").collect()} == {"no time", "blank message"}


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    table = str(tmp_path / "t")
    df = spark.createDataFrame(rows(4, 30), LOG)
    audit.write_batch(df, table, 0, 50)
    audit.write_batch(df, table, 1, 50)
    before = sorted(map(tuple, audit.read_metrics(spark, table).collect()))
    audit.write_batch(df, table, 1, 50)
    assert sorted(map(tuple, audit.read_metrics(spark, table).collect())) == before
    assert spark.read.parquet(f"{table}/rows").count() == 2 * df.count()
    audit.write_batch(df.limit(0), table, 2, 50)
    last = audit.read_metrics(spark, table).where(F.col("batch") == 2).first()
    assert last.n_input == 0 and last.max_ts_ms == before[0][4]
