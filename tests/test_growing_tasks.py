"""What one task holds doesn't grow with the table: state, landing files, counts of words."""

import glob
import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa

from vigil.llm import components
from vigil.operators import embed, lexical, pq, templates
from vigil.plans import queries
from vigil.streaming import streams

LOG = "id string, log_group string, log_stream string, ts_ms long, message string"


def test_every_state_partition_of_the_rate_is_a_task(spark, tmp_path):
    spark.createDataFrame([(str(i), "g", "s", i * 60_000, "x") for i in range(100)], LOG).coalesce(1).write.parquet(str(tmp_path / "in"))
    logs = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
    query = streams.rate_to_table(logs, str(tmp_path / "out"), str(tmp_path / "chk"), every=None)
    query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
    tasks = [x.numTasks for x in map(tracker.getStageInfo, stages) if x]
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) in tasks
    assert sum(r.n for r in streams.read_rate(spark, str(tmp_path / "out")).collect()) == 100


def test_the_audited_rows_land_in_more_than_one_file_a_batch(spark, tmp_path):
    events = spark.range(400).selectExpr(
        "id AS event_id", "id % 7 AS user_id", "'click' AS event_type", "CAST(TIMESTAMP_MILLIS(1704067200000 + id * 60000) AS TIMESTAMP_NTZ) AS ts",
        "1.5D AS value", "'{}' AS props",
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    docs = spark.range(100).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "4L AS n_chars", "if(id % 10 = 0, ' ', 'text') AS text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = set(glob.glob("/".join([spark.conf.get("spark.checkpoint.dir").removeprefix("file:"), "audit-*"])))
    rows = sorted(queries.stream_audit(spark, str(tmp_path)).collect())
    assert [r.batch for r in rows] == [0, 1, 2, 3]
    assert sum(r.n_input for r in rows) == 500 and sum(r.n_rejected for r in rows) == 10
    assert all(r.n_stored + r.n_late + r.n_rejected == r.n_input for r in rows)
    base = (set(glob.glob("/".join([spark.conf.get("spark.checkpoint.dir").removeprefix("file:"), "audit-*"]))) - before).pop()
    assert len(glob.glob(f"{base}/landing/*.parquet")) > queries.LANDINGS


def test_terms_are_counted_where_a_text_is_read(monkeypatch):
    monkeypatch.setattr(lexical, "COUNTED", 3)
    batch = pa.record_batch([pa.array(["1", "2", "3", None]), pa.array([["b", "a", "b", "b"], [], ["a"], ["c", "a"]])], ["id", "terms"])
    got = sorted((r["term"], str(r["id"]), r["length"], r["tf"]) for b in lexical.counted([batch.slice(1), batch.slice(0, 1)]) for r in b.to_pylist())
    assert got == [("a", "1", 4, 1), ("a", "3", 1, 1), ("a", "None", 2, 1), ("b", "1", 4, 3), ("c", "None", 2, 1)]


def test_the_words_of_leaves_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(templates, "TASK_WORDS", 50)
    logs = spark.createDataFrame([(str(i), "g", "s", i, f"a b {i} d {i % 2} f") for i in range(100)], LOG).coalesce(1)
    seen, real = [], type(logs).repartition
    monkeypatch.setattr(type(logs), "repartition", lambda self, n, *c: seen.append(n) or real(self, n, *c))
    got = templates.learned_templates(logs).collect()
    assert sorted((r.template, r.n) for r in got) == [("a b <*> d 0 f", 50), ("a b <*> d 1 f", 50)]
    assert seen == [8]


def test_closest_words_need_no_matrix_of_all_rows(monkeypatch):
    rng = np.random.default_rng(1)
    rows, words = rng.normal(size=(1000, 2)), rng.normal(size=(256, 2))
    whole = pq._closest(rows, words)
    monkeypatch.setattr(pq, "SLICE", 64)
    assert (pq._closest(rows, words) == whole).all()
    tracemalloc.start()
    pq._closest(rows, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1000 * 256 * 8 / 2


def test_hash_vectors_in_pieces(spark, monkeypatch):
    rows = spark.createDataFrame([("1", "a b a"), ("2", None), ("3", " "), ("4", "É b\tb")], "id string, message string")
    plan = embed.embed(rows, embed.hash_embedder(8))._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan  # once a word and batch, not once a word and row
    got = {r.id: list(r.embedding) for r in embed.embed(rows, embed.hash_embedder(8)).collect()}
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8
    for id_, words in (("1", "a b a"), ("2", ""), ("3", ""), ("4", "é b b")):
        counts = np.bincount([slot(w) for w in words.split()], minlength=8).astype(float)
        assert got[id_] == (counts / (np.linalg.norm(counts) or 1)).astype(np.float32).tolist()


def test_few_links_take_no_rounds(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long").repartition(8)
    monkeypatch.setattr(components, "_stars", lambda edges: 1 / 0)
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
