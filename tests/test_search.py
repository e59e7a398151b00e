import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions import vectors as vx
from vigil.operators import ann, embed, search
from vigil.sources import tables

RNG = np.random.default_rng(3)
N, DIM = 300, 16
VECTORS = RNG.normal(size=(N, DIM)).astype(np.float32)
VECTORS[7] = VECTORS[5]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [
            (f"{i:03d}", f"g{i % 3}", "s", i * 1000, "m" * (20 + i % 30), VECTORS[i].tolist())
            for i in range(N)
        ],
        "id string, log_group string, log_stream string, ts_ms long, message string, embedding array<float>",
    ).repartition(7)


def brute(q, keep=lambda i: True):
    m = VECTORS.astype(np.float64)
    d = 1 - m @ q / (np.linalg.norm(m, axis=1) * np.linalg.norm(q))
    return sorted((round(d[i], 9), f"{i:03d}") for i in range(N) if keep(i))


def test_distance_of_simple_vectors(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([1.0, 0.0, 0.0], [1.0, 0.0, 0.0]),
         ([1.0, 0.0, 0.0], [-1.0, 0.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0])],
        "a array<float>, b array<float>",
    )
    assert [r[0] for r in df.select(vx.cosine_distance("a", "b")).collect()] == [1.0, 0.0, 2.0, None]
    vx.register_sql_functions(spark)
    df.createOrReplaceTempView("pairs")
    got = spark.sql("SELECT vec_cosine_distance(a, b) FROM pairs").collect()
    assert [r[0] for r in got] == [1.0, 0.0, 2.0, None]


def test_semantic_search_equals_brute_force(rows):
    q = VECTORS[5].astype(np.float64)
    got = search.semantic_search(rows, q.tolist(), k=12, min_len=0).collect()
    assert [(round(r.distance, 9), r.id) for r in got] == brute(q)[:12]
    assert [r.id for r in got[:2]] == ["005", "007"]
    assert all(abs(r.score - (1 - r.distance)) < 1e-12 for r in got)


def test_filters_and_stored_norm(rows):
    q = VECTORS[9].astype(np.float64)
    keep = lambda i: i % 3 == 1 and 20 + i % 30 >= 32 and i * 1000 >= 100_000
    table = rows.withColumn("norm", vx.norm("embedding"))
    got = search.semantic_search(
        table, q.tolist(), k=5, min_len=32, group="g1", since="5 m", as_of_ms=400_000
    ).collect()
    assert [r.id for r in got] == [i for _, i in brute(q, keep)[:5]]


def test_query_may_be_a_frame_and_top_k_is_not_a_sort(rows, capsys):
    query = rows.where("id = '005'").select("embedding")
    found = search.semantic_search(rows, query, k=3, min_len=0)
    assert [r.id for r in found.collect()] == [i for _, i in brute(VECTORS[5].astype(float))[:3]]
    found.explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


def test_rows_without_usable_vector_come_last(spark, rows):
    odd = rows.limit(1).withColumns({"id": F.lit("zzz"), "embedding": F.array().cast("array<float>")})
    got = search.semantic_search(rows.unionByName(odd), VECTORS[0].tolist(), k=N, min_len=0).collect()
    assert "zzz" not in {r.id for r in got}


@pytest.mark.parametrize("slice_size", [2048, 4])
def test_multi_search_equals_single_searches(spark, rows, slice_size):
    queries = rows.where("id < '011'").select(F.col("id").alias("qid"), F.col("embedding").alias("query"))
    got = search.multi_search(rows, queries, k=4, slice_size=slice_size).collect()
    assert len(got) == 44
    for q in range(11):
        mine = sorted((r.rank, r.id) for r in got if r.qid == f"{q:03d}")
        assert [i for _, i in mine] == [i for _, i in brute(VECTORS[q].astype(float))[:4]]


def test_multi_search_in_small_blocks(rows, monkeypatch):
    queries = rows.where("id < '011'").select(F.col("id").alias("qid"), F.col("embedding").alias("query"))
    whole = search.multi_search(rows, queries, k=6).collect()
    monkeypatch.setattr(search, "MAX_CELLS_PER_PRODUCT", 30)
    assert sorted(search.multi_search(rows, queries, k=6).collect()) == sorted(whole)
    assert [r.id for r in sorted(whole, key=lambda r: r.rank) if r.qid == "005"][:2] == ["005", "007"]


def test_multi_search_skips_unusable_rows(rows):
    bad = rows.limit(3).withColumns(
        {"id": F.concat(F.lit("x"), "id"), "embedding": F.array(F.lit(0.0)).cast("array<float>")}
    )
    zero = rows.limit(2).withColumns(
        {"id": F.concat(F.lit("z"), "id"), "embedding": F.array_repeat(F.lit(0.0), DIM).cast("array<float>")}
    )
    queries = rows.where("id = '003'").select(F.col("id").alias("qid"), F.col("embedding").alias("query"))
    got = search.multi_search(rows.unionByName(bad).unionByName(zero), queries, k=N + 5).collect()
    assert len(got) == N


def test_multi_search_of_nothing(rows):
    none = rows.where("id = 'x'").select(F.col("id").alias("qid"), F.col("embedding").alias("query"))
    assert search.multi_search(rows, none, k=4).count() == 0


def test_hash_embedder_equals_hand_count(spark):
    slot = lambda word: int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 32
    text = "Timeout contacting DB\ttimeout  again"
    counts = np.zeros(32)
    for word in text.lower().split():
        counts[slot(word)] += 1
    df = spark.createDataFrame([(text,), ("  ",), (None,)], "message string")
    got = [r.embedding for r in embed.embed(df, embed.hash_embedder(32)).collect()]
    assert np.allclose(got[0], counts / np.linalg.norm(counts), atol=1e-6)
    assert not any(got[1]) and not any(got[2])


def test_search_by_text_finds_the_text(spark, logs):
    texts = ["timeout contacting database server", "user logged in from home", "cache miss on key a"]
    df = embed.embed(logs(*[(str(i), "g", "s", i, t) for i, t in enumerate(texts)]), embed.hash_embedder(64))
    query = spark.createDataFrame([("database timeout",)], "q string")
    best = search.search_by_text(df, query, embed.hash_embedder(64), k=1, min_len=0).first()
    assert best.id == "0"


def test_sign_index_reads_a_part_and_grows(spark, rows, tmp_path):
    index = ann.SignIndex(spark, str(tmp_path / "signs"), bits=3)
    index.append(rows.where("id < '100'"), 0).append(rows.where("id >= '100'"), 1).append(rows.where("id >= '100'"), 1)
    stored = spark.read.parquet(str(tmp_path / "signs"))
    assert stored.count() == rows.where(F.size("embedding") > 0).count()
    hits = 0
    for q in (1, 50, 120):
        query = VECTORS[q].astype(float).tolist()
        found = index.search(query, k=10, probes=4)
        assert len(found.inputFiles()) > 0 and found.first().id == f"{q:03d}"
        parts = stored.where(F.col("code").isin(index.codes(query, 4)))
        assert parts.count() < stored.count() and len(index.codes(query, 4)) == 4
        wanted = [i for _, i in brute(VECTORS[q].astype(float))[:10]]
        hits += len(set(wanted) & {r.id for r in found.collect()})
        assert [r.id for r in index.search(query, k=10, probes=8).collect()] == wanted
        assert all(r.id < "050" for r in index.search(query, k=5, probes=8, condition=F.col("id") < "050").collect())
    assert hits >= 12


def test_cells_give_the_exact_answer(spark, rows, tmp_path):
    odd = rows.limit(2).withColumns({"id": F.lit("zzz"), "embedding": F.array().cast("array<float>")})
    index = ann.CellIndex.build(rows.unionByName(odd), str(tmp_path / "ix"), cells=12)
    assert sum(c.rows for c in index.cells) == N
    for q in (5, 40, 200):
        query = VECTORS[q].astype(float)
        got = index.search(query.tolist(), k=10, probes=1).collect()
        assert [r.id for r in got] == [i for _, i in brute(query)[:10]]
    few = index.search(query.tolist(), k=10, probes=1, condition=F.col("id") < "004").collect()
    assert [r.id for r in few] == [i for _, i in brute(query, lambda i: i < 4)]


def test_cells_skip_folders(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    vectors = [(np.eye(4)[i % 4] + rng.normal(scale=0.01, size=4)).tolist() for i in range(200)]
    df = spark.createDataFrame(
        [(f"{i:03d}", "g", "s", i, "m", v) for i, v in enumerate(vectors)],
        "id string, log_group string, log_stream string, ts_ms long, message string, embedding array<float>",
    )
    index = ann.CellIndex.build(df, str(tmp_path / "ix"), cells=4)
    found = index.search([1.0, 0.0, 0.0, 0.0], k=5, probes=1)
    assert all(int(r.id) % 4 == 0 for r in found.collect())
    found.explain()
    plan = capsys.readouterr().out
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "cell" in pruned and "," not in pruned.split("isnotnull")[0]


def test_mean_pool(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],), ([[1.0, 2.0]],), ([],)], "t array<array<float>>")
    assert [r[0] for r in df.select(vx.mean_pool("t")).collect()] == [[2.0, 4.0], [1.0, 2.0], []]
    assert [r[0] for r in df.select(vx.mean_pool("t", "first")).collect()] == [[1.0, 2.0], [1.0, 2.0], []]


def test_vector_checks(spark, rows):
    tables.check_vector_column(rows)
    with pytest.raises(ValueError):
        tables.check_vector_column(rows, "message")
    assert [(r.dim, r.n, r.ok) for r in tables.dims(rows, dim=DIM).collect()] == [(DIM, N, True)]
    df = spark.createDataFrame([("[1, 2.5]",), ("nope",)], "j string")
    assert [r[0] for r in df.select(vx.vector_from_json("j")).collect()] == [[1.0, 2.5], None]


def test_newest_rows_walk_the_days(spark, tmp_path):
    from vigil.operators import browse

    rows = [(str(i), "g", "s", i * 86_400_000 // 3, "error" if i % 4 == 0 else "fine") for i in range(60)] + [("none", "g", "s", None, "error")]
    df = spark.createDataFrame(rows, "id string, log_group string, log_stream string, ts_ms long, message string")
    df.withColumn("day", tables.day_of("ts_ms")).write.partitionBy("day").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for n in (1, 7, 100):
        assert [r.id for r in browse.browse(stored, n).collect()] == [r.id for r in browse.browse(df, n).collect()]
        assert [r.id for r in browse.recent_errors(stored, n).collect()] == [r.id for r in browse.recent_errors(df, n).collect()]
    plan = browse.browse(stored, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "1970-01-20" in plan


def test_a_failing_text_is_rejected_alone(spark):
    def load():
        def encode(texts):
            if any(t == "bad" for t in texts):
                raise ValueError
            return [[float(len(t))] for t in texts]

        return encode

    df = spark.createDataFrame([("bad" if i == 7 else "x" * (i + 1),) for i in range(30)], "t string")
    got = [r.v for r in embed.model_embedder(load, cap=10, batch_size=4)(df, "t", "v").collect()]
    assert sorted(map(len, got)) == [0] + [1] * 29 and max(v[0] for v in got if v) == 10
