import math
import random

import pytest
from pyspark.sql import functions as F

from vigil.llm import exact_topk as et


def brute(rows, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("tile", [7, 2048])
def test_against_brute_force(spark, monkeypatch, tile):
    for name in ("TILE_ROWS", "TILE_QUERIES"):
        monkeypatch.setattr(et, name, tile)
    monkeypatch.setattr(et, "ROWS", 60)
    monkeypatch.setattr(et, "QUERIES", 3)
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(200)]
    rows += [(300 + i, rows[3][1]) for i in range(60)] + [(220, []), (240, [1.0, 2.0])]
    rows += [(401, None), (402, [float("nan")] * 8), (403, [None] + [0.0] * 7), (404, [float("inf")] + [0.0] * 7), (None, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(tuple(r) for r in et.top_k(df, F.col("vec_id") % 20 == 0, 5).collect())
    assert got == brute(rows, 5)


@pytest.mark.parametrize("size", [25_000.0, 2.0**22])
def test_large_components(spark, size):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-8, 8)) / 8 * size for _ in range(64)]) for i in range(120)] + [(200, [size] * 64), (220, [size] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in et.top_k(df, F.col("vec_id") % 20 == 0, 7).collect()) == brute(rows, 7)


def test_a_vector_repeated_often_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(et, "ROWS", 10)
    rows = [(1, [1.0, 2.0])] * 100 + [(20, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert sorted(tuple(r) for r in et.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()) == brute(rows, 5)


def test_few_rows_and_repeats(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [0.5]), (1, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in et.top_k(df, F.col("vec_id") % 20 == 0, 5).collect())
    assert got == [(0, 1, 1, 2048), (0, 2, 1, 2048)]
    assert et.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 5).count() == 0
    assert et.top_k(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0, 5).count() == 0
