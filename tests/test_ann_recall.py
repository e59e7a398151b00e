"""Recall of the sign index against brute force, over all ids of the sf0.1 embeddings that 20 divides."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import ann

SF = "/root/testdata/sf0.1"
BITS, PROBES = 8, 192
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")


def test_mean_recall(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("id"), F.lit("g").alias("log_group"), F.lit("s").alias("log_stream"),
        F.col("vec_id").alias("ts_ms"), F.lit("m").alias("message"), "embedding",
    )
    index = ann.SignIndex(spark, str(tmp_path / "signs"), bits=BITS).append(rows, 0)
    stored = spark.read.parquet(index.path).select(F.col("id").cast("long"), "code", "embedding").collect()
    ids, code = np.array([r[0] for r in stored]), np.array([r[1] for r in stored])
    unit = np.array([r[2] for r in stored], dtype=np.float64)
    raw, unit = unit, unit / np.linalg.norm(unit, axis=1, keepdims=True)
    recall, read = [], []
    for i in np.flatnonzero(ids % 20 == 0):
        score = unit @ unit[i]
        probed = np.isin(code, index.codes(raw[i].tolist(), PROBES))
        best, found = np.argsort(-score)[:10], np.argsort(-np.where(probed, score, -2))[:10]
        recall.append(len(set(best) & set(found)) / 10)
        read.append(probed.mean())
        if ids[i] in (0, 1000):
            got = index.search(raw[i].tolist(), k=10, probes=PROBES).collect()
            assert {int(r.id) for r in got} == set(ids[found].tolist())
    assert len(recall) == 100 and np.mean(recall) >= 0.9
    assert np.mean(read) < 0.8
