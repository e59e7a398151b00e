"""Learned templates: texts are not written and shuffled once at most; leaves of any size have the same templates."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_templates import NAMES, slow
from vigil.operators import templates as tp

LOG = "id string, log_group string, log_stream string, ts_ms long, message string"


def kept(spark):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(base) for f in files if f.endswith(".parquet"))


def prose(seed, n, least=40, most=60):
    rng = random.Random(seed)
    common = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(4)]
    rare = lambda: "".join(rng.choices("ijklmnopqrstuvwxyz0123456789", k=12))
    return [" ".join(rng.choice(common) if rng.random() < 0.4 else rare() for _ in range(rng.randint(least, most))) for _ in range(n)]


def result(df):
    return sorted((r.template, r.n_variables, r.n, r.first_ts_ms, r.last_ts_ms, r.n_groups, str(r.main_group)) for r in tp.learned_templates(df).collect())


def test_texts_are_shuffled_once_and_not_written(spark):
    texts = prose(1, 3000)
    logs = spark.createDataFrame([(str(i), "g", "s", i, t) for i, t in enumerate(texts)], LOG)
    before = kept(spark)
    found = tp.learned_templates(logs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) == 1
    assert {r.template: r.n for r in found.collect()} == slow(texts)
    assert kept(spark) - before < sum(map(len, texts)) / 4


@pytest.mark.parametrize("marks, broadcast", [(1 << 16, 1 << 20), (4, 0)])
def test_large_leaves_have_the_templates_of_small_ones(spark, monkeypatch, marks, broadcast):
    texts = prose(2, 300, 5, 7) + [f"a b {n} d {i % 3} f" for i in range(12) for n in NAMES] + ["over and out"] * 70 + ["gone", None, "", "x y", "lone " + "word " * 300]
    groups = ["g", "h", None]
    logs = spark.createDataFrame([(str(i), groups[i % 3], "s", None if i % 7 == 0 else i, t) for i, t in enumerate(texts)], LOG).repartition(5)
    whole = result(logs)
    assert Counter({x[0]: x[2] for x in whole}) == slow(texts)
    for name, value in (("TASK_WORDS", 60), ("TASK_ROWS", 50), ("PART_ROWS", 8), ("PART_POSITIONS", 2), ("MARKS", marks), ("BROADCAST_ROWS", broadcast)):
        monkeypatch.setattr(tp, name, value)
    dealt, real = [], tp.frequent
    monkeypatch.setattr(tp, "frequent", lambda rows, large: dealt.extend(large.collect()) or real(rows, large))
    assert result(logs) == whole
    assert max(r.parts for r in dealt) > 1 and all(r.total > 1 for r in dealt)


def test_leaves_of_a_task_in_pieces(spark, monkeypatch):
    """Batches that end within leaves, and leaves that are judged a few at a time."""
    texts = prose(3, 400, 3, 9) + ["the same words here"] * 40
    logs = spark.createDataFrame([(str(i), f"g{i % 3}", "s", i, t) for i, t in enumerate(texts)], LOG)
    whole, pieces = result(logs), []
    dealt = logs.select(F.lit(1).cast("long").alias("n"), F.col("ts_ms").alias("first_ts_ms"), F.col("ts_ms").alias("last_ts_ms"), "log_group", tp.words("message").alias("words"))
    shaped = tp.assign(dealt, tp.branches(tp.prefixes(tp.shapes(logs))))
    rows = shaped.select("length", F.array_join("path", " ").alias("head"), F.concat_ws(" ", "path", F.expr("slice(words, 3, length)")).alias("text"), "log_group", "n", "first_ts_ms", "last_ts_ms")
    table = rows.orderBy("length", "head").toArrow()
    monkeypatch.setattr(tp, "JUDGED", 20)
    for batch in tp.judged(iter(table.to_batches(max_chunksize=7))):
        pieces += [(r["template"], r["n_variables"], r["n"], r["first_ts_ms"], r["last_ts_ms"], r["n_groups"], str(r["main_group"])) for r in batch.to_pylist()]
    assert sorted(pieces) == whole
    assert list(tp.judged(iter(table.slice(0, 0).to_batches()))) == []
