"""BM25 postings and rank fusion against plain Python."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from vigil.operators import lexical

TEXTS = ["the red fox", "the THE red-hot stove; 42 degrees", None, "", "über naïve 漢字 fox", "fox fox fox", "blue sea", "the red fox", "word " * 3000]


def slow(texts, query):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    docs = [cut(t) for t in texts]
    mean = max(sum(map(len, docs)), 1) / len(docs)
    out = {}
    for term in set(cut(query)):
        df = sum(term in d for d in docs)
        for i, d in enumerate(docs):
            tf = Counter(d)[term]
            if tf:
                weight = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
                out[str(i)] = out.get(str(i), 0) + weight
    return sorted(((round(s, 9), i) for i, s in out.items()), key=lambda x: (-x[0], x[1]))


def frame(spark, texts, first=0):
    return spark.createDataFrame([(str(i + first), t) for i, t in enumerate(texts)], "id string, message string")


def test_agrees_with_plain_bm25(spark, tmp_path):
    index = lexical.Postings(spark, str(tmp_path / "ix")).append(frame(spark, TEXTS).withColumn("tf", F.lit("clash")), 0)
    for query in ("the fox", "FOX, fox!", "naïve 漢字", "42 word", "nothing here", "", " - "):
        assert [(r.score, r.id) for r in index.search(query, k=50).collect()] == slow(TEXTS, query)
    assert [r.id for r in index.search("red fox", k=2).collect()] == ["0", "7"]  # equal scores by id


def test_batches_add_up_and_replace_themselves(spark, tmp_path):
    index = lexical.Postings(spark, str(tmp_path / "ix"))
    for _ in range(2):
        index.append(frame(spark, TEXTS[:4]), 0).append(frame(spark, TEXTS[4:], 4), 1)
    assert [(r.score, r.id) for r in index.search("the red fox", k=50).collect()] == slow(TEXTS, "the red fox")
    plan = index.scores("fox")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "In(term" in plan or "EqualTo(term" in plan


def test_an_empty_index(spark, tmp_path):
    index = lexical.Postings(spark, str(tmp_path / "ix")).append(frame(spark, [None, ""]), 0)
    assert index.search("fox").collect() == []


def test_fusion(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, rank int")
    two = spark.createDataFrame([("c", 1), ("d", 2)], "id string, rank int")
    got = lexical.fuse(one, two, k=3).collect()
    assert [r.id for r in got] == ["c", "a", "b"]
    assert abs(got[0].score - (1 / 63 + 1 / 61)) < 1e-12 and (got[0].rank_0, got[0].rank_1) == (3, 1) and got[1].rank_1 is None
