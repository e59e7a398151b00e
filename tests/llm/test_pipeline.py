"""The stages together, the registered queries, and their SQL on the smallest sample tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from vigil.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        result = con.execute(queries.ORACLES[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        columns = sorted(names)
        want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall())
        assert sorted(tuple(str(r[c]) for c in columns) for r in rows) == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns, name


def test_run_against_brute_force(spark):
    from tests.llm.test_line_dedup_alone import brute as lines
    from tests.llm.test_minhash_dedup import brute as groups
    from vigil.llm import decontaminate, language_id, line_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r["doc_id"] for r in language_id.predict(docs, language_id.fit(docs)).where("rejected").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in rejected)
    kept = {i: t for i, t in lines(rows, 2, line_dedup.ALONE_BYTES).items() if t or not dict(rows)[i]}
    of = groups(sorted(kept.items()))
    kept = {i: t for i, t in kept.items() if of[i][1] == i}
    items = [t for _, t in duckdb.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    bare = lambda t: " ".join(t.split())
    planted = {i for i, t in kept.items() if any(bare(x) in bare(t) for x in items)}
    bad = {
        r["doc_id"] for r in decontaminate.matches(
            spark.createDataFrame(sorted(kept.items()), "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")
        ).where("contaminated").collect()
    }
    assert planted <= bad
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {i: t for i, t in kept.items() if i not in bad}
    assert all(r["decodes"] and r["n_chars"] == len(r["text"]) for r in out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def through(spark, docs):
    """The rows after all stages but the last, as (doc_id, text)."""
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    return sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)


def test_awkward_rows(spark):
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]
    words = [w for _, t, *_ in base if t for w in t.split() if w.isalpha()][:4000]
    text = lambda k: " ".join(words[k * 97 : k * 97 + 60])
    near = " ".join([*words[97:156], "changed"])
    extra = [
        (90_001, text(1), "en", "s", 1), (90_002, near, "en", "s", 1), (90_002, text(5), "en", "s", 1), (None, text(7), None, None, None),
        (None, text(9), None, None, None), (90_003, None, "en", "s", 0), (90_004, "", "en", "s", 0), (90_005, "½ ² 12", "en", "s", 5),
        (90_006, text(11), "en", "s", 1), (90_006, text(11), "en", "s", 1),
    ]
    got = through(spark, spark.createDataFrame(base + extra, SCHEMA))
    mine = {(i, t) for i, t in got if (i, t) in {(e[0], e[1]) for e in extra}}
    # the near copy of 90001 goes, the other text with its id stays; so do both rows without an id
    assert mine == {(90_001, text(1)), (90_002, text(5)), (None, text(7)), (None, text(9)), (90_006, text(11))}


def test_empty_table_and_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert through(spark, docs.limit(0)) == []
    from pyspark.sql import functions as F

    names = ("key", "text_key", "spans", "rep", "n", "h", "a", "ids", "score")
    clash = docs.drop("n_chars").withColumns({n: F.lit("x") for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, SF).columns == clash.columns
    assert through(spark, clash) == through(spark, docs)
