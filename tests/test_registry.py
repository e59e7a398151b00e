"""Every registered query against its SQL, on the smallest sample tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from vigil.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = queries.QUERIES, oracles.ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_contract_holds_all():
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
    # approximate by their nature: tests/test_pq.py and tests/test_sketches.py hold them against exact results
    assert set(QUERIES) - set(ORACLES) == {"pq_search", "pq_recall", "sketch_summary"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    columns = sorted(df.columns)
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    wanted = [tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert sorted(tuple(str(r[c]) for c in columns) for r in rows) == sorted(wanted)


def test_entry(spark):
    assert contract.entry(spark).columns == [
        "id", "log_group", "log_stream", "ts_ms", "message", "distance", "score",
    ]
