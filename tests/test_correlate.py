"""The interval join of sessions against all pairs."""

import random

import pytest

from vigil.operators import correlate as co


def slow(rows, margin):
    rows = [(k, lo, max(lo, hi)) for k, lo, hi in rows if None not in (k, lo, hi)]
    out = []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if a[0] != b[0] and (a[1], a[0], a[2]) < (b[1], b[0], b[2]) and b[1] <= a[2] + margin:
                out.append((a, b))
    return sorted(out)


def met(spark, rows, margin, **options):
    df = spark.createDataFrame(rows, "key string, lo long, hi long")
    found = co.meetings(df, margin, **options).collect()
    return sorted((tuple(r.early), tuple(r.late)) for r in found)


def some(seed, n, span, longest):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lo = rng.randrange(span)
        out.append((rng.choice("abcdef"), lo, lo + int(longest ** rng.random())))
    return out


@pytest.mark.parametrize("seed, margin, longest", [(1, 0, 100_000), (2, 600_000, 5_000_000), (3, 1, 10)])
def test_agrees_with_all_pairs(spark, seed, margin, longest):
    rows = some(seed, 150, 20_000_000, longest)
    assert met(spark, rows, margin) == slow(rows, margin)


def test_a_hot_bucket_is_split(spark):
    rows = some(4, 120, 50_000, 30_000)
    assert met(spark, rows, 1000, split=7) == slow(rows, 1000) and len(slow(rows, 1000)) > 500


def test_awkward_sessions(spark):
    rows = [("a", 0, 10), ("b", 10, 20), ("b", 11, 12), ("a", 0, 10), (None, 0, 50), ("c", None, 5), ("c", 5, None), ("d", 9, 3),
            ("e", -5_000_000, -4_999_999), ("f", -5_000_000, 2**41), ("g", 2**40, 2**40), ("h", 10, 10)]
    for margin in (0, 1):
        assert met(spark, rows, margin) == slow(rows, margin)
    assert met(spark, [], 0) == []


def test_pairs_of_groups(spark):
    rows = [("b", 0, 100), ("a", 50, 150), ("a", 5000, 5010), ("b", 5020, 5030), ("c", 9_000_000, 9_000_001)]
    got = co.correlation(spark.createDataFrame(rows, "key string, lo long, hi long"), 10).collect()
    assert [tuple(r) for r in got] == [("a", "b", 2, 1, 50, 5020, 50)]


def test_no_cross_join(spark):
    df = spark.createDataFrame(some(5, 20, 1000, 100), "key string, lo long, hi long")
    plan = co.correlation(df, 0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
