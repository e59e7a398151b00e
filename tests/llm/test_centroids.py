"""Integer k-means against plain Python integers."""

import hashlib
import math
import random

import pytest

from vigil.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, clusters, rounds, dimensions, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centre = [v for _, v in sorted((r for r in kept if r[0] is not None), key=key)[:clusters]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))

    def assign():
        return [min((apart(v, c), k) for k, c in enumerate(centre)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for k in range(len(centre)):
            mine = [v for (_, v), (_, j) in zip(kept, of) if j == k]
            if mine:
                centre[k] = [sum(x) // len(mine) for x in zip(*mine)]
    of = assign() if centre else []
    total = {k: sum(d for d, j in of if j == k) for k in range(len(centre))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    fit = lambda x: x if x < 2**63 else None
    return sorted(((i, k, fit(d), fit(total[k]), fit(sum(total.values())), name[k]) for (i, _), (d, k) in zip(kept, of)), key=str)


def rows(seed, n, dimensions, size=1.0):
    rng = random.Random(seed)
    pick = lambda: float(int(rng.gauss(0, size) * 64)) / 64  # noqa: E731  exact in 32 bits
    return [(i, [pick() for _ in range(dimensions)]) for i in range(n)]


def check(spark, data, by_id, dimensions, clusters=4, rounds=5):
    df = spark.createDataFrame([(i, v, 0) for i, v in data], SCHEMA).repartition(3)
    got = by_id(ce.report(df, clusters=clusters, rounds=rounds, dimensions=dimensions))
    assert got == slow(data, clusters, rounds, dimensions)
    return got


def test_agrees_with_brute_force(spark, by_id):
    check(spark, rows(1, 120, 5), by_id, 5)


def test_awkward_vectors(spark, by_id):
    nan, inf = float("nan"), float("inf")
    data = rows(2, 40, 3) + [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [nan, 0.0, 1.0]),
                             (105, [inf, 0.0, 1.0]), (7, [0.0, 0.0, 0.0]), (7, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    got = check(spark, data, by_id, 3)
    assert len(got) == 43


def test_equal_vectors_leave_centroids_empty(spark, by_id):
    got = check(spark, [(i, [0.5, 0.25]) for i in range(20)], by_id, 2)
    assert {r[1] for r in got} == {0}


def test_fewer_vectors_than_centroids_and_none(spark, by_id):
    check(spark, rows(3, 2, 4), by_id, 4)
    assert ce.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ce.report(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)).collect() == []


def test_clashing_columns(spark, by_id):
    data = rows(4, 30, 3)
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in data], "vec_id long, embedding array<float>, id string, v string, dots string")
    assert by_id(ce.report(df, clusters=4, rounds=5, dimensions=3)) == slow(data, 4, 5, 3)


@pytest.mark.parametrize("size", [float(2**20), float(2**70)])
def test_large_components_are_exact(spark, by_id, size):
    check(spark, [(i, [x * size for x in v]) for i, v in rows(5, 40, 3)], by_id, 3)
    # far from zero, close to each other
    check(spark, [(i, [2.0**23 + int(x * 8) for x in v]) for i, v in rows(6, 40, 3)], by_id, 3)


def test_dots_are_those_of_the_final_centroids(spark):
    data = rows(8, 50, 4)
    table, centre = ce.cluster(spark.createDataFrame([(i, v, 0) for i, v in data], SCHEMA), clusters=3, rounds=4, dimensions=4)
    for r in table.collect():
        assert list(r.dots) == [sum(a * b for a, b in zip(r.v, c)) for c in centre]
