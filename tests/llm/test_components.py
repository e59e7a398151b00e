"""Connected components against union-find, for chains, stars, hot nodes and scattered links."""

import random

import pytest

from vigil.llm import components as co


def slow(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for a, b in links for x in (a, b) if a != b}


CASES = {
    "chain": [(i, i + 1) for i in range(300)],
    "shuffled chain": [((i * 7919) % 1009, ((i + 1) * 7919) % 1009) for i in range(1000)],
    "star": [(0, i) for i in range(1, 400)] + [(-5, 399)],
    "random": [(random.Random(1).randrange(10**6), 0)] + [(random.Random(i).randrange(400), random.Random(-i - 1).randrange(400)) for i in range(300)],
    "hubs": [(h, 1000 * h + i) for h in range(1, 5) for i in range(60)] + [(1003, 2003), (3003, 4003), (-(2**62), 4010)],
    "loops and repeats": [(1, 1), (2, 3), (3, 2), (2, 3)],
}


@pytest.mark.parametrize("held", [1 << 21, 8])
@pytest.mark.parametrize("name", CASES)
def test_agrees_with_union_find(spark, monkeypatch, name, held):
    monkeypatch.setattr(co, "HELD", held)
    links = CASES[name]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = [tuple(r) for r in co.components(df).collect()]
    assert len(got) == len(dict(got)) and dict(got) == slow(links)


def test_empty(spark):
    assert co.components(spark.createDataFrame([], "a long, b long")).collect() == []
