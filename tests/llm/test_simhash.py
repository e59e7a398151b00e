"""SimHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigil.llm import simhash_dedup as sh


def slow_fingerprint(text):
    word = (text or "").encode().lower().split()
    if not word:
        return 0
    n = max(len(word) - 2, 1)
    hashed = [xxhash.xxh64_intdigest(b" ".join(word[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > n)


def slow_components(fps):
    """The least member of each value's component under links of at most three bits."""
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(parent)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


def expected(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    group = slow_components(fps)
    least = {}
    for (i, _), f in zip(rows, fps):
        least[group[f]] = min((x for x in (least.get(group[f]), i) if x is not None), default=None)
    return sorted(((i, f"{f:016x}", least[group[f]]) for (i, _), f in zip(rows, fps)), key=str)


def frame(spark, values):
    return spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")


def clustered(seed, centres=6, members=60, loose=80):
    """Fingerprints around centres (many within three bits, chains beyond) and scattered ones."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(loose)}
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(members):
            value = centre
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 6, 9])):
                value ^= 1 << b
            out.add(value)
    return sorted(out)


def linked(spark, links, values):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links.collect():
        a, b = (int(np.int64(x).view(np.uint64)) for x in (a, b))
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def test_documents_agree_with_brute_force(spark, docs, by_id):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert by_id(sh.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")) == expected(rows)


def test_clashing_columns_and_empty_table(spark, docs, clashing, empty, by_id):
    assert by_id(sh.near_duplicates(clashing)) == by_id(sh.near_duplicates(docs))
    assert sh.near_duplicates(empty).collect() == []


def test_only_null_ids(spark):
    rows = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [r.component_id for r in sh.near_duplicates(rows).collect()] == [None, None]


@pytest.mark.parametrize("cell", [4, 8192])
@pytest.mark.parametrize("parts", [sh.BLOCKS, 2])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, cell, parts):
    values = clustered(parts)
    fps = frame(spark, values).repartition(5)
    chosen = sh.plan(fps, len(values))
    by = sh.Plan(chosen.order, chosen.near, chosen.n, parts)
    monkeypatch.setattr(sh, "plan", lambda *_: by)
    found = sh.links(fps, cell)
    assert linked(spark, found, values) == slow_components(values)


def test_a_dense_bucket_returns_a_forest(spark):
    # all numbers of ten bits: each has 175 others within three bits
    values = list(range(1024))
    fp = np.array(values, np.uint64)
    a, b = sh.compare(fp, np.full(1024, sh.INDEX | sh.ASKS))
    assert len(a) == 1023 and set(b.tolist()) == {0}
    assert linked(spark, sh.links(frame(spark, values)), values) == {v: 0 for v in values}


@pytest.mark.parametrize("parts", [sh.BLOCKS, 2])
def test_every_near_value_is_probed(spark, parts):
    rng = random.Random(11)
    values = clustered(3, centres=2, members=700)
    chosen = sh.plan(frame(spark, values), len(values))
    by = sh.Plan(chosen.order, chosen.near, chosen.n, parts)
    assert sorted(by.order.tolist()) == list(range(64))
    array = np.array(values, np.uint64)
    limits, _ = by.thresholds(array)
    assert (limits.sum(axis=1) == sh.FAR - parts + 1).all() and limits.min() >= -1
    assert parts == 2 or len({tuple(x) for x in limits.tolist()}) > 1  # unequal, by fingerprint
    for i in range(200):
        k = rng.randrange(len(values))
        other = values[k]
        for b in rng.sample(range(64), rng.randint(0, 3)):
            other ^= 1 << b
        mine, theirs = by.keys(array[[k]])[0], by.keys(np.array([other], np.uint64))[0]
        assert any(int(m ^ t).bit_count() <= limit for m, t, limit in zip(mine.tolist(), theirs.tolist(), limits[k].tolist()))


def test_counts_and_masks(spark):
    values = clustered(5)
    by = sh.plan(frame(spark, values), len(values))
    block = sh.block_values(np.array(values, np.uint64), by.order)
    for v in (0, 7):
        for p in range(sh.BLOCKS):
            apart = np.bitwise_count(block[:, p] ^ block[v, p])
            assert [int((apart == d).sum()) for d in range(4)] == by.near[p][:, block[v, p]].astype(int).tolist()
    two = by.masks(2)
    assert len(two) == len(set(two.tolist())) == 16 + 120 and np.bitwise_count(two).max() == 2


def test_hash_is_that_of_spark(spark):
    row = spark.createDataFrame([("naïve café x",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert np.int64(row.h).view(np.uint64) == xxhash.xxh64_intdigest("naïve café x".encode(), 42)
