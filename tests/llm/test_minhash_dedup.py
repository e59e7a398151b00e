import itertools
import random
import re

import numpy as np
import pytest

from vigil.llm import minhash_dedup as mh
from vigil.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect() if r["doc_id"] is not None}


def test_edge_cases(docs, empty, clashing, texts):
    want = brute([*enumerate(texts), (40, texts[2])])
    out = mh.near_duplicates(clashing)
    assert got(out) == want and out.count() == docs.count()
    lone = out.where("doc_id IS NULL").first()
    assert lone["kept"] and lone["component_id"] is None
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in out.where("doc_id IS NOT NULL").collect())
    assert mh.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_groups_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(mh, "BLOCK", block)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, at = [], 0
    for group in range(6):
        base = [word() for _ in range(150)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((at, " ".join(copy)))
            at += 1
    passage = [word() for _ in range(80)]
    rows += [(at + i, " ".join([word() for _ in range(60)] + passage)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(mh.near_duplicates(df)) == brute(rows)


def test_chunk_keys_meet_within_the_allowed_errors():
    rng = np.random.default_rng(5)
    one = rng.integers(0, 2**16, (1, mh.VALUES), dtype=np.uint16)
    for _ in range(50):
        other = one.copy()
        gone = rng.choice(mh.VALUES, 2 * mh.CHUNKS - 1, replace=False)
        other[0, gone] ^= 1
        assert np.isin(mh.chunk_keys(one), mh.chunk_keys(other)).any()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    of = {r["node"]: r["component"] for r in rows}
    assert len(rows) == len(of) and {of[i] for i in range(41)} == {0} and {of[i] for i in range(100, 140)} == {100}
    assert of[201] == of[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
