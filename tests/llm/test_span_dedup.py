"""Repeated word spans and byte strings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigil.llm import substring_dedup, suffix_dedup


def marked(size, starts, width):
    gone = np.zeros(size, bool)
    for s in starts:
        gone[s : s + width] = True
    return gone


def brute_words(rows, width):
    seen, words = defaultdict(set), [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - width + 1):
            if i is not None:
                seen[tuple(w[j : j + width])].add(i)
    out = []
    for i, w in words:
        again = [j for j in range(len(w) - width + 1) if i is not None and min(seen[tuple(w[j : j + width])]) < i]
        gone = marked(len(w), again, width)
        out.append((i, hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest(), len(w), int(gone.sum())))
    return sorted(out, key=str)


def brute_bytes(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[j : j + width] for i, b in texts if i is not None for j in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        again = [j for j in range(len(b) - width + 1) if i is not None and count[b[j : j + width]] > 1]
        gone = marked(len(b), again, width)
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, hashlib.sha256(kept).hexdigest(), len(b), int(gone.sum()), runs))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def mixed():
    """Passages of many lengths in several documents, cut and joined at random, also twice in one."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 5)))
    passages = [[word() for _ in range(rng.randint(10, 90))] for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [word() for _ in range(rng.randint(0, 30))]
            p = rng.choice(passages)
            a = rng.randint(0, 8)
            parts += p[a : len(p) - rng.randint(0, 8)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    return rows


def test_words(spark, mixed):
    df = spark.createDataFrame(mixed, "doc_id long, text string")
    for width, k in ((20, 5), (50, 12)):
        got = sorted((tuple(r) for r in substring_dedup.digests(df, width, k).collect()), key=str)
        assert got == brute_words(mixed, width)


@pytest.mark.parametrize("bucket, group", [(1, 1), (1, 3), (1, 1024), (1024, 1024)])
def test_bytes(spark, mixed, monkeypatch, bucket, group):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    df = spark.createDataFrame(mixed, "doc_id long, text string")
    for width, k in ((60, 8), (200, 16)):
        got = sorted((tuple(r) for r in suffix_dedup.digests(df, width, k).collect()), key=str)
        assert got == brute_bytes(mixed, width)


def test_small_batches_of_buckets(spark, mixed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 500)
    df = spark.createDataFrame(mixed, "doc_id long, text string")
    assert sorted((tuple(r) for r in suffix_dedup.digests(df, 60, 8).collect()), key=str) == brute_bytes(mixed, 60)


def test_edge_cases(docs, clashing, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = sorted((tuple(r) for r in substring_dedup.digests(clashing).collect()), key=str)
    assert words == brute_words(rows, 50)
    got = sorted((tuple(r) for r in suffix_dedup.digests(clashing).collect()), key=str)
    assert got == brute_bytes(rows, 200)
    assert substring_dedup.digests(empty).count() == 0 and suffix_dedup.digests(empty).count() == 0
    texts = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(docs).collect()}
    assert texts[1] == "" and texts[9] == "one two three"
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.dedup(docs).collect()}
    assert kept[0] == b"" and kept[8] == b"one"


def test_a_common_phrase_makes_no_common_bucket(spark):
    """Texts that share less than half a window share no bucket, so no context of theirs is read or sorted."""
    rng = random.Random(22)
    noise = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    rows = [(i, noise(300) + " the phrase that many texts have in common " + noise(300), i) for i in range(200)]
    found = suffix_dedup.suffixes(spark.createDataFrame(rows, "doc_id long, text string, key long")).collect()
    assert len({r["node"] for r in found}) == len(found)
    # every suffix is in one run
    starts = defaultdict(list)
    for r in found:
        starts[r["doc_id"]] += range(r["a"], r["b"] + 1)
    assert all(sorted(starts[i]) == list(range(len(t) - 199)) for i, t, _ in rows)
