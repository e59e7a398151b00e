"""Learned message templates against a plain miner."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.operators import templates as tp


def slow(messages, depth=2):
    """{template: number of messages}; messages: list of texts or None."""
    rows = [m.strip(" \t\n\x0b\f\r").split() or [""] for m in messages if m is not None]
    fixed = lambda here, total: here >= min(2, total) and here * 16 >= total
    path = [()] * len(rows)
    for level in range(depth):
        total, seen = Counter(), Counter()
        for r, p in zip(rows, path):
            if level < len(r):
                total[len(r), p] += 1
                seen[len(r), p, r[level]] += 1
        path = [
            p if level >= len(r) else (*p, r[level] if fixed(seen[len(r), p, r[level]], total[len(r), p]) else "<*>")
            for r, p in zip(rows, path)
        ]
    total, seen = Counter(), Counter()
    for r, p in zip(rows, path):
        total[len(r), p] += 1
        for i, w in enumerate(r[depth:]):
            seen[len(r), p, i, w] += 1
    out = Counter()
    for r, p in zip(rows, path):
        rest = [w if fixed(seen[len(r), p, i, w], total[len(r), p]) else "<*>" for i, w in enumerate(r[depth:])]
        out[" ".join([*p, *rest])] += 1
    return dict(out)


def mined(df):
    return {r.template: r.n for r in tp.learned_templates(df).collect()}


NAMES = [f"{a}{b}" for a in ("ann", "bob", "cat", "dan", "eve", "fay") for b in ("ia", "o", "y", "ette", "son", "ley")]


def test_words_that_vary_fold(spark, logs):
    """Names are no digits, hex numbers or ids; a regex mask would keep each of them."""
    df = logs(*[(str(i), "g", "s", i, f"user {n} logged in") for i, n in enumerate(NAMES)],
              *[(f"x{i}", "h", "s", i, f"user {n} failed to pay") for i, n in enumerate(NAMES)])
    assert mined(df) == {"user <*> logged in": 36, "user <*> failed to pay": 36}
    row = [r for r in tp.learned_templates(df).collect() if "pay" in r.template][0]
    assert (row.n_variables, row.first_ts_ms, row.last_ts_ms, row.n_groups, row.main_group) == (1, 0, 35, 1, "h")


def test_fixed_words_after_the_path_stay_apart(logs):
    df = logs(*[(str(i), "g", "s", i, f"disk sda {'read' if i % 2 else 'write'} of {n}") for i, n in enumerate(NAMES)])
    assert mined(df) == {"disk sda read of <*>": 18, "disk sda write of <*>": 18}


def test_awkward_messages(logs, spark):
    texts = [None, "", "  \t\n ", "one", "one", "two  words", " two words ", "x" * 9000, "a <*> c", "é 漢字", "same same same same"]
    df = logs(*[(str(i), "g", "s", i, t) for i, t in enumerate(texts)])
    assert mined(df) == slow(texts)
    assert tp.learned_templates(df.limit(0)).collect() == []
    clash = df.withColumns({"words": F.lit(1), "path": F.lit(2), "n": F.lit(3), "length": F.lit(4)})
    assert mined(clash) == slow(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_the_plain_miner(logs, seed):
    rng = random.Random(seed)
    kinds = [
        lambda: f"login {rng.choice(NAMES)} ok", lambda: f"{rng.choice(NAMES)} left", lambda: f"order {rng.randint(1, 999)} of {rng.choice(NAMES)} shipped",
        lambda: "cache miss", lambda: " ".join(rng.choices(NAMES, k=rng.randint(1, 6))), lambda: f"retry {rng.randint(0, 3)} of 3 for {rng.choice(NAMES)}",
    ]
    texts = [rng.choice(kinds)() for _ in range(600)] + ["hot message here"] * 300
    df = logs(*[(str(i), f"g{i % 3}", "s", i, t) for i, t in enumerate(texts)]).repartition(5)
    assert mined(df) == slow(texts)


def test_prefix_counts_of_batches_add_up(logs):
    texts = [f"user {n} came" for n in NAMES] + ["all done"] * 5
    df = logs(*[(str(i), "g", "s", i, t) for i, t in enumerate(texts)])
    parts = [tp.prefixes(tp.shapes(df.where(F.col("ts_ms") % 2 == k))) for k in range(2)]
    key = lambda rows: sorted((r.length, tuple(r.prefix), r.n) for r in rows.collect())
    assert key(tp.merge(*parts)) == key(tp.prefixes(tp.shapes(df)))
    tree = {(r.length, tuple(r.prefix)): tuple(r.path) for r in tp.paths(tp.merge(*parts)).collect()}
    assert tree[3, ("user", "annia")] == ("user", "<*>") and tree[2, ("all", "done")] == ("all", "done")
