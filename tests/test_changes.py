"""Change points and representative rows against plain Python."""

import random
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from vigil.operators import changes, representative

HOUR = 3_600_000


def events(spark, counts):
    """counts: {(group, hour): n}"""
    df = spark.createDataFrame([(g, h, n) for (g, h), n in counts.items()], "log_group string, h long, n int")
    each = F.explode(F.sequence(F.col("h") * HOUR, F.col("h") * HOUR + F.col("n") - 1))
    return df.select("log_group", each.alias("ts_ms"), F.lit("m").alias("message"))


def slow(counts, drift=0.5, limit=5.0):
    out = []
    for g in {g for g, _ in counts}:
        hours = [h for x, h in counts if x == g]
        n = {h: counts.get((g, h), 0) for h in range(min(hours), max(hours) + 1)}
        mid = {k: median([v for h, v in n.items() if h % 24 == k]) for k in {h % 24 for h in n}}
        mad = {k: median([abs(v - mid[k]) for h, v in n.items() if h % 24 == k]) for k in mid}
        for name, sign in (("up", 1), ("down", -1)):
            s, zero = 0.0, None
            for h, v in n.items():
                z = (v - mid[h % 24]) / max(1.4826 * mad[h % 24], 1.0)
                was, s = s, max(0.0, s + sign * z - drift)
                s = 0.0 if s < 1e-7 else s
                if s == 0:
                    zero = h
                if s > limit >= was:
                    out.append((g, name, (zero + 1 if zero is not None else min(n)) * HOUR, h * HOUR, v, float(mid[h % 24]), round(s, 4)))
    return sorted(out)


def rates(seed, days=12, shift=200):
    rng = random.Random(seed)
    base = lambda h: 20 + 10 * (h % 24 in range(9, 18))
    counts = {(g, h): max(1, int(rng.gauss(base(h), 1.5))) for g in ("calm", "jump", "drop") for h in range(days * 24)}
    for h in range(shift, shift + 12):
        counts["jump", h] += 12
        counts["drop", h] = 1
    return counts


def test_planted_shifts_are_found_and_calm_groups_are_silent(spark):
    counts = rates(1)
    got = changes.change_points(events(spark, counts), limit=12.0).collect()
    first = {r.log_group: r for r in sorted(got, key=lambda r: -r.bucket_ms)}
    assert "calm" not in first
    assert first["jump"].direction == "up" and 200 * HOUR <= first["jump"].bucket_ms <= 203 * HOUR
    assert first["drop"].direction == "down" and 200 * HOUR <= first["drop"].onset_ms <= 201 * HOUR


def test_agrees_with_the_sequential_form(spark):
    counts = rates(2, 6, 100) | {("sparse", h): 1 + h % 3 for h in (0, 3, 50, 51, 52, 140)} | {("one", 7): 5}
    got = changes.change_points(events(spark, counts)).collect()
    assert sorted((r.log_group, r.direction, r.onset_ms, r.bucket_ms, r.n, r.expected, round(r.cusum, 4)) for r in got) == slow(counts)
    nothing = events(spark, counts).limit(0)
    assert changes.change_points(nothing).count() == 0
    assert changes.change_points(events(spark, {("g", 1): 3}).withColumn("ts_ms", F.lit(None).cast("long"))).count() == 0


def slow_picks(vectors, picks, size):
    """vectors: {id: array}"""
    ids = sorted(vectors)
    table = np.array([vectors[i] for i in ids], dtype=np.float64)
    mean = table.mean(axis=0)
    unit = table / np.linalg.norm(table, axis=1, keepdims=True)
    far = np.round(1 - unit @ (mean / np.linalg.norm(mean)), 9)
    pool = sorted(range(len(ids)), key=lambda k: (far[k], ids[k]))[:size]
    apart = lambda a, b: round(float(1 - unit[a] @ unit[b]), 9)
    chosen = [pool[0]]
    while len(chosen) < min(picks, len(pool)):
        rest = [k for k in pool if k not in chosen]
        chosen.append(max(rest, key=lambda k: (min(apart(k, c) for c in chosen), -pool.index(k))))
    return [ids[k] for k in chosen]


def test_representatives_agree_with_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g, n in (("a", 60), ("b", 2), (None, 9), ("hot", 400)):
        vectors = {f"{g}-{i:03d}": np.float32(np.round(rng.normal(size=4) + 1, 2)).tolist() for i in range(n)}
        rows += [(g, i, v) for i, v in vectors.items()]
        want[g] = slow_picks(vectors, 3, 20)
    rows += [("a", "null", None), ("a", "zero", [0.0] * 4), ("a", "none", [])]
    df = spark.createDataFrame(rows, "log_group string, id string, embedding array<float>").repartition(5)
    got = {}
    for r in representative.representatives(df).orderBy("pick").collect():
        got.setdefault(r.log_group, []).append(r.id)
    assert got == want
    assert representative.representatives(df.limit(0)).collect() == []


def test_the_limit_runs_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", "1", [1.0, 2.0])], "log_group string, id string, embedding array<float>")
    assert "WindowGroupLimit" in representative.pool(df)._jdf.queryExecution().executedPlan().toString()
