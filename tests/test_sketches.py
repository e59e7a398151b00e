"""Merged sketches against exact counts, within their bounds."""

import random
from collections import Counter

from vigil.operators import sketches as sk

LOG = "id string, log_group string, log_stream string, ts_ms long, message string"
HOUR = 3_600_000


def rows(n=12_000):
    rng = random.Random(9)
    out = []
    for i in range(n):
        stream = "hot" if rng.random() < 0.3 else f"s{int(rng.paretovariate(0.6)) % 4000}"
        out.append((str(i), rng.choice(["a", "a", "b", None]), stream, rng.randrange(48 * HOUR), "x" * int(rng.expovariate(1 / 80))))
    return out + [("n1", "a", None, 5, None), ("n2", "a", "s", None, "no time")]


def check(summary, data, lo=0, hi=10**18):
    got = {r.log_group: r for r in summary.collect()}
    assert set(got) == {r[1] for r in data if r[3] is not None and lo <= r[3] < hi}
    for group, r in got.items():
        mine = [x for x in data if x[1] == group and x[3] is not None and lo <= x[3] < hi]
        assert r.n == len(mine)
        streams = Counter(x[2] for x in mine if x[2] is not None)
        assert abs(r.n_streams - len(streams)) <= max(1, 0.05 * len(streams))
        lengths = sorted(len(x[4]) for x in mine if x[4] is not None)
        for q, value in zip(sk.QUANTILES, r.length_quantiles):
            below, upto = sum(v < value for v in lengths), sum(v <= value for v in lengths)
            assert below - 0.02 * len(lengths) <= q * len(lengths) <= upto + 0.02 * len(lengths)
        assert r.heaviest[0]["item"] == "hot"
        for item in r.heaviest:
            assert abs(item["count"] - streams[item["item"]]) <= len(mine) / (0.75 * sk.ITEMS) + 1


def test_any_range_is_within_the_bounds(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, LOG).repartition(4)
    sk.build(df, HOUR).write.parquet(str(tmp_path / "sketches"))
    stored = spark.read.parquet(str(tmp_path / "sketches"))
    check(sk.summary(stored), data)
    for lo, hi in ((0, 3 * HOUR), (10 * HOUR, 40 * HOUR)):
        check(sk.summary(stored, lo, hi), data, lo, hi)
    # batches add up, in whatever parts they come
    parts = sk.build(df.where("id < '3'"), HOUR).unionByName(sk.build(df.where("id >= '3'"), HOUR))
    check(sk.summary(parts), data)
    assert sk.summary(stored, 99 * HOUR).collect() == []
    assert sk.summary(sk.build(df.limit(0))).collect() == []
