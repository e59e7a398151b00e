"""Which groups have trouble at the same time: an interval join of sessions.

Two sessions meet if the later one starts no more than a margin after the earlier one ends. A session
covers the buckets from its start to its end plus the margin, at a bucket width that fits its length, so
it covers at most two; every session is also a point, its start, at each of the widths that occur (a few
dozen at most). Covers and points are joined by bucket and the bounds are checked. Of a pair only the
later session is the point, and a cover has one width, so each pair is found exactly once.
A bucket with many points is split: its points are dealt out, its covers go to every part.

Defined cases: rows with a null key or bound take no part; a session that ends before it starts counts as its
start; sessions of one key never meet; equal starts are ordered by key, then by end; repeated rows are sessions of
their own; an empty table has no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.timeparse import MINUTE_MS
from vigil.session import materialize

#: Points of a bucket that one task joins, and the narrowest buckets.
SPLIT, WIDTH_MS = 4096, MINUTE_MS


def _bucket(ms, level):
    """Number of the bucket of width WIDTH_MS * 2 ** level that a time falls in."""
    return F.floor(F.floor(ms / F.lit(float(WIDTH_MS))) / F.pow(F.lit(2.0), level)).cast("long")


def meetings(sessions: DataFrame, margin_ms: int = 0, split: int = SPLIT) -> DataFrame:
    """early, late (structs of key, lo, hi): all pairs of sessions of different keys that meet, each once."""
    rows = sessions.where("key IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL").select(
        F.struct("key", "lo", F.greatest("lo", "hi").alias("hi")).alias("s")
    )
    reach = F.col("s.hi") + margin_ms
    # the least width that is no less than the length: at most two buckets
    level = F.greatest(F.ceil(F.log2(F.greatest(reach - F.col("s.lo"), F.lit(1)) / WIDTH_MS)), F.lit(0)).cast("int")
    rows = materialize(rows.withColumns({"level": level, "reach": reach}), "sessions")
    levels = [r["level"] for r in rows.select("level").distinct().collect()]  # at most 64 - log2(WIDTH_MS)
    if not levels:
        levels = [0]
    points = rows.select(F.col("s").alias("late"), F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"))
    points = points.withColumn("bucket", _bucket(F.col("late.lo"), F.col("level")))
    covers = rows.select(F.col("s").alias("early"), "level", "reach").withColumn(
        "bucket", F.explode(F.sequence(_bucket(F.col("early.lo"), F.col("level")), _bucket(F.col("reach"), F.col("level"))))
    )
    heavy = points.groupBy("level", "bucket").agg(F.ceil(F.count("*") / split).cast("int").alias("parts")).where("parts > 1")
    heavy = materialize(heavy, "heavy")
    parts = F.coalesce("parts", F.lit(1))
    points = points.join(heavy, ["level", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("late"), parts).cast("int")).drop("parts")
    covers = covers.join(heavy, ["level", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    # both are written, so that the join deals them out anew
    points, covers = materialize(points, "points"), materialize(covers, "covers")
    before = F.struct("early.lo", "early.key", "early.hi") < F.struct("late.lo", "late.key", "late.hi")
    meet = before & (F.col("late.lo") <= F.col("reach")) & (F.col("early.key") != F.col("late.key"))
    return covers.join(points, ["level", "bucket", "part"]).where(meet).select("early", "late")


def correlation(sessions: DataFrame, margin_ms: int = 0) -> DataFrame:
    """Per pair of keys (key_a < key_b): how often they meet, which starts first, when, and for how long both last."""
    both = F.greatest(F.least("early.hi", "late.hi") - F.col("late.lo"), F.lit(0))
    pairs = meetings(sessions, margin_ms).select(
        F.least("early.key", "late.key").alias("key_a"), F.greatest("early.key", "late.key").alias("key_b"),
        (F.col("early.key") < F.col("late.key")).alias("a_first"), F.col("late.lo").alias("met_ms"), both.alias("both_ms"),
    )
    return pairs.groupBy("key_a", "key_b").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("a_first").alias("n_a_first"), F.min("met_ms").alias("first_ms"),
        F.max("met_ms").alias("last_ms"), F.sum("both_ms").alias("both_ms"),
    )
