"""Change points of a group's event rate: a seasonal baseline and a two-sided CUSUM.

Counts per group and bucket, empty buckets included, are compared with the median of the same hour of the day, in
units of the median absolute deviation (at least one event). The standardised differences less a drift
are summed from bucket to bucket, never below zero: S = max(0, S + z - drift). That is P - min(0, least P so
far) with P the running sum, so a span of buckets is the pair (sum, least prefix sum), and spans combine
associatively. An alarm is a bucket in which S passes the limit; its onset is the bucket after S was last zero.

The baseline is an aggregate over at most as many buckets as there are days. Windows run over buckets of a group, not
over events: a few thousand rows for each year.

Defined cases: rows without a time take no part; a null group is a group; a group with one bucket has no alarm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.timeparse import DAY_MS, HOUR_MS
from vigil.operators.detect import bucket_of

DRIFT, LIMIT, SCALE = 0.5, 5.0, 1.4826


def dense_counts(df: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """log_group, bucket_ms, n from each group's first bucket to its last."""
    counts = df.where("ts_ms IS NOT NULL").groupBy("log_group", bucket_of("ts_ms", width_ms).alias("bucket_ms")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.groupBy("log_group").agg(F.min("bucket_ms").alias("lo"), F.max("bucket_ms").alias("hi"))
    calendar = span.select("log_group", F.explode(F.sequence("lo", "hi", F.lit(width_ms).cast("long"))).alias("bucket_ms"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(calendar).groupBy("log_group", "bucket_ms").agg(F.sum("n").alias("n"))


def standardised(counts: DataFrame) -> DataFrame:
    """Adds the expected count of the hour of the day, and z."""
    hour = F.floor(F.pmod(F.col("bucket_ms"), F.lit(DAY_MS)) / HOUR_MS)
    rows = counts.withColumn("hour", hour)
    same = F.col("log_group").eqNullSafe(F.col("of")) & (F.col("hour") == F.col("at"))
    named = lambda df: df.withColumnsRenamed({"log_group": "of", "hour": "at"})
    middle = named(rows.groupBy("log_group", "hour").agg(F.median("n").alias("expected")))
    rows = rows.join(middle, same).drop("of", "at")
    apart = named(rows.groupBy("log_group", "hour").agg(F.median(F.abs(F.col("n") - F.col("expected"))).alias("mad")))
    rows = rows.join(apart, same).drop("of", "at")
    return rows.withColumn("z", (F.col("n") - F.col("expected")) / F.greatest(SCALE * F.col("mad"), F.lit(1.0)))


def change_points(df: DataFrame, width_ms: int = HOUR_MS, drift: float = DRIFT, limit: float = LIMIT) -> DataFrame:
    """log_group, direction, onset_ms, bucket_ms (of the alarm), n, expected, cusum for every alarm."""
    rows = standardised(dense_counts(df, width_ms))
    sides = F.array(*[F.struct(F.lit(name).alias("direction"), (sign * F.col("z") - drift).alias("step")) for name, sign in (("up", 1), ("down", -1))])
    rows = rows.select("log_group", "bucket_ms", "n", "expected", F.explode(sides).alias("x")).select("log_group", "bucket_ms", "n", "expected", "x.*")
    ordered = Window.partitionBy("log_group", "direction").orderBy("bucket_ms")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("p", F.round(F.sum("step").over(so_far), 9))
    rows = rows.withColumn("cusum", F.round(F.col("p") - F.least(F.lit(0.0), F.min("p").over(so_far)), 6))
    rows = rows.withColumns({
        "before": F.lag("cusum", 1, 0.0).over(ordered),
        "zero": F.max(F.when(F.col("cusum") == 0, F.col("bucket_ms"))).over(so_far),
        "first": F.min("bucket_ms").over(so_far),
    })
    onset = F.coalesce(F.col("zero") + width_ms, F.col("first"))
    return rows.where((F.col("cusum") > limit) & (F.col("before") <= limit)).select(
        "log_group", "direction", onset.alias("onset_ms"), "bucket_ms", "n", "expected", "cusum"
    )
