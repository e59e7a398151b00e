"""Sketches per time bucket and group, merged for any range: distinct streams, message lengths, heaviest streams.

The stored table has one row a bucket and group with three sketches of bounded size: HyperLogLog for the number of
different streams (standard error about 1.04 / sqrt(2 ** LG_K), here 1.6 %), KLL for quantiles of the message length
(rank error about 1 % at K = 256), and frequent items for the heaviest streams (a count is off by at most rows /
(0.75 * ITEMS)). All three merge without loss of these bounds, so a range of any length is answered from the
sketch table alone; batches are appended, late events too.

Defined cases: rows without a time take no part; a null group is a group; null streams and messages are not counted by
the sketches, but their rows are in `n`; a range without rows has no groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.timeparse import HOUR_MS
from vigil.operators.detect import bucket_of

LG_K, K, ITEMS = 12, 256, 1024
QUANTILES = (0.5, 0.9, 0.99)


def build(df: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """bucket_ms, log_group, n, streams, lengths, heavy: one row a bucket and group."""
    rows = df.where("ts_ms IS NOT NULL").select(
        bucket_of("ts_ms", width_ms).alias("bucket_ms"), "log_group", "log_stream", F.char_length("message").cast("long").alias("length")
    )
    return rows.groupBy("bucket_ms", "log_group").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("log_stream", LG_K).alias("streams"),
        F.kll_sketch_agg_bigint("length", K).alias("lengths"),
        F.call_function("approx_top_k_accumulate", F.col("log_stream"), F.lit(ITEMS)).alias("heavy"),
    )


def over(stored: DataFrame, lo_ms: int | None = None, hi_ms: int | None = None) -> DataFrame:
    """log_group, n and the merged sketches of the buckets that begin in [lo_ms, hi_ms)."""
    rows = stored if lo_ms is None else stored.where(F.col("bucket_ms") >= lo_ms)
    rows = rows if hi_ms is None else rows.where(F.col("bucket_ms") < hi_ms)
    return rows.groupBy("log_group").agg(
        F.sum("n").alias("n"), F.hll_union_agg("streams").alias("streams"), F.kll_merge_agg_bigint("lengths", K).alias("lengths"),
        F.call_function("approx_top_k_combine", F.col("heavy"), F.lit(ITEMS)).alias("heavy"),
    )


def summary(stored: DataFrame, lo_ms: int | None = None, hi_ms: int | None = None, top: int = 3) -> DataFrame:
    """log_group, n, n_streams, quantiles of the message length, and the heaviest streams with their counts."""
    merged = over(stored, lo_ms, hi_ms)
    shares = F.array(*[F.lit(q) for q in QUANTILES])
    return merged.select(
        "log_group", "n", F.hll_sketch_estimate("streams").alias("n_streams"),
        F.kll_sketch_get_quantile_bigint("lengths", shares).alias("length_quantiles"),
        F.call_function("approx_top_k_estimate", F.col("heavy"), F.lit(top)).alias("heaviest"),
    )
