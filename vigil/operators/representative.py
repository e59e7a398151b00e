"""Representative rows of a group: near its mean vector, and unlike each other.

The mean vector of a group is a partial aggregate. The `pool` rows nearest to it are found by a ranked limit that
also runs before the shuffle, so a group is never gathered; among these few the first pick is the nearest,
and each further one is the row farthest from the picks before it.

Defined cases: rows without a usable vector take no part; a null group is a group; distances tie by id; groups with
fewer rows than picks give all of them; vectors of other lengths than the group's must not be mixed in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import vectors as vx

PICKS, POOL = 3, 20


def pool(df: DataFrame, size: int = POOL) -> DataFrame:
    """log_group, id, embedding, distance, place: the rows nearest to their group's mean vector."""
    rows = df.where(vx.is_usable("embedding")).select("log_group", "id", "embedding")
    mean = vx.mean_by_key(rows, "log_group", "embedding").select(F.col("log_group").alias("of"), "mean_vector")
    near = rows.join(mean, F.col("log_group").eqNullSafe(F.col("of"))).select(
        "log_group", "id", "embedding", F.round(vx.cosine_distance("embedding", "mean_vector"), 9).alias("distance")
    )
    ranked = Window.partitionBy("log_group").orderBy(F.col("distance").asc_nulls_last(), "id")
    return near.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= size)


def _picked(rows: pd.DataFrame, picks: int) -> pd.DataFrame:
    rows = rows.sort_values("place").reset_index(drop=True)
    vectors = np.array(rows["embedding"].tolist(), dtype=np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    apart = np.round(1 - vectors @ vectors.T, 9)
    chosen = [0]
    while len(chosen) < min(picks, len(rows)):
        least = apart[:, chosen].min(axis=1)
        least[chosen] = -1
        chosen.append(int(least.argmax()))  # the first of equal ones: nearer to the mean
    out = rows.iloc[chosen][["log_group", "id", "distance"]]
    return out.assign(pick=np.arange(1, len(chosen) + 1, dtype=np.int32))


def representatives(df: DataFrame, picks: int = PICKS, size: int = POOL) -> DataFrame:
    """log_group, pick (from 1), id, distance to the mean."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        return _picked(rows, picks)

    found = pool(df, size).groupBy("log_group").applyInPandas(choose, "log_group string, id string, distance double, pick int")
    return found.select("log_group", "pick", "id", "distance")
