"""Exact top-k by inner product: term at a time over postings, in blocks of queries and rows.

Queries and rows are dealt into blocks of a fixed size by hash; every block of queries meets
every block of rows once, in a group whose size is bounded however many equal or frequent vectors
there are. In a group each term (dimension) has a posting list of the rows where it is not zero;
the queries scatter their weight times the postings into dense score arrays, a partition selection
keeps the k best of the block, and a ranked window merges the blocks.

Defined cases: a vector that is null or holds a null, NaN or infinite component takes no part; an
empty vector scores 0 with all; a missing component counts as 0; ties go to the smaller id; rows
that share the query's id are no candidates of it, other repeated rows are each a candidate; a
repeated query id asks once, with its smallest vector. Null ids take no part. Only id and vector are read. Scores
are exact for components of any size that a bigint holds; one beyond 64 bits among the best is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm import common

#: Rows and queries of a block; rows and queries of the tile whose scores are held at once.
ROWS, QUERIES, TILE_ROWS, TILE_QUERIES = 16_384, 4_096, 2_048, 256
LEAST = np.iinfo(np.int64).min + 1


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v array<bigint>: floor(scale * x) of the usable vectors."""
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x")
    )
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return usable.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("bigint")).alias("v"))


def _dense(vectors: pd.Series, width: int) -> np.ndarray:
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    flat = np.concatenate([*vectors, np.empty(0, np.int64)]).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def block_top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """The k best rows of a block for each query: query positions, row positions, scores."""
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    n, width = rows.shape
    largest = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (rows, queries)]
    bound = largest[0] * largest[1] * max(width, 1)
    # a score and a place share one number while they fit; beyond that numbers are unbounded
    kind = np.int32 if bound < 2**31 else np.int64 if bound * 2 * max(n, 1) < 2**62 else object
    wide = kind is object
    least = -(bound + 1) * max(n, 1) - 1 if wide else LEAST
    found = []
    for q0 in range(0, len(queries), TILE_QUERIES):
        ask, ids = queries[q0 : q0 + TILE_QUERIES].astype(kind), query_ids[q0 : q0 + TILE_QUERIES]
        best = np.full((len(ask), 0), least, object if wide else np.int64)
        for r0 in range(0, n, TILE_ROWS):
            tile = rows[r0 : r0 + TILE_ROWS].astype(kind)
            score, part = np.zeros((len(tile), len(ask)), kind), np.empty((len(tile), len(ask)), kind)
            for t in range(width):
                weights = ask[:, t]
                postings = np.flatnonzero(tile[:, t])
                if not len(postings) or not weights.any():
                    continue
                scatter = np.multiply(tile[postings, t][:, None], weights[None, :], out=part[: len(postings)])
                if len(postings) == len(tile):
                    score += scatter
                else:
                    score[postings] += scatter
            # one key for score and id: the earlier of two equal scores has the smaller id
            place = n - 1 - (r0 + np.arange(len(tile)))
            key = score.T * n + place.astype(object) if wide else score.T.astype(np.int64) * n + place
            own_at, own_end = (np.searchsorted(row_ids, ids, side=s) for s in ("left", "right"))
            for i in np.flatnonzero(own_at < own_end):
                a, b = max(own_at[i] - r0, 0), min(own_end[i] - r0, len(tile))
                if a < b:
                    key[i, a:b] = least
            key = np.concatenate([best, key], axis=1)
            if wide:
                key = -np.sort(-key, axis=1)
            best = key[:, :k] if wide or key.shape[1] <= k else -np.partition(-key, k - 1, axis=1)[:, :k]
        q, c = np.nonzero(best > least)
        score = best[q, c] // n
        if wide and any(not -(2**63) <= x < 2**63 for x in score):
            raise OverflowError("a score among the best does not fit in 64 bits")
        found.append((q + q0, order[(n - 1 - (best[q, c] - score * n)).astype(np.int64)], score.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row for which `is_query` (on vec_id) holds."""
    rows = quantised(vectors, scale, id_col, vec_col)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_rows, n_queries = rows.count(), rows.where(is_query).count()
    # written with a number for each row, so that many rows of one id and vector are dealt out too
    salted = common.materialize(rows.withColumn("salt", F.monotonically_increasing_id()), "vectors")
    row_blocks, query_blocks = max(1, math.ceil(n_rows / ROWS)), max(1, math.ceil(n_queries / QUERIES))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        # of columns only, so a task that runs again deals its rows like the first time
        block = F.pmod(F.xxhash64(*[c for c in df.columns if c != "v"]), F.lit(blocks)).cast("int")
        return df.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = dealt(asked, "qb", query_blocks, "rb", row_blocks)
    right = dealt(salted, "rb", row_blocks, "qb", query_blocks)

    def meet(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        width = max([0, *map(len, queries["v"]), *map(len, block["v"])])
        q_ids, r_ids = queries["vec_id"].to_numpy(np.int64), block["vec_id"].to_numpy(np.int64)
        q, r, score = block_top(_dense(queries["v"], width), q_ids, _dense(block["v"], width), r_ids, k)
        return pd.DataFrame({"query_id": q_ids[q], "vec_id": r_ids[r], "score": score})

    best = (
        left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(meet, "query_id long, vec_id long, score long")
    )
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
