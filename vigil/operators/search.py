"""Vector search over log tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import vectors as vx
from vigil.functions.timeparse import since_ms
from vigil.operators.embed import Embedder
from vigil.sources.tables import on_days

# Most numbers a task holds of the product of a block of rows with the queries.
MAX_CELLS_PER_PRODUCT = 4_000_000

RESULT = ("id", "log_group", "log_stream", "ts_ms", "message")


def candidates(
    df: DataFrame,
    min_len: int = 32,
    group: str | None = None,
    since: str | None = None,
    as_of_ms: int | None = None,
    strict: bool = True,
) -> DataFrame:
    """Length, group and start time filters; the last two reach the Parquet scan."""
    out = df.where(F.char_length("message") >= min_len)
    if group:
        out = out.where(F.col("log_group") == group)
    if since:
        if as_of_ms is None:
            raise ValueError("as_of_ms is needed with since")
        cutoff = since_ms(since, as_of_ms, strict=strict)
        if cutoff is not None:
            out = on_days(out, cutoff).where(F.col("ts_ms") >= cutoff)
    return out


def with_distance(df: DataFrame, query: list[float] | DataFrame) -> DataFrame:
    """Adds the cosine distance to a vector, or to the single value of a one-row frame.

    The norm of the query is worked out once, and that of the rows is taken from the
    column `norm` where the table has it.
    """
    stored = F.col("norm") if "norm" in df.columns else None
    if isinstance(query, DataFrame):
        (column,) = query.columns
        pair = F.struct(F.col(column).alias("v"), vx.norm(column).alias("n"))
        with_query = df.withColumn("_q", query.select(pair.alias("q")).scalar())
        distance = vx.cosine_distance("embedding", "_q.v", stored, F.col("_q.n"))
        return with_query.withColumn("distance", distance).drop("_q")
    length = math.sqrt(math.fsum(float(x) ** 2 for x in query))
    return df.withColumn(
        "distance",
        vx.cosine_distance("embedding", vx.vector_literal(query), stored, F.lit(length)),
    )


def nearest(df: DataFrame, k: int) -> DataFrame:
    """Per-partition top k, then a merge of those: no full sort."""
    return df.orderBy(F.col("distance").asc_nulls_last(), "id").limit(k)


def semantic_search(
    df: DataFrame,
    query: list[float] | DataFrame,
    k: int = 20,
    min_len: int = 32,
    group: str | None = None,
    since: str | None = None,
    as_of_ms: int | None = None,
) -> DataFrame:
    found = candidates(df, min_len, group, since, as_of_ms)
    best = nearest(with_distance(found, query).select(*RESULT, "distance"), k)
    return best.withColumn("score", 1 - F.col("distance"))


def search_by_text(
    df: DataFrame, text: DataFrame, embedder: Embedder, k: int = 20, min_len: int = 32
) -> DataFrame:
    """Embed the text (a one-row, one-column frame) like the rows, then search."""
    (column,) = text.columns
    query = embedder(text, column, "_v").select("_v")
    return semantic_search(df, query, k=k, min_len=min_len)


def multi_search(
    df: DataFrame, queries: DataFrame, k: int = 5, min_len: int = 0, slice_size: int = 2048
) -> DataFrame:
    """Top k rows for each of many queries (qid, query).

    Blocks of rows are scored against a block of the queries by one matrix product and only the k best of a block
    per query leave it, so the pairs are never rows. Up to `slice_size` queries are shipped to the tasks
    as they are, and the rows are not moved. More queries stay distributed: rows and queries are dealt into
    blocks by hash, and every block of rows meets every block of queries in one task.
    """
    total = queries.count()
    found = df.where(F.char_length("message") >= min_len) if min_len else df
    rows = found.select("id", "embedding")
    kind = "qid string, id string, distance double"
    if total <= slice_size:
        block = queries.select("qid", "query").toArrow()
        if not block.num_rows:
            return df.sparkSession.createDataFrame([], "qid string, rank int, id string, distance double")
        merged = rows.mapInArrow(_block_scorer(block, k), kind)
    else:
        parts = [max(1, -(-n // slice_size)) for n in (total, rows.count())]
        dealt = lambda one, name, own, n, other, m: one.withColumn(
            own, F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
        ).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        left = dealt(queries.select("qid", "query"), "qid", "_q", parts[0], "_r", parts[1])
        right = dealt(rows, "id", "_r", parts[1], "_q", parts[0])

        def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
            out = [b for b in _block_scorer(asked, k)(iter(held.to_batches()))] if asked.num_rows and held.num_rows else []
            return pa.Table.from_batches(out, pa.schema([("qid", pa.string()), ("id", pa.string()), ("distance", pa.float64())]))

        merged = left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInArrow(meet, kind)
    per_query = Window.partitionBy("qid").orderBy("distance", "id")
    return (
        merged.withColumn("rank", F.row_number().over(per_query))
        .where(F.col("rank") <= k)
        .select("qid", "rank", "id", "distance")
    )


def _block_scorer(block: pa.Table, k: int):
    """Batches of rows (id, embedding) to the k best of them for each query of the block."""
    qids = [str(q) for q in block.column("qid").to_pylist()]
    matrix = np.array(block.column("query").to_pylist(), dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    dim = matrix.shape[1]

    step = max(1, MAX_CELLS_PER_PRODUCT // len(qids))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in qids]
        for batch in batches:
            sizes = np.asarray(batch.column("embedding").value_lengths().fill_null(-1))
            usable = np.flatnonzero(sizes == dim)
            for start in range(0, len(usable), step):
                keep = pa.array(usable[start : start + step])
                flat = batch.column("embedding").take(keep).flatten().to_numpy(zero_copy_only=False)
                table = flat.astype(np.float64).reshape(len(keep), dim)
                with np.errstate(divide="ignore", invalid="ignore"):
                    table /= np.linalg.norm(table, axis=1)[:, None]
                # rounded, so that equal vectors tie wherever they stand in a product
                distance = np.round(1.0 - table @ unit.T, 12)
                ids = np.asarray(batch.column("id").take(keep).to_pylist(), dtype=str)
                for j, one in enumerate(best):
                    one.add(ids, distance[:, j])
        for qid, one in zip(qids, best):
            if len(one.ids):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([qid] * len(one.ids), pa.string()),
                        pa.array(one.ids.tolist(), pa.string()),
                        pa.array(one.distances, pa.float64()),
                    ],
                    ["qid", "id", "distance"],
                )

    return score


class _Best:
    """The k nearest rows of a task for one query, ties by id."""

    def __init__(self, k: int):
        self.k = k
        self.ids = np.array([], dtype=str)
        self.distances = np.array([], dtype=np.float64)

    def add(self, ids: np.ndarray, distances: np.ndarray) -> None:
        worst = self.distances[-1] if len(self.ids) == self.k else np.inf
        # rows without a distance compare as false and drop out
        found = np.flatnonzero(distances <= worst)
        if len(found) > self.k:
            # keep every row that ties with the k-th, the order by id decides
            limit = np.partition(distances[found], self.k - 1)[self.k - 1]
            found = found[distances[found] <= limit]
        if len(found):
            all_ids = np.concatenate([self.ids, ids[found]])
            all_distances = np.concatenate([self.distances, distances[found]])
            order = np.lexsort((all_ids, all_distances))[: self.k]
            self.ids, self.distances = all_ids[order], all_distances[order]


def search_stats(results: DataFrame) -> DataFrame:
    """Result count and mean score per query of a many-query search."""
    return results.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_results"),
        F.avg(1 - F.col("distance")).alias("mean_score"),
        F.min("distance").alias("best_distance"),
    )


def hybrid_search(
    df: DataFrame, query: list[float] | DataFrame, k: int, condition: Column, min_len: int = 32
) -> DataFrame:
    """Vector top k first, then relational filters on those rows."""
    return semantic_search(df, query, k=k, min_len=min_len).where(condition)
