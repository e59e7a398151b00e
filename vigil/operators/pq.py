"""Product-quantised inverted lists: vector search that reads short codes, then few whole vectors.

Unit vectors are assigned to cells (inverted lists). What is left after the cell's centre is cut into
sub-vectors, each replaced by the number of its nearest codeword: one byte a sub-vector. A search makes
one table of products of the query with all codewords, adds up table entries for the codes of the probed
lists (asymmetric distances), and reads whole vectors only for the best `rerank` of them, whose exact
distances decide. Centres and codebooks come from a bounded sample; every usable row is indexed.

On disk: `codes` by cell and batch; `vectors` by batch, sorted by id in small pages, so that reading the
short list skips the pages between; `cells` and `codebooks`, whose sizes are parameters.

Rows without a vector of the index's dimension, or with null, non-finite or only zero components, are not
indexed. Distances tie by id. The operator is approximate: the exact one is `search.semantic_search`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions import vectors as vx
from vigil.operators.search import RESULT, nearest, with_distance
from vigil.session import materialize

MAX_CELLS = 4096
#: Codewords of a sub-vector: one byte. Rounds of their training.
WORDS, ROUNDS = 256, 8
#: Rows that centres and codebooks are trained on, about.
SAMPLE_ROWS = 65_536
#: Codes and queries that a task of a many-query search holds.
CODE_BLOCK, QUERY_BLOCK = 65_536, 512
#: Rows that a task computes with at once.
SLICE = 4096
#: Rows of a page of the stored vectors.
PAGE_ROWS = 64


def usable(dim: int) -> Column:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vx.is_usable("embedding") & F.coalesce((F.size("embedding") == dim) & finite, F.lit(False))


def _matrix(column: pa.Array, dim: int, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, dim)


def _unit(values: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of large components stay finite
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _any(tests: list[Column]) -> Column:
    """Their disjunction, as a balanced tree."""
    if len(tests) > 1:
        half = len(tests) // 2
        return _any(tests[:half]) | _any(tests[half:])
    return tests[0] if tests else F.lit(False)


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half, out = (centres * centres).sum(axis=1) / 2, np.empty(len(rows), np.int64)
    for i in range(0, len(rows), SLICE):
        out[i : i + SLICE] = (rows[i : i + SLICE] @ centres.T - half).argmax(axis=1)
    return out


def _trained(rows: np.ndarray, words: int, rounds: int) -> np.ndarray:
    """Codewords of one sub-vector, by Lloyd's rounds from rows that lie evenly in the sorted sample."""
    ordered = rows[np.lexsort(rows.T)]
    words_ = ordered[np.unique(np.linspace(0, len(ordered) - 1, min(words, len(ordered))).astype(int))].copy()
    for _ in range(rounds):
        own = _closest(rows, words_)
        count = np.bincount(own, minlength=len(words_))
        for d in range(rows.shape[1]):
            total = np.bincount(own, rows[:, d], minlength=len(words_))
            words_[:, d] = np.where(count > 0, total / np.maximum(count, 1), words_[:, d])
    return words_


class PQIndex:
    """An index below `path`; see the module's text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        cells = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
        books = spark.read.parquet(f"{self.path}/codebooks").orderBy("m").collect()
        if len(cells) > MAX_CELLS:
            raise ValueError(f"more than {MAX_CELLS} cells")
        self.centres = np.array([r["centre"] for r in cells])
        self.dim, self.parts = self.centres.shape[1], len(books)
        width = self.dim // self.parts
        # [sub-vector, codeword, component], filled up with words that no code names
        self.books = np.zeros((self.parts, WORDS, width))
        self.counts = np.array([len(r["words"]) // width for r in books])
        for m, r in enumerate(books):
            self.books[m, : self.counts[m]] = np.array(r["words"]).reshape(-1, width)

    @classmethod
    def train(cls, df: DataFrame, path: str, dim: int, cells: int = 64, parts: int = 16, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> "PQIndex":
        """Centres and codebooks from about `sample_rows` rows, chosen by a hash of their ids; adds no rows."""
        if cells > MAX_CELLS or dim % parts:
            raise ValueError(f"at most {MAX_CELLS} cells, and a number of sub-vectors that divides the dimension")
        spark, rows = df.sparkSession, df.where(usable(dim))
        total = rows.count()
        if not total:
            raise ValueError("no usable vectors to train on")
        chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(total)) < sample_rows).select("id", "embedding")

        def unit(batches):
            for batch in batches:
                if batch.num_rows:
                    values = _unit(_matrix(batch.column(1), dim, batch.num_rows))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim), pa.array(values.ravel()))
                    yield pa.record_batch([batch.column(0), flat], ["id", "unit"])

        sample = materialize(chosen.mapInArrow(unit, "id string, unit array<double>"), "sample")
        vectors = sample.orderBy("id").withColumn("v", array_to_vector("unit")).select("v")
        model = KMeans(k=max(2, min(cells, total)), featuresCol="v", maxIter=10, seed=seed).fit(vectors)
        centres = np.array([[float(x) for x in c] for c in model.clusterCenters()])
        width = dim // parts

        def rest(batches):
            for batch in batches:
                if batch.num_rows:
                    values = _matrix(batch.column(1), dim, batch.num_rows)
                    values = values - centres[_closest(values, centres)]
                    # one row a sub-vector
                    flat = pa.array(values.reshape(-1, width).ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows * parts + 1, dtype=np.int32) * width), flat)
                    yield pa.record_batch([pa.array(np.tile(np.arange(parts, dtype=np.int32), batch.num_rows)), lists], ["m", "x"])

        def train(table: pd.DataFrame) -> pd.DataFrame:
            words = _trained(np.stack(table["x"].to_numpy()), WORDS, ROUNDS)
            return pd.DataFrame({"m": [table["m"].iloc[0]], "words": [words.ravel().tolist()]})

        # the sample is bounded, and so is each of the groups, one for a sub-vector
        books = sample.mapInArrow(rest, "m int, x array<double>").groupBy("m").applyInPandas(train, "m int, words array<double>")
        books.write.mode("overwrite").parquet(f"{path}/codebooks")
        spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, centre array<double>").write.mode(
            "overwrite"
        ).parquet(f"{path}/cells")
        return cls(spark, path)

    def append(self, df: DataFrame, batch: int) -> "PQIndex":
        """Add the usable rows; a batch that is added again replaces its files."""
        rows = df.where(usable(self.dim))
        centres, books, counts, dim, parts = self.centres, self.books, self.counts, self.dim, self.parts
        width = dim // parts

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in batches:
                if not piece.num_rows:
                    continue
                values = _unit(_matrix(piece.column("embedding"), dim, piece.num_rows))
                cell = _closest(values, centres)
                values -= centres[cell]
                code = np.empty((piece.num_rows, parts), np.uint8)
                for m in range(parts):
                    code[:, m] = _closest(values[:, m * width : (m + 1) * width], books[m, : counts[m]])
                bytes_ = pa.array([row.tobytes() for row in code], pa.binary())
                yield pa.record_batch(
                    [piece.column("id"), piece.column("log_group"), piece.column("ts_ms"), bytes_, pa.array(cell.astype(np.int32))],
                    ["id", "log_group", "ts_ms", "code", "cell"],
                )

        coded = rows.select("id", "log_group", "ts_ms", "embedding").mapInArrow(
            encode, "id string, log_group string, ts_ms long, code binary, cell int"
        )
        replacing = lambda w: w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        replacing(coded.withColumn("batch", F.lit(batch)).hint("rebalance", "cell").write).partitionBy("cell", "batch").parquet(f"{self.path}/codes")
        stored = rows.select(*RESULT, "embedding").withColumn("batch", F.lit(batch)).repartitionByRange("id").sortWithinPartitions("id")
        replacing(stored.write).option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("batch").parquet(f"{self.path}/vectors")
        return self

    def codes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/codes")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def _table(self, unit: np.ndarray) -> np.ndarray:
        """[sub-vector, codeword]: products with a query."""
        return np.einsum("mwd,md->mw", self.books, unit.reshape(self.parts, -1))

    def probed(self, unit: np.ndarray, probes: int | None) -> np.ndarray:
        """The nearest cells first."""
        cost = (self.centres**2).sum(axis=1) / 2 - self.centres @ unit
        return np.lexsort((np.arange(len(cost)), cost))[: probes or len(cost)]

    def search(self, query: list[float], k: int = 20, probes: int | None = None, rerank: int = 60, condition: Column | None = None) -> DataFrame:
        """The k nearest rows of the short list. `condition` may use id, log_group and ts_ms; `probes`: lists read, all if None."""
        unit = _unit(np.array([query], dtype=np.float64))[0]
        table, base = self._table(unit), self.centres @ unit
        cells = self.probed(unit, probes).tolist()
        listed = self.codes().where(F.col("cell").isin(cells))
        listed = listed if condition is None else listed.where(condition)

        def score(batches):
            best_id, best = np.empty(0, object), np.empty(0)
            for batch in batches:
                if batch.num_rows:
                    code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    near = base[batch.column(2).to_numpy()] + table[np.arange(code.shape[1]), code].sum(axis=1)
                    ids = np.concatenate([best_id, np.array(batch.column(0).to_pylist(), object)])
                    near = np.concatenate([best, np.round(near, 12)])
                    keep = np.lexsort((ids.astype(str), -near))[:rerank]
                    best_id, best = ids[keep], near[keep]
            if len(best):
                yield pa.record_batch([pa.array(best_id.tolist(), pa.string()), pa.array(best)], ["id", "near"])

        short = listed.select("id", "code", "cell").mapInArrow(score, "id string, near double")
        ids = [r["id"] for r in short.orderBy(F.desc("near"), "id").limit(rerank).collect()]
        # one equality each, which the files' page statistics can answer
        some = _any([F.col("id") == i for i in ids])
        best = nearest(with_distance(self.vectors().where(some), query).select(*RESULT, "distance"), k)
        return best.withColumn("score", 1 - F.col("distance"))

    def search_many(self, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int = 60) -> DataFrame:
        """qid, rank, id, distance, n_scored: the k best rows for each of many queries (qid, query).

        n_scored: the codes looked at for the query. A query goes to its lists; long lists and many queries
        are dealt out in blocks, and only the `rerank` best of a query and block leave it.
        """
        sizes = materialize(self.codes().groupBy("cell").agg(F.count("*").alias("size")), "lists")  # a row a cell
        asked = queries.where(F.col("qid").isNotNull()).select(F.col("qid").cast("string").alias("qid"), F.col("query").alias("embedding"))
        asked = asked.where(usable(self.dim))
        blocks = asked.agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int")).first()[0]
        index, dim = self._light(), self.dim
        cut = F.ceil(F.col("size") / CODE_BLOCK).cast("int")
        def route(batches):
            for batch in batches:
                if batch.num_rows:
                    unit = _unit(_matrix(batch.column(1), dim, batch.num_rows))
                    cells = [index.probed(u, probes).tolist() for u in unit]
                    at = np.cumsum([0] + [len(c) for c in cells]).astype(np.int32)
                    flat = pa.array(np.concatenate([np.array(c, np.int32) for c in cells]))
                    units = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim), pa.array(unit.ravel()))
                    yield pa.record_batch([batch.column(0), units, pa.ListArray.from_arrays(pa.array(at), flat)], ["qid", "unit", "cells"])

        routed = materialize(asked.mapInArrow(route, "qid string, unit array<double>, cells array<int>"), "routed")
        to_cells = routed.select("qid", "unit", F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell")
        share = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
        left = to_cells.select("qid", "unit", "cell", share("qid", F.lit(max(blocks, 1))).alias("j"), F.explode(F.sequence(F.lit(0), cut - 1)).alias("i"))
        right = self.codes().join(F.broadcast(sizes), "cell").select(
            "cell", "id", "code", share("id", cut).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))).alias("j")
        )

        def score(asked_: pa.Table, listed: pa.Table) -> pa.Table:
            kind = pa.schema([("qid", pa.string()), ("id", pa.string()), ("near", pa.float64())])
            if not asked_.num_rows or not listed.num_rows:
                return kind.empty_table()
            ids = np.array(listed.column("id").to_pylist(), dtype=str)
            code = np.frombuffer(b"".join(listed.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            # as numbers of the flat table; small numbers and slices keep a worker's memory apart from the block's size
            flat = code + (np.arange(code.shape[1]) * WORDS).astype(np.int32)
            out: list[tuple[str, np.ndarray, np.ndarray]] = []
            for qid, unit, cell in zip(asked_.column("qid").to_pylist(), asked_.column("unit").to_pylist(), asked_.column("cell").to_pylist()):
                unit = np.array(unit)
                table = index._table(unit).ravel()
                near = np.concatenate([table[flat[i : i + SLICE]].sum(axis=1) for i in range(0, len(flat), SLICE)])
                near = np.round(index.centres[cell] @ unit + near, 12)
                limit = np.partition(near, -rerank)[-rerank] if len(near) > rerank else -np.inf
                some = np.flatnonzero(near >= limit)
                some = some[np.lexsort((ids[some], -near[some]))[:rerank]]
                out.append((qid, ids[some], near[some]))
            names = np.repeat([q for q, *_ in out], [len(i) for _, i, _ in out]).tolist()
            return pa.table([pa.array(names, pa.string()), pa.array(np.concatenate([i for _, i, _ in out]).tolist(), pa.string()),
                             pa.array(np.concatenate([n for *_, n in out]))], schema=kind)

        found = left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInArrow(score, "qid string, id string, near double")
        best_first = Window.partitionBy("qid").orderBy(F.desc("near"), "id")
        short = materialize(found.withColumn("r", F.row_number().over(best_first)).where(F.col("r") <= rerank).select("qid", "id"), "short")
        whole = short.join(self.vectors().select("id", "embedding"), "id").join(routed.select("qid", "unit"), "qid")
        exact = whole.select("qid", "id", vx.cosine_distance("embedding", "unit").alias("distance"))
        ranked = Window.partitionBy("qid").orderBy("distance", "id")
        scored = to_cells.groupBy("qid").agg(F.sum("size").alias("n_scored"))
        best = exact.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        return best.join(scored, "qid").select("qid", "rank", "id", "distance", "n_scored")

    def _light(self) -> "PQIndex":
        """A copy without the session, for tasks."""
        copy = object.__new__(PQIndex)
        copy.books, copy.parts, copy.centres = self.books, self.parts, self.centres
        return copy


def recall(found: DataFrame, truth: DataFrame, k: int, parts: int, dim: int, rerank: int, total: int) -> DataFrame:
    """Per query the share of the exact k best that a search found, and the share of the vectors' bytes that it read.

    found, truth: (qid, id) with found's n_scored. Bytes: a code a scored row and a whole vector a re-ranked one, against all vectors.
    """
    per_query = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    hits = per_query.groupBy("qid").agg(F.count("hit").alias("hits"), F.count("*").alias("of"))
    scored = found.groupBy("qid").agg(F.max("n_scored").alias("n_scored"))
    read = (F.col("n_scored") * parts + F.least(F.lit(rerank), F.col("n_scored")) * 4 * dim) / (total * 4 * dim)
    return hits.join(scored, "qid").select("qid", "hits", "of", (F.col("hits") / F.col("of")).alias("recall"), read.alias("bytes_share"))
