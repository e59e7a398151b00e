"""The lexical half of hybrid search: postings with BM25 weights, and rank fusion with the vector result.

Postings (term, id, how often, length of the text) of whole texts are stored by a hash of the term and sorted by
it, so a search reads the folders of its terms, and of those the row groups that hold them. A text's terms are counted where
it is read, and each posting is shuffled once, to its folder. What a weight needs beside them, the number of rows, the mean length and each term's document frequency, is kept per batch
and added up, so batches can be appended.

Defined cases: terms are runs of letters and digits of any script, lower-cased; null and empty messages have none and
are never found, but a row without a term counts as a row; a term that a query repeats counts once; rows score
0 or more, ties come in the order of ids; an unknown term adds nothing; rows of one id are one text (ids are unique).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOLDERS = 64
#: The columns of a posting.
STORED = "term string, id string, length long, tf long, folder int, batch int"
#: Words that a task counts at once (one text, if that has more).
COUNTED = 1 << 19
K1, B = 1.2, 0.75
#: The constant of reciprocal rank fusion.
RANK = 60


def terms(text: Column | str) -> Column:
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.filter(F.split(low, r"[^\p{L}\p{Nd}]+"), lambda x: x != "")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, id, length, tf: a row for each different term of each text (id, terms)."""
    for batch in batches:
        length = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(length)])
        flat, row = batch.column(1).flatten(), 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + COUNTED, side="right")) - 1)
            names = flat.slice(at[row], at[end] - at[row]).dictionary_encode()
            own = np.repeat(np.arange(end - row), length[row:end])
            pairs, tf = np.unique(own * max(len(names.dictionary), 1) + names.indices.to_numpy(), return_counts=True)
            own, code = np.divmod(pairs, max(len(names.dictionary), 1))
            columns = [names.dictionary.take(pa.array(code)), batch.column(0).take(pa.array(own + row)), pa.array(length[own + row]), pa.array(tf)]
            yield pa.record_batch(columns, ["term", "id", "length", "tf"])
            row = end


class Postings:
    """Stored postings below `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, df: DataFrame, batch: int) -> "Postings":
        """Add rows (id, message); a batch that is added again replaces its files."""
        rows = df.select(F.col("id").cast("string").alias("id"), terms("message").alias("terms"))
        placed = rows.mapInArrow(counted, "term string, id string, length long, tf long").withColumn("folder", self._folder(F.col("term")))
        ordered = placed.hint("rebalance", "folder").sortWithinPartitions("folder", "term").withColumn("batch", F.lit(batch))
        replacing = lambda w: w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        replacing(ordered.write).partitionBy("folder", "batch").parquet(f"{self.path}/postings")
        words = self.spark.read.schema(STORED).parquet(f"{self.path}/postings").where(F.col("batch") == batch).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
        size = words.withColumns({"rows": F.lit(df.count()), "batch": F.lit(batch)}).select(F.col("rows").cast("long").alias("rows"), "words", "batch")
        replacing(size.coalesce(1).write).partitionBy("batch").parquet(f"{self.path}/sizes")
        return self

    @staticmethod
    def _folder(term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")

    def scores(self, query: str) -> DataFrame:
        """id, score of every row with a term of the query."""
        asked = self.spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(terms("q"))).alias("term"))
        wanted = [(r["term"], r["folder"]) for r in asked.withColumn("folder", self._folder(F.col("term"))).collect()]
        size = self.spark.read.parquet(f"{self.path}/sizes").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words")).first()
        if not wanted:
            return self.spark.createDataFrame([], "id string, score double")
        hits = self.spark.read.schema(STORED).parquet(f"{self.path}/postings").where(
            F.col("folder").isin(sorted({f for _, f in wanted})) & F.col("term").isin([t for t, _ in wanted])
        )
        # rows of one id and length in a batch are one text; dealt out by id, so that the weights need no further shuffle
        hits = hits.repartition("id").groupBy("term", "id", "length", "batch").agg(F.sum("tf").alias("tf"))
        mean = F.lit(max(size["words"], 1) / max(size["rows"], 1))
        # counts are partial aggregates with one row a term
        seen = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = F.log(1 + (F.lit(float(size["rows"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
        weighted = hits.join(F.broadcast(seen), "term")  # no more rows than the query has terms
        return weighted.groupBy("id").agg(F.round(F.sum(idf * part), 9).alias("score"))

    def search(self, query: str, k: int = 20) -> DataFrame:
        """id, score: the k best rows."""
        return self.scores(query).orderBy(F.desc("score"), "id").limit(k)


def fuse(*ranked: DataFrame, k: int = 20) -> DataFrame:
    """id, score and the rank in each list: reciprocal rank fusion of short lists (id, rank)."""
    both = None
    for i, one in enumerate(ranked):
        own = one.select("id", F.lit(i).alias("list"), "rank")
        both = own if both is None else both.unionByName(own)
    ranks = [F.max(F.when(F.col("list") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(ranked))]
    out = both.groupBy("id").agg(F.sum(1 / (RANK + F.col("rank"))).alias("score"), *ranks)
    return out.orderBy(F.desc("score"), "id").limit(k)


def with_rank(best: DataFrame, *order: Column | str) -> DataFrame:
    """Adds the rank to a list of at most a few thousand rows."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
