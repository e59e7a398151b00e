"""From raw to training-ready documents: stages over the `documents` table.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. `run` writes what a
stage returns to the shared folder as Parquet and reads it back for the next one. All stages but the
last return the columns of `documents`; the last adds token ids.

Defined cases, over all stages: a null text, and one without a letter, goes in the first stage. Rows are known by
their id and their text together: of rows with equal ids and other texts each is judged by its own text, rows
without an id stay unless a stage rejects their text, and a row that is repeated whole is kept or dropped with
all its copies. `n_chars` follows a text that the line stage cuts, where the table has that column. An empty table
gives an empty result with the same columns. Further columns, whatever their names, are passed on (the last
stage replaces columns named like those it adds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import decontaminate, language_id, line_dedup, minhash_dedup, sentencepiece_codec
from vigil.llm.common import materialize, table
from vigil.llm.queries import model_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: no letters, or far from every language."""
    return language_id.keep(docs, language_id.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go out of the texts; a document of which nothing is left goes."""
    changed = F.col("__removed") > 0
    kept = line_dedup.dedup(docs).where(~(changed & (F.col("text") == "")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return kept.select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    gone = minhash_dedup.near_duplicates(docs).where("NOT kept")
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__gone_text")).distinct()
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col("__gone")) & (own == F.col("__gone_text")), "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark items in them go."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, their number, and whether they decode to the text."""
    return sentencepiece_codec.tokenised(docs, model_path())


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("minhash_dedup", near_duplicates),
    ("decontaminate", benchmark),
    ("sentencepiece", tokens),
]
#: SQL has no SentencePiece; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
