"""Embedders: a function `(df, text_column, out_column) -> df` adding `array<float>`."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import text as tx
from vigil.functions import vectors as vx
from vigil.schema import DEFAULT_DIM

Embedder = Callable[[DataFrame, str, str], DataFrame]
#: Words that the hash embedder counts at once (one text, if that has more).
COUNTED = 1 << 19


def hash_embedder(dim: int = DEFAULT_DIM) -> Embedder:
    """Word counts in `dim` slots, scaled to length one.

    A word's slot is the number in the first eight hexadecimal digits of its MD5, modulo `dim`. The different words
    of a batch are hashed once, and a batch is counted in pieces of COUNTED words.
    """

    @F.arrow_udf("array<float>")
    def counted(words: pa.Array) -> pa.Array:
        length = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(length)])
        flat, row, out = words.flatten(), 0, np.zeros((len(words), dim), np.float32)
        while row < len(words):
            end = max(row + 1, int(np.searchsorted(at, at[row] + COUNTED, side="right")) - 1)
            names = flat.slice(at[row], at[end] - at[row]).dictionary_encode()
            slots = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in names.dictionary.to_pylist()]
            slot = np.array(slots, np.int64)[names.indices.to_numpy()]
            own = np.repeat(np.arange(end - row), length[row:end])
            counts = np.bincount(own * dim + slot, minlength=(end - row) * dim).reshape(-1, dim).astype(np.float64)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            out[row:end] = counts / np.where(norm > 0, norm, 1)
            row = end
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))

    def apply(df: DataFrame, text_column: str, out_column: str) -> DataFrame:
        words = F.filter(F.split(F.lower(F.coalesce(text_column, F.lit(""))), r"\s+"), lambda w: w != "")
        return df.withColumn(out_column, counted(words))

    return apply


def model_embedder(
    load: Callable[[], Callable[[list[str]], list[list[float]]]], cap: int | None = None, batch_size: int = 50,
    chunk: int | None = None,
) -> Embedder:
    """Wrap a model. `load` runs once per worker and returns `encode(texts) -> vectors`.

    Whole texts are embedded. For a model with an input limit, `chunk` is the number of characters it takes:
    it gets all pieces of a text, and their vectors are averaged; a text with a piece that fails gets
    an empty vector. `cap` drops what lies behind so many characters. A call gets at
    most `batch_size` texts or pieces. When a call fails, its texts are tried one by one; a text that
    fails alone gets an empty vector, and the quality filter moves its row to the rejects.
    """

    def attempt(model, texts: list[str]) -> list[list[float]]:
        try:
            return list(model(texts))
        except Exception:  # a failed call is data here, not an error of the job
            return [[]] if len(texts) == 1 else [v for t in texts for v in attempt(model, [t])]

    def vectors(model, texts: list[str]) -> list[list[float]]:
        return [v for i in range(0, len(texts), batch_size) for v in attempt(model, texts[i : i + batch_size])]

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(vectors(model, [t[:cap] for t in batch.fillna("")]))

    @F.pandas_udf("array<array<float>>")
    def encode_pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            texts = [t[:cap] for t in batch.fillna("")]
            pieces = [[t[i : i + chunk] for i in range(0, len(t), chunk)] or [""] for t in texts]
            found = iter(vectors(model, [x for p in pieces for x in p]))
            own = [[next(found) for _ in p] for p in pieces]
            yield pd.Series([v if all(map(len, v)) else [] for v in own])

    def apply(df: DataFrame, text_column: str, out_column: str) -> DataFrame:
        if chunk is None:
            return df.withColumn(out_column, encode(F.col(text_column)))
        pieces = df.withColumn("_pieces", encode_pieces(F.col(text_column)))
        return pieces.withColumn(out_column, vx.mean_pool("_pieces").cast("array<float>")).drop("_pieces")

    return apply


def embed(
    df: DataFrame, embedder: Embedder, message: str = "message", out: str = "embedding"
) -> DataFrame:
    """Embed the cleaned text, all of it; the message column keeps its raw form."""
    prepared = df.withColumn("embed_text", tx.strip_ansi(message))
    return embedder(prepared, "embed_text", out)
