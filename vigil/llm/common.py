"""Helpers of the operators here: tables, intermediate results, Arrow columns."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import materialize, shared_dir

__all__ = ["materialize", "shared_dir", "table", "id_text", "text_key", "bytes_of", "slices", "discard", "bounded", "returning"]

#: The setting, and its value in a session that has not chosen one.
_BATCH_BYTES, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, whatever else the table holds."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )


def text_key() -> Column:
    """Tells rows apart that carry one doc_id with different texts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def discard(df: DataFrame) -> None:
    """Delete the files of a `materialize`d table that nothing will read any more."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def bounded(df: DataFrame, size: str = "8m") -> DataFrame:
    """`df`, in a session whose record batches for Python are bounded by bytes: rows here hold whole texts and sets.

    Without that ten thousand rows make a batch, held once by the JVM and once by the worker. A session that has
    set a size of its own keeps it.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES) == DEFAULT_BATCH:
        conf.set(_BATCH_BYTES, size)
    return df


def returning(run: Callable, after: Callable[[], None] = lambda: None) -> Callable:
    """A function over batches that gives its memory back at the end of a partition, as workers live on for other stages."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            after()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return whole


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a whole string column and where each row begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about `size` bytes together (one row, if that is longer): first, end, bytes, offsets."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
