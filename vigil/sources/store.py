"""Tables that are replaced as a whole: versioned folders and an append-only commit log.

A writer puts the new rows in a new version folder and then appends one row to the
commit log. Readers take the newest committed version, so they never see half a
table, and the version they read is not touched. The commit row also names its writer (a
stream's checkpoint, a pipeline) and that writer's batch number or cursor, which makes a
replayed batch recognisable and lets several writers take turns on one store.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("folder", T.StringType()),
        T.StructField("writer_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("committed_ms", T.LongType()),
    ]
)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


class SnapshotStore:
    """One writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType):
        self.spark = spark
        self.base = base.rstrip("/")
        self.schema = schema

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(COMMITS).parquet(f"{self.base}/commits")

    def ensure(self) -> "SnapshotStore":
        if not path_exists(self.spark, f"{self.base}/commits"):
            self._commit(self.spark.createDataFrame([], self.schema), 0, -1)
        return self

    def head(self) -> tuple[int, str, int]:
        """Version and folder of the newest commit, and the highest batch of any writer."""
        row = (
            self._commits()
            .agg(
                F.max("version").alias("version"),
                F.max_by("folder", "version").alias("folder"),
                F.max("batch_id").alias("batch_id"),
            )
            .first()
        )
        return row["version"], row["folder"], row["batch_id"]

    def read(self) -> DataFrame:
        _, folder, _ = self.head()
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/{folder}")

    def position(self, writer_id: str) -> int | None:
        """The highest batch or cursor that a writer has committed."""
        return self._commits().where(F.col("writer_id") == writer_id).agg(F.max("batch_id")).first()[0]

    def has_batch(self, batch_id: int, writer_id: str = "") -> bool:
        position = self.position(writer_id)
        return position is not None and position >= batch_id

    def replace(self, rows: DataFrame, batch_id: int = -1, writer_id: str = "") -> None:
        """Write `rows` as the next version; a failed earlier try is overwritten."""
        version, _, _ = self.head()
        self._commit(rows, version + 1, batch_id, writer_id)

    def mark(self, batch_id: int, writer_id: str = "") -> None:
        """Record that a batch is done and changed nothing."""
        version, folder, _ = self.head()
        self._log(version + 1, folder, batch_id, writer_id)

    def _commit(self, rows: DataFrame, version: int, batch_id: int, writer_id: str = "") -> None:
        folder = f"v={version}"
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(
            f"{self.base}/{folder}"
        )
        self._log(version, folder, batch_id, writer_id)

    def _log(self, version: int, folder: str, batch_id: int, writer_id: str) -> None:
        self.spark.createDataFrame(
            [(version, folder, writer_id, batch_id, int(time.time() * 1000))], COMMITS
        ).coalesce(1).write.mode("append").parquet(f"{self.base}/commits")
