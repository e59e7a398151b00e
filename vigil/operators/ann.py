"""Search that reads a part of the log table: folders by sign code, or cells with an exact bound."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import vectors as vx
from vigil.operators.search import RESULT, nearest, with_distance

MAX_CELLS = 4096


def _with_unit(df: DataFrame) -> DataFrame:
    """Adds the vector scaled to length one; rows without a usable vector drop out."""
    vec = df.where(vx.is_usable("embedding")).withColumn("_vec", array_to_vector("embedding"))
    return Normalizer(p=2.0, inputCol="_vec", outputCol="_unit").transform(vec).drop("_vec")


class SignIndex:
    """A log table laid out by the signs of some vector components, searched approximately.

    The code of a row says which of the first `bits` components are positive; rows lie in one folder
    per code. A search reads the folders of the `probes` codes that cost least to reach from the
    query: the sum of the absolute values of the components whose sign differs. It is an
    approximate operator whatever it finds; the exact one is `search.semantic_search`. New rows are
    appended batch by batch. Other filters can be given as a condition and reach the files.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int = 4):
        self.spark, self.path, self.bits = spark, path.rstrip("/"), bits

    def code(self, vector: Column | str = "embedding") -> Column:
        c = F.col(vector) if isinstance(vector, str) else vector
        terms = [F.when(F.get(c, F.lit(i)) > 0, F.lit(1 << i)).otherwise(0) for i in range(self.bits)]
        return sum(terms[1:], terms[0]).cast("int")

    def append(self, df: DataFrame, batch: int) -> "SignIndex":
        """Add the rows with a usable vector; a batch that is added again replaces its files."""
        rows = df.where(vx.is_usable("embedding")).withColumns({"code": self.code(), "batch": F.lit(batch)})
        rows.hint("rebalance", "code").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "code", "batch"
        ).parquet(self.path)
        return self

    def codes(self, query: list[float], probes: int) -> list[int]:
        """The codes to read, cheapest first."""
        x = [abs(float(v)) for v in query[: self.bits]]
        own = sum(1 << i for i in range(self.bits) if query[i] > 0)
        cost = lambda code: sum(x[i] for i in range(self.bits) if (code ^ own) >> i & 1)
        return sorted(range(1 << self.bits), key=lambda code: (cost(code), code))[:probes]

    def search(
        self, query: list[float], k: int = 20, probes: int = 4, condition: Column | None = None
    ) -> DataFrame:
        rows = self.spark.read.parquet(self.path).where(F.col("code").isin(self.codes(query, probes)))
        rows = rows if condition is None else rows.where(condition)
        best = nearest(with_distance(rows, query).select(*RESULT, "distance"), k)
        return best.withColumn("score", 1 - F.col("distance"))


@dataclass(frozen=True)
class Cell:
    number: int
    centre: np.ndarray
    radius: float
    rows: int


class CellIndex:
    """A log table laid out by vector cell, one folder per cell, searched exactly.

    Vectors of length one are clustered. For each cell the centre, the greatest distance
    of a member from it and the number of rows are stored. A search reads the cells
    nearest to the query; that gives a k-th distance. By the triangle inequality a cell
    can hold something nearer only if its centre is within that distance plus its radius,
    so only those cells are read besides. A large cell is many files, not one task.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        cells = spark.read.parquet(f"{path}/cells")
        if cells.count() > MAX_CELLS:
            raise ValueError(f"more than {MAX_CELLS} cells")
        stored = cells.collect()
        self.cells = [Cell(r["cell"], np.array(r["centre"]), r["radius"], r["n"]) for r in stored]

    @classmethod
    def build(
        cls, df: DataFrame, path: str, cells: int = 64, seed: int = 7
    ) -> "CellIndex":
        """Cluster all usable rows, then write them."""
        if cells > MAX_CELLS:
            raise ValueError(f"at most {MAX_CELLS} cells")
        spark = df.sparkSession
        unit = _with_unit(df)
        total = unit.count()
        model = KMeans(
            k=min(cells, max(2, total)), featuresCol="_unit", predictionCol="cell", maxIter=10, seed=seed
        ).fit(unit.select("_unit"))
        centres = spark.createDataFrame(
            [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
            "cell int, centre array<double>",
        )
        rows = model.transform(unit).drop("_unit")
        # gathers a cell in few files and splits a large cell over several tasks
        rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")

        # The rows are read back, so bound and folder agree whatever a retried task did.
        length = vx.norm("embedding")
        apart = F.sqrt(
            F.aggregate(
                F.zip_with("embedding", "centre", lambda x, c: F.struct(x.cast("double").alias("x"), c.alias("c"))),
                F.lit(0.0),
                lambda total, p: total + F.pow(p["x"] / F.col("_length") - p["c"], 2),
            )
        )
        members = spark.read.parquet(f"{path}/rows").select("cell", "embedding").join(centres, "cell")
        bounds = (
            members.withColumn("_length", length)
            .groupBy("cell")
            .agg(F.max(apart).alias("radius"), F.count(F.lit(1)).alias("n"))
        )
        bounds.join(centres, "cell").select("cell", "centre", "radius", "n").write.parquet(f"{path}/cells")
        return cls(spark, path)

    def search(
        self, query: list[float], k: int = 20, probes: int = 2, condition: Column | None = None
    ) -> DataFrame:
        """The exact k nearest rows, optionally among those that meet a condition."""
        unit = np.array(query, dtype=np.float64)
        unit = unit / np.linalg.norm(unit)
        apart = sorted((float(np.linalg.norm(unit - c.centre)), c.number, c) for c in self.cells)
        first, seen = [], 0
        for position, (_, number, cell) in enumerate(apart):
            if position >= probes and seen >= k:
                break
            first.append(number)
            seen += cell.rows
        best = self._nearest(first, query, k, condition)
        found = best.agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("kth")).first()
        # cosine distance d of unit vectors is a euclidean distance of sqrt(2 d)
        reach = np.sqrt(2 * max(found["kth"], 0.0)) if found["n"] >= k else np.inf
        more = [
            number for distance, number, cell in apart
            if number not in first and distance - cell.radius <= reach + 1e-6
        ]
        return self._nearest(first + more, query, k, condition) if more else best

    def _nearest(
        self, numbers: list[int], query: list[float], k: int, condition: Column | None
    ) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col("cell").isin(numbers))
        rows = rows if condition is None else rows.where(condition)
        best = nearest(with_distance(rows, query).select(*RESULT, "distance"), k)
        return best.withColumn("score", 1 - F.col("distance"))
