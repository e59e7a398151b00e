"""Integer k-means by an incremental distance matrix.

Vectors become exact integers. Beside each vector its dot products with all centroids are stored. A round
changes them only by the components of the centroids that changed: dot += x[c] * delta[c] over the
nonzero c of a centroid's delta; the squared distance |x|^2 - 2 x.c + |c|^2 and its least centroid
follow from them, without a product with whole centroids. Every round is written as a table, which cuts
the lineage, and the one before it is deleted. What passes the driver is the centroids and the sums per centroid.

Distances are exact integers. While components stay within 2 ** 27 every sum fits in 64 bits; if any is
larger, vectors and dot products are held as decimal strings and computed with unbounded integers,
with the same result; a squared distance or an inertia beyond 64 bits is then null.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no
part; fewer vectors than centroids make fewer centroids; a vector with a null id takes part but starts no
centroid; rows with equal ids are vectors of their own; ties go to the smaller centroid; a centroid without
vectors stays where it is; an empty table gives an empty result. Only id and vector are read.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components of greater size are computed with unbounded integers.
SAFE = 1 << 27
LIMB = 10**28


def usable(embedding: str, dimensions: int):
    vector = F.col(embedding)
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & whole, F.lit(False))


def _integers(column: pa.Array, wide: bool, rows: int) -> np.ndarray:
    flat = column.flatten()
    if wide:
        return np.array([int(x) for x in flat.to_pylist()], dtype=object).reshape(rows, -1)
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _lists(values: np.ndarray, wide: bool) -> pa.Array:
    rows, width = values.shape
    flat = pa.array([str(x) for x in values.ravel()], pa.string()) if wide else pa.array(values.ravel().astype(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), flat)


def _array(rows: list[list[int]], wide: bool) -> np.ndarray:
    return np.array(rows, dtype=object if wide else np.int64)


def _scaled(rows: DataFrame, scale: int, wide: bool) -> DataFrame:
    """id, v: the vectors as integers."""
    kind = "string" if wide else "long"
    if not wide:
        return rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))

    def run(batches):
        for batch in batches:
            whole = [[str(math.floor(x * scale)) for x in v] for v in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(whole, pa.list_(pa.string()))], ["id", "v"])

    return rows.mapInArrow(run, f"id long, v array<{kind}>")


def _updated(table: DataFrame, delta: list[list[int]], squares: list[int], wide: bool) -> DataFrame:
    """The table (id, v, dots) with dots moved by the centroids' changes, and the nearest centroid of each vector."""
    kind = "string" if wide else "long"
    moved = [([c for c, x in enumerate(row) if x], [x for x in row if x]) for row in delta]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, dots = (_integers(batch.column(c), wide, batch.num_rows) for c in (1, 2))
            dots = dots.copy()
            for k, (at, by) in enumerate(moved):
                if at:
                    dots[:, k] += v[:, at] @ _array(by, wide)
            distance = (v * v).sum(axis=1)[:, None] - 2 * dots + _array(squares, wide)[None, :]
            nearest = np.array([min(range(len(d)), key=d.__getitem__) for d in distance.tolist()]) if wide else distance.argmin(axis=1)
            best = distance[np.arange(len(v)), nearest]
            best = pa.array([int(x) if x < 2**63 else None for x in best], pa.int64()) if wide else pa.array(best)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), _lists(dots, wide), pa.array(nearest.astype(np.int32)), best],
                ["id", "v", "dots", "cluster", "distance"],
            )

    return table.select("id", "v", "dots").mapInArrow(run, f"id long, v array<{kind}>, dots array<{kind}>, cluster int, distance long")


def _sums(table: DataFrame, wide: bool) -> dict[int, tuple[int, list[int]]]:
    """Per centroid the number of its vectors and their sum; a task shuffles one row a centroid and component."""

    def run(batches):
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                cluster, v = batch.column(0).to_numpy(), _integers(batch.column(1), wide, batch.num_rows)
                for k in np.unique(cluster).tolist():
                    mine = v[cluster == k]
                    count[k] = count.get(k, 0) + len(mine)
                    # unbounded integers, as sums over all vectors may pass 64 bits
                    total[k] = total.get(k, 0) + mine.sum(axis=0).astype(object)
        # two limbs of each sum, since decimals end at 38 digits
        rows = [(k, c, *divmod(int(x), LIMB)) for k in count for c, x in enumerate(total[k])]
        rows += [(k, -1, 0, n) for k, n in count.items()]
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.decimal128(38, 0))
        yield pa.record_batch([pa.array([Decimal(r[i]) if i > 1 else r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                              ["cluster", "at", "high", "low"])

    parts = table.select("cluster", "v").mapInArrow(run, "cluster int, at int, high decimal(38,0), low decimal(38,0)")
    summed = parts.groupBy("cluster", "at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    sums = {(r["cluster"], r["at"]): int(r["high"]) * LIMB + int(r["low"]) for r in summed}
    return {k: (n, [sums[k, c] for c in range(sum(1 for j, _ in sums if j == k) - 1)]) for (k, at), n in sums.items() if at == -1}


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose seeded id has the least hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.where("id IS NOT NULL").orderBy(key, F.col("v")).limit(clusters).select("v").collect()
    return [[int(x) for x in r["v"]] for r in rows]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
            seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(id, v, dots, cluster, distance) of the vectors, and the final centroids."""
    kept = vectors.where(usable(f"`{vector_col}`", dimensions)).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    )
    largest = kept.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    wide = largest * scale >= SAFE
    base = common.materialize(_scaled(kept, scale, wide), "vectors")
    centroids = first_centroids(base, clusters, seed)
    kind = "string" if wide else "long"
    none = F.array_repeat(F.lit("0" if wide else 0).cast(kind), len(centroids))
    table, delta = base.withColumn("dots", none), centroids
    if not centroids:
        return table.select("id", "v", "dots", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    for step in range(rounds + 1):
        squares = [sum(x * x for x in c) for c in centroids]
        fresh = common.materialize(_updated(table, delta, squares, wide), "distances")
        common.discard(table)
        table = fresh
        if step < rounds:
            sums = _sums(table, wide)
            moved = [[t // sums[k][0] for t in sums[k][1]] if k in sums else c for k, c in enumerate(centroids)]
            delta = [[b - a for a, b in zip(old, new)] for old, new in zip(centroids, moved)]
            centroids = moved
    return table, centroids


def report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that takes part."""
    table, centroids = cluster(vectors, **options)
    if not centroids:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    # one row a centroid
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    inertia = {r["cluster"]: r["s"] for r in table.groupBy("cluster").agg(total.alias("s")).collect()}
    whole = None if None in inertia.values() else int(sum(inertia.values()))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    in_long = lambda x: int(x) if x is not None and x < 2**63 else None
    return table.select(
        F.col("id").alias("vec_id"), "cluster", "distance",
        pick([in_long(inertia.get(k)) for k in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(in_long(whole)).cast("long").alias("inertia"), pick(names, "string").alias("centroid_sha256"),
    )
