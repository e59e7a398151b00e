"""Connected components of a table of links, by contraction within tasks and between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common

#: Edges that a task contracts at once.
HELD = 1 << 21
#: So few edges are contracted by one task to the end: rounds of small jobs take longer.
FEW = 1 << 18


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected with by the edges (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low, now = np.minimum(x, y), label.copy()
        np.minimum.at(now, x, low)
        np.minimum.at(now, y, low)
        while (jumped := now[now]).tobytes() != now.tobytes():
            now = jumped
        if (now == label).all():
            return label
        label = now


def _contracted(edges: DataFrame) -> DataFrame:
    """u, v: every node of a task's edges with the least node that these edges connect it to."""

    def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = forest(len(nodes), at[: len(u)], at[len(u) :])
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return nodes[moved], nodes[label[moved]]

    def run(batches):
        u = v = np.empty(0, np.int64)
        for batch in batches:
            u, v = (np.concatenate([x, batch.column(c).to_numpy()]) for c, x in ((0, u), (1, v)))
            if len(u) >= HELD:
                u, v = stars(u, v)
                if 2 * len(u) >= HELD:  # too many nodes to go on with
                    yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])
                    u = v = np.empty(0, np.int64)
        if len(u):
            u, v = stars(u, v)
            yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.select("u", "v").mapInArrow(common.returning(run), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of the links (a, b).

    A round first contracts the edges of each task to stars, without a shuffle, so that long chains become short.
    A node then has a root for each task that knew it; all these roots, and the node, are tied to the least of them.
    Both steps keep the components, and after a number of rounds logarithmic in the size only stars are
    left. When at most FEW edges are left, one task contracts them, and no round follows. Each round is written to the shared folder. Neighbourhoods are never gathered: a node meets as
    many rows as tasks, and a root only a minimum.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = common.materialize(edges, "stars")
    while True:
        if edges.count() <= FEW:
            edges = common.materialize(_contracted(edges.coalesce(1)), "stars")
            break
        if _stars(edges):
            break
        local = common.materialize(_contracted(edges), "stars")
        least = local.groupBy("u").agg(F.min("v").alias("m"))
        tied = local.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = common.materialize(tied.where("u != v").distinct(), "stars")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one node, and that to none."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("root"))
    )
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("root").alias("root")).where("out > 1 OR (out = 1 AND root = 1)").isEmpty()
