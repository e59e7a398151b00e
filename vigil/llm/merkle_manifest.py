"""A Merkle manifest of a dataset: one tree per source, one tree over their roots, a proof for every row.

A row's leaf is the hash of its length-prefixed columns. Per source the leaves stand in the order of their
ids. A level is made by a slot pivot: conditional aggregates spread a parent's children into one column
per slot, the concatenated columns are hashed, and leaving the own slot's column out gives a child's
siblings. So each level is one aggregation whose groups have `fanout` rows, however large a source is.
Proofs are made from the top down: a run of siblings meets its parent's proof once, and is then spread
over its slots, so no row is joined to its siblings. The numbers within a source come from one range sort:
rows are counted per file of the sorted table and the counts of earlier files are added.

Defined cases: a null column is `-`, so it differs from an empty one; a row with a null id has a leaf and stands
first in its source; rows with equal ids stand in the order of their leaves, equal rows side by side; a
source with one row has that row's leaf as its root, and an only source's root is the root; the null source
comes first and differs from the empty one; an empty table has no rows and no root. Texts of any
length are hashed whole. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm import common

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def field(column: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def leaves(docs: DataFrame, id_col: str = "doc_id", part_col: str = "source", columns: Sequence[str] = COLUMNS,
           tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """part, id, h, forged: the leaf of every row, and where `when` holds that of the row with replaced columns."""
    read = [F.col(f"`{c}`") for c in columns]
    forged = F.lit(None).cast("string")
    if tampered:
        forged = leaf_hash([tampered.get(c, F.col(f"`{c}`")) for c in columns])
        forged = F.when(when, forged) if when is not None else forged
    # one name for every source that also sorts like it: null first, then by bytes
    part = F.coalesce(F.concat(F.lit("s"), F.col(f"`{part_col}`").cast("string")), F.lit(""))
    return docs.select(part.alias("part"), F.col(f"`{id_col}`").alias("id"), leaf_hash(read).alias("h"), forged.alias("forged"))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds idx, the place of a row within its part, and n, the rows of the part."""
    ranged = rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    # the id names the task above and the place in its sorted output below
    ranged = common.materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle")
    ranged = ranged.withColumn("task", F.shiftright("at", 33))
    counts = ranged.groupBy("part", "task").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    earlier = Window.partitionBy("part").orderBy("task")
    counts = counts.select(
        "part", "task", (F.sum("here").over(earlier) - F.col("here") - F.col("first")).alias("shift"),
        F.sum("here").over(Window.partitionBy("part")).alias("n"),
    )
    return ranged.join(counts, ["part", "task"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def _pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """part, idx, n, h of the parents, and their children as columns s0, s1, ... by slot."""
    child = F.struct(*[F.col(c) for c in nodes.columns if c not in ("part", "idx", "n")])
    parent = F.call_function("div", F.col("idx"), F.lit(fanout)).alias("idx")
    slots = [F.max(F.when(F.col("idx") % fanout == k, child)).alias(f"s{k}") for k in range(fanout)]
    runs = nodes.where("n > 1").groupBy("part", parent).agg(F.ceil(F.max("n") / fanout).alias("n"), *slots)
    return runs.withColumn("h", digest(F.concat_ws("", *[F.col(f"s{k}.h") for k in range(fanout)])))


def tree(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels from part, idx, n, h (and more columns of the lowest nodes) up, each written once."""
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level = levels[-1] if len(levels) == 1 else levels[-1].select("part", "idx", "n", "h")
        levels.append(common.materialize(_pivot(level, fanout), "merkle"))
        most = -(-most // fanout)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """part, h: the root of every part."""
    found = [level.where("n = 1").select("part", "h") for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _spread(runs: DataFrame, fanout: int, kept: Sequence[str]) -> DataFrame:
    """The children of runs that hold their own proof: idx, the child's columns, the proof with the siblings in front."""
    def child(k: int) -> Column:
        beside = lambda ks: F.concat_ws("", *[F.col(f"s{j}.h") for j in ks])
        step = F.struct(beside(range(k)).alias("left"), beside(range(k + 1, fanout)).alias("right"))
        return F.when(F.col(f"s{k}").isNotNull(), F.struct(
            (F.col("idx") * fanout + k).alias("idx"), F.col(f"s{k}").alias("node"), F.concat(F.array(step), "proof").alias("proof"),
        ))

    some = F.filter(F.array(*[child(k) for k in range(fanout)]), lambda x: x.isNotNull())
    return runs.select("part", *kept, F.explode(some).alias("x")).select("part", *kept, "x.idx", "x.node.*", "x.proof")


def proofs(levels: list[DataFrame], above: DataFrame | None = None, fanout: int = FANOUT) -> DataFrame:
    """The lowest nodes (part and their own columns) with `proof`, the (left, right) siblings of each level from below.

    above: part, proof and further columns that hold for a whole part; the proof of its root in a tree over the parts.
    """
    if above is None:
        above = levels[0].select("part").distinct().withColumn("proof", F.array().cast("array<struct<left:string,right:string>>"))
    kept = [c for c in above.columns if c not in ("part", "proof")]
    ups = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        own = [c for c in level.columns if c not in ("part", "idx", "n") and not (depth and c != "h")]
        # the root of a part takes the part's proof; every other node was spread from its run
        roots = level.where("n = 1").select("part", "idx", *own).join(above, "part").select("part", *kept, "idx", *own, "proof")
        nodes = roots if ups is None else roots.unionByName(ups)
        if not depth:
            return nodes
        below = [f"s{k}" for k in range(fanout)]
        runs = level.select("part", "idx", *below).join(nodes.drop("h"), ["part", "idx"])
        ups = _spread(runs, fanout, kept)


def folded(start: Column, proof: Column | str) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, start, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def proof_digest(proof: Column | str) -> Column:
    return digest(F.concat_ws("", F.transform(proof, lambda step: F.concat(step["left"], step["right"]))))


def manifest(leaf_rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every leaf (part, id, h, forged) with its proof up to the root, its part's root `subroot`, and `root`."""
    levels = tree(numbered(common.materialize(leaf_rows, "merkle"), ["id", "h"]), fanout)
    parts = tops(levels).select(F.lit("").alias("part"), F.col("part").alias("of"), "h")
    upper = tree(numbered(parts, ["of"]), fanout)
    root = tops(upper).select("part", F.array().cast("array<struct<left:string,right:string>>").alias("proof"), F.col("h").alias("root"))
    of_part = proofs(upper, root, fanout).select(F.col("of").alias("part"), "proof", F.col("h").alias("subroot"), "root")
    return proofs(levels, common.materialize(of_part, "merkle"), fanout)


def audit(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of a documents table.

    Where 5 divides the CRC-32 of the decimal id, the check folds a row whose text has been lower-cased.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = manifest(leaves(docs, tampered={"text": ascii_lower(F.col("text"))}, when=hit), fanout)
    out = found.select(
        F.col("id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", proof_digest("proof").alias("proof_sha256"),
        folded(F.coalesce("forged", "h"), "proof").alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
