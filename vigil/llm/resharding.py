"""Resharding with the fewest bytes moved: a minimum-cost flow between old and new shards.

Old shards have sizes, new shards have capacities (equal by default, so the law is `bytes`). Each
old shard is dealt into blocks by hash; the sizes of the blocks, a bounded table, are all that
the driver sees. A flow from old to new shards, in which a byte that stays costs nothing and a
byte that moves costs one, says how many bytes go where. Blocks that lie within one part of the
flow move whole; only the few blocks at the borders of parts are cut, by running sums of
document sizes within the block, so a new shard misses its capacity by about one document for each
part. Slots are numbered per shard and block with offsets from the block counts. Nothing is
ever sorted over a whole shard. `rewrite` writes the files of the shards that gained or lost rows, texts and all:
rows of a block that moves whole find their shard by the block, only those of cut blocks are matched one by one,
so that a text is shuffled once, to its new file. `placed` reads the rows' places back from the files.

Defined cases: a null text has 0 bytes and the CRC of the empty text; null ids are placed like all
others; repeated rows are rows of their own, in a fixed order by id, CRC and size; a null old shard
counts as 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vigil.llm import common

#: Blocks of an old shard. Shards times blocks rows are collected.
BLOCKS = 512
ROW_BYTES = 16
#: Bytes of documents in a file of a shard, about.
FILE_BYTES = 32 << 20
#: The column of a shard's files that holds the slot.
SLOT = "__slot"


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """flow[i][j] of the cheapest way to send all supplies within the capacities; cost(i, j) per unit.

    Successive shortest augmenting paths over the residual graph, found with Bellman-Ford.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are too small")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    while any(left):
        far = float("inf")
        dist_old = [0 if x else far for x in left]
        dist_new, from_old, from_new = [far] * m, [-1] * m, [-1] * n
        changed = True
        while changed:
            changed = False
            for i in range(n):
                if dist_old[i] < far:
                    for j in range(m):
                        if dist_old[i] + price[i][j] < dist_new[j]:
                            dist_new[j], from_old[j], changed = dist_old[i] + price[i][j], i, True
            for j in range(m):
                if dist_new[j] < far:
                    for i in range(n):
                        if flow[i][j] and dist_new[j] - price[i][j] < dist_old[i]:
                            dist_old[i], from_new[i], changed = dist_new[j] - price[i][j], j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: dist_new[j])
        path, j = [], end
        while True:
            i = from_old[j]
            path.append((i, j, 1))
            if from_new[i] < 0:
                break
            path.append((i, from_new[i], -1))
            j = from_new[i]
        amount = min([left[i], room[end], *(flow[a][b] for a, b, sign in path if sign < 0)])
        for a, b, sign in path:
            flow[a][b] += sign * amount
        left[i] -= amount
        room[end] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _parts(flow_row: list[int], own: int) -> list[tuple[int, int, int]]:
    """(first byte, end byte, new shard) of an old shard; what stays comes first."""
    out, at = [], 0
    for j in sorted(range(len(flow_row)), key=lambda j: (j != own, j)):
        if flow_row[j]:
            out.append((at, at + flow_row[j], j))
            at += flow_row[j]
    return out


def _measured(id_col: str, text_col: str) -> list[Column]:
    """doc_id, size, text_crc32 of a document."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return [
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ]


def _old(old_shard: Column, shards: int) -> Column:
    return F.pmod(F.coalesce(old_shard.cast("long"), F.lit(0)), F.lit(shards)).cast("int").alias("old")


def _block() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BLOCKS)).cast("int")


def narrow(docs: DataFrame, old_shard: Column, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, old, block of every row."""
    return docs.select(*_measured(id_col, text_col), _old(old_shard, shards)).withColumn("block", _block())


def reshard(
    docs: DataFrame, old_shard: Column, shards: int = 40, capacities: list[int] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, old, shard, slot: the new place of every row."""
    spark = docs.sparkSession
    rows = common.materialize(narrow(docs, old_shard, shards, id_col, text_col), "reshard")
    sizes = rows.groupBy("old", "block").agg(F.sum("size").alias("bytes")).orderBy("old", "block").collect()
    supply = [0] * shards
    for r in sizes:
        supply[r["old"]] += r["bytes"]
    flow = min_cost_flow(supply, capacities or equal_capacities(sum(supply), shards), lambda i, j: int(i != j))
    parts = {s: _parts(flow[s], s) for s in range(shards) if supply[s]}
    plan, at = [], dict.fromkeys(parts, 0)
    for r in sizes:
        s, first, end = r["old"], at[r["old"]], at[r["old"]] + r["bytes"]
        at[s] = end
        whole = next((j for a, b, j in parts[s] if a <= first and end <= b), None)
        cuts = None if whole is not None else [(2 * b, j) for _, b, j in parts[s] if b > first]
        plan.append((s, r["block"], first, whole, cuts))
    blocks = spark.createDataFrame(
        plan, "old int, block int, first long, whole int, cuts array<struct<end2:long,shard:int>>"
    )
    # at most shards * BLOCKS rows
    placed = rows.join(F.broadcast(blocks), ["old", "block"])
    order = ("doc_id", "text_crc32", "size")
    in_block = Window.partitionBy("old", "block").orderBy(*order)
    whole = placed.where(F.col("whole").isNotNull()).withColumn("shard", F.col("whole"))
    cut = placed.where(F.col("whole").isNull())
    # the byte in the middle of the document decides (times two, so that it is an integer)
    middle2 = 2 * (F.col("first") + F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size")
    cut = cut.withColumn("middle2", middle2).withColumn(
        "shard", F.filter("cuts", lambda c: c["end2"] > F.col("middle2"))[0]["shard"]
    )
    keep = ("doc_id", "size", "text_crc32", "old", "block", "shard")
    moved = common.materialize(whole.select(*keep).unionByName(cut.select(*keep)), "reshard")
    counts = moved.groupBy("shard", "old", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "old", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # at most a row for each block and each cut
    numbered = moved.join(F.broadcast(offsets), ["shard", "old", "block"])
    slot = F.col("offset") + F.row_number().over(Window.partitionBy("shard", "old", "block").orderBy(*order)) - 1
    return numbered.withColumn("slot", slot.cast("long")).select("doc_id", "size", "text_crc32", "old", "shard", "slot")


def affected(moved: DataFrame) -> list[int]:
    """The shards that gained or lost rows."""
    changed = moved.where("old != shard").select(F.explode(F.array("old", "shard")).alias("shard"))
    return sorted(r["shard"] for r in changed.distinct().collect())


def rewrite(
    docs: DataFrame, moved: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", files: int | None = None,
    old_shard: Column | None = None, shards: int = 40,
) -> list[int]:
    """Write the documents of the affected shards and their slots to path/shard=N, about `files` files each; returns those shards.

    moved: of `reshard`. With its `old_shard` and `shards`, rows of blocks that have one new shard are not matched; without,
    and in the other blocks, rows are matched by id, size and CRC of the text, rows with equal ones by number.
    """
    touched = affected(moved)
    moved = moved.withColumn("block", _block())
    if files is None:
        total = moved.where(F.col("shard").isin(touched)).agg(F.sum("size")).first()[0] or 0
        files = max(1, -(-total // (FILE_BYTES * max(1, len(touched)))))
    same = ["doc_id", "size", "text_crc32"]
    # the rows of docs, as one column beside the others: its columns may have any name
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "shard"]).alias("row")
    rows = docs.select(*_measured(id_col, text_col), whole_row, *([] if old_shard is None else [_old(old_shard, shards)]))
    rows = rows.withColumn("block", _block())
    columns = ("row", *same, "old", "block", "shard")
    found = None
    if old_shard is not None:
        # at most shards * BLOCKS rows
        ways = moved.groupBy("old", "block").agg(F.min("shard").alias("shard"), F.max("shard").alias("other"))
        known = rows.join(F.broadcast(ways), ["old", "block"])
        found = known.where("shard = other").select(*columns)
        rows = known.where("shard != other").drop("shard", "other")
        moved_ = moved.join(F.broadcast(ways.where("shard != other").select("old", "block")), ["old", "block"])
        same += ["old"]
    else:
        moved_ = moved
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))).alias("l")
    places = moved_.withColumn("n", F.row_number().over(Window.partitionBy(*same).orderBy("shard", "slot"))).alias("r")
    match = " AND ".join(f"l.{c} <=> r.{c}" for c in [*same, "n"])
    matched = numbered.join(places, F.expr(match)).select("row", *[f"r.{c}" for c in columns[1:]])
    found = (matched if found is None else found.unionByName(matched)).where(F.col("shard").isin(touched))
    # a block's rows of one shard have consecutive slots; they stay together, so texts are shuffled and sorted once
    group = ["shard", "file", "old", "block"]
    dealt = found.withColumn("file", F.pmod("block", F.lit(files))).repartition(max(1, len(touched) * files), "shard", "file")
    firsts = moved.groupBy("shard", "old", "block").agg(F.min("slot").alias("first"))
    at = F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "text_crc32", "size"))
    slots = dealt.withColumn("at", at).join(F.broadcast(firsts), ["shard", "old", "block"])
    out = slots.select("shard", "row.*", (F.col("first") + F.col("at") - 1).alias(SLOT))
    out.write.partitionBy("shard").parquet(path)
    return touched


def placed(docs: DataFrame, moved: DataFrame, path: str, touched: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row: of the shards `touched` from the files of `rewrite`, else from `moved`."""
    fields = [f for f in docs.schema.fields if f.name != "shard"] + [T.StructField(SLOT, T.LongType()), T.StructField("shard", T.IntegerType())]
    files = docs.sparkSession.read.schema(T.StructType(fields)).parquet(path)
    back = files.select(*_measured(id_col, text_col), "shard", F.col(SLOT).alias("slot"))
    return back.unionByName(moved.where(~F.col("shard").isin(touched)).select(*back.columns))
