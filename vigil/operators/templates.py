"""Message templates learned from the messages: which words are fixed, and where others vary.

Messages with the same number of words share a tree. Its first `depth` levels follow the words from the left: a
word has a branch of its own if enough of the node's messages have it there, all other words share the branch of
the wildcard. Within a leaf every further position is judged alike: words that enough of the leaf's messages
have stay, others become the wildcard. Nothing is assumed about what a variable looks like.

All that is learned are counts: of prefixes (`prefixes`), which are added up over batches, and of words by leaf
and position. The tree keeps only words with a branch of their own, at most 1 / share a node, so it is broadcast, and
texts are read again where they are needed instead of being written: the table must give the same rows each time.

A template has its leaf's path in front, so a leaf's templates are its own. Leaves of up to `TASK_WORDS` words and
`TASK_ROWS` messages are whole in a task: their texts are shuffled once, and rows of the result leave the task. Larger leaves may hold any part of the
table, so their texts stay where they are read: two bytes a word are shuffled instead, to find the few words that
can be fixed (`frequent`); these are then counted exactly, by partial aggregates, and broadcast.

Defined cases: null messages take no part; an empty message, or one of white space, is one empty word; runs of
white space count as one; leaves with one message keep it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.session import materialize

WILDCARD = "<*>"
#: Levels that follow the words, one part of a node's messages that keeps a word, and least messages that do (if there are so many).
DEPTH, PARTS, LEAST = 2, 16, 2
#: Words that a task counts, about, and messages of a leaf that it takes; a leaf with more is counted by several tasks.
TASK_WORDS, TASK_ROWS = 1 << 21, 1 << 14
#: Messages and positions of a large leaf that are counted together, at least and at most.
PART_ROWS, PART_POSITIONS = 1 << 10, 1 << 10
#: Values that a word is reduced to where only the frequent ones are looked for.
MARKS = 1 << 16
#: Rows up to which words of large leaves are broadcast.
BROADCAST_ROWS = 1 << 20
#: Words that are judged at once (one leaf, if that has more).
JUDGED = 1 << 19
SPACES = " \t\n\x0b\f\r"


def words(message: Column | str) -> Column:
    return F.split(F.trim(F.col(message) if isinstance(message, str) else message, F.lit(SPACES)), r"[ \t\n\x0B\f\r]+")


def _fixed(n: str, total: str) -> Column:
    return (F.col(n) >= F.least(F.lit(LEAST), F.col(total))) & (F.col(n) * PARTS >= F.col(total))


def shapes(df: DataFrame) -> DataFrame:
    """Messages of a group with their words, how often and when they occur; equal ones meet where they are counted."""
    # generated, since conditions on a plain column would be pushed down and split the message again, each of them
    split = F.explode(F.array(words("message"))).alias("words")
    return df.where("message IS NOT NULL").select(
        "log_group", F.lit(1).cast("long").alias("n"), F.col("ts_ms").alias("first_ts_ms"), F.col("ts_ms").alias("last_ts_ms"), split
    )


def prefixes(shaped: DataFrame, depth: int = DEPTH) -> DataFrame:
    """length, prefix, n: the counts that the tree's levels follow from; of several batches they are added up."""
    return shaped.groupBy(F.size("words").alias("length"), F.slice("words", 1, depth).alias("prefix")).agg(F.sum("n").alias("n"))


def merge(*counts: DataFrame) -> DataFrame:
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out.groupBy("length", "prefix").agg(F.sum("n").alias("n"))


def _follow(rows: DataFrame, tree: list[DataFrame], prefix: str) -> DataFrame:
    """The rows with the path that their prefix takes."""
    rows = rows.withColumn("path", F.array().cast("array<string>"))
    for level, own in enumerate(tree):
        word = F.get(prefix, F.lit(level))
        branch = F.when(word.isNull(), F.col("path")).otherwise(
            F.concat("path", F.array(F.when(F.array_contains("own", word), word).otherwise(WILDCARD)))
        )
        # a few rows for each length; lengths are few, since their sum is at most the number of words
        rows = rows.join(F.broadcast(own), ["length", "path"], "left").withColumn("path", branch).drop("own")
    return rows


def branches(counts: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """For each level length, path, own: the words with a branch of their own below a node, from the merged counts."""
    tree = []
    for level in range(depth):
        found = _follow(counts.where(F.col("length") > level), tree, "prefix").withColumn("word", F.get("prefix", F.lit(level)))
        seen = found.groupBy("length", "path", "word").agg(F.sum("n").alias("here"))
        total = found.groupBy("length", "path").agg(F.sum("n").alias("total"))
        judged = seen.join(F.broadcast(total), ["length", "path"]).where(_fixed("here", "total"))
        tree.append(materialize(judged.groupBy("length", "path").agg(F.collect_set("word").alias("own")), "tree"))
    return tree


def paths(counts: DataFrame, depth: int = DEPTH, tree: list[DataFrame] | None = None) -> DataFrame:
    """length, prefix, n, path: the branch that each prefix takes, wildcards in it, from the merged counts."""
    return _follow(counts, branches(counts, depth) if tree is None else tree, "prefix").select("length", "prefix", "n", "path")


def assign(shaped: DataFrame, tree: list[DataFrame]) -> DataFrame:
    """The shapes with the leaf they fall in."""
    return _follow(shaped.withColumn("length", F.size("words")), tree, "words")


def _mark(word: Column) -> Column:
    return (F.pmod(F.xxhash64(word), F.lit(MARKS)) - MARKS // 2).cast("short")


def frequent(rows: DataFrame, large: DataFrame) -> DataFrame:
    """leaf, pos, mark: of each word that stays, and of few others. rows: leaf, parts, n, rest of the messages of large leaves.

    A leaf's messages are dealt out to parts. A word that has one share of the leaf has it of one part at least.
    """
    tasks = large.agg(F.ceil(F.sum(F.col("own") * F.col("total")) / TASK_WORDS).cast("int")).first()[0]
    part = F.pmod(F.xxhash64("rest", "log_group", "first_ts_ms"), F.col("parts"))
    marks = rows.select("leaf", "n", part.alias("part"), F.transform("rest", _mark).alias("marks"))
    blocks = marks.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(marks) - 1) div {PART_POSITIONS} AS int)"))))
    blocks = blocks.withColumn("marks", F.slice("marks", F.col("block") * PART_POSITIONS + 1, F.lit(PART_POSITIONS)))
    dealt = blocks.repartition(max(tasks, 1), "leaf", "part", "block").select("leaf", "part", "block", "n", F.posexplode("marks").alias("at", "mark"))
    counted = dealt.groupBy("leaf", "part", "block", "at", "mark").agg(F.sum("n").alias("here")).join(F.broadcast(large.select("leaf", "parts", "total")), "leaf")
    enough = (F.col("here") * PARTS * F.col("parts") >= F.col("total")) & ((F.col("parts") > 1) | (F.col("here") >= LEAST))
    return counted.where(enough).select("leaf", (F.col("block") * PART_POSITIONS + F.col("at")).alias("pos"), "mark").distinct()


def _at_hand(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fixed_words(leaves: DataFrame, large: DataFrame, depth: int = DEPTH) -> DataFrame:
    """length, path, kept: for each position after the path the words that stay, of large leaves."""
    rows = leaves.join(F.broadcast(large), ["length", "path"]).withColumn("rest", F.expr(f"slice(words, {depth + 1}, length)"))
    marked = materialize(frequent(rows, large), "marks")
    seen = rows.select("leaf", "n", F.posexplode("rest").alias("pos", "word")).withColumn("mark", _mark(F.col("word")))
    counted = seen.join(_at_hand(marked), ["leaf", "pos", "mark"]).groupBy("leaf", "pos", "word").agg(F.sum("n").alias("here"))
    stay = counted.join(F.broadcast(large.select("leaf", "total")), "leaf").where(_fixed("here", "total")).select("leaf", "pos", "word")
    # every position has a row, if only with no words
    every = large.select("leaf", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("pos"), F.lit(None).cast("string").alias("word"))
    stay = stay.unionByName(every).groupBy("leaf", "pos").agg(F.collect_set("word").alias("stay"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "stay")))
    kept = stay.groupBy("leaf").agg(F.transform(listed, lambda x: x["stay"]).alias("kept"))
    return kept.join(F.broadcast(large.select("leaf", "length", "path")), "leaf").drop("leaf")


def labelled(found: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The messages with their template and its number of wildcards. found: of leaves, with the words that stay (kept)."""
    stays = lambda word, i: F.array_contains(F.get("kept", i - depth), word)
    word = lambda w, i: F.when(i < depth, F.get("path", i)).when(stays(w, i), w).otherwise(WILDCARD)
    parts = F.transform("words", word)
    return found.withColumn("parts", parts).select(
        "log_group", "n", "first_ts_ms", "last_ts_ms", F.array_join("parts", " ").alias("template"),
        F.size(F.filter("parts", lambda w: w == WILDCARD)).cast("long").alias("n_variables"),
    )


def summed(rows: DataFrame) -> DataFrame:
    per_group = rows.groupBy("template", "n_variables", "log_group").agg(
        F.sum("n").alias("n"), F.min("first_ts_ms").alias("first_ts_ms"), F.max("last_ts_ms").alias("last_ts_ms")
    )
    return per_group.groupBy("template", "n_variables").agg(
        F.sum("n").alias("n"), F.min("first_ts_ms").alias("first_ts_ms"), F.max("last_ts_ms").alias("last_ts_ms"),
        F.count(F.lit(1)).alias("n_groups"), F.max_by("log_group", F.struct("n", "log_group")).alias("main_group"),
    )


def _begins(rows: pa.Table) -> np.ndarray:
    """Where a leaf begins in rows that have the leaves one after another."""
    length, head = rows["length"].to_numpy(), rows["head"].combine_chunks()
    other = pc.not_equal(head.slice(1), head.slice(0, len(head) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(other | (length[1:] != length[:-1])) + 1])


def _judged(rows: pa.Table, begins: np.ndarray) -> pa.Table:
    """What `labelled` and `summed` return, of whole leaves."""
    size, n = rows["length"].to_numpy().astype(np.int64), rows["n"].to_numpy()
    leaf = np.repeat(np.arange(len(begins)), np.diff([*begins, len(size)]))
    total, at = np.add.reduceat(n, begins)[leaf], np.concatenate([[0], np.cumsum(size)])
    flat = pc.split_pattern(rows["text"].combine_chunks(), " ").flatten()
    # a cell is a position of a leaf
    cell = np.repeat(np.concatenate([[0], np.cumsum(size[begins])])[leaf] - at[:-1], size) + np.arange(at[-1])
    names = flat.dictionary_encode()
    _, which = np.unique(cell * len(names.dictionary) + names.indices.to_numpy(), return_inverse=True)
    here, total = np.bincount(which, np.repeat(n, size))[which], np.repeat(total, size)
    kept = pc.if_else(pa.array((here >= np.minimum(LEAST, total)) & (here * PARTS >= total)), flat, pa.scalar(WILDCARD, flat.type))
    wild = np.add.reduceat(pc.equal(kept, WILDCARD).to_numpy(zero_copy_only=False).astype(np.int64), at[:-1])
    template = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at), kept), " ").dictionary_encode()
    code = template.indices.to_numpy()
    per_group = rows.select(["log_group", "n", "first_ts_ms", "last_ts_ms"]).append_column("code", pa.array(code)).group_by(["code", "log_group"]).aggregate(
        [("n", "sum"), ("first_ts_ms", "min"), ("last_ts_ms", "max")]
    )
    order = [("code", "ascending"), ("n_sum", "ascending"), ("log_group", "ascending")]
    per_group = per_group.take(pc.sort_indices(per_group, sort_keys=order, null_placement="at_start"))
    codes = per_group["code"].to_numpy()
    last = np.flatnonzero(np.append(codes[1:] != codes[:-1], True))
    out = per_group.group_by("code").aggregate([("n_sum", "sum"), ("first_ts_ms_min", "min"), ("last_ts_ms_max", "max"), ([], "count_all")]).sort_by("code")
    first = np.unique(code, return_index=True)[1]
    return pa.table({
        "template": template.dictionary, "n_variables": wild[first], "n": out["n_sum_sum"], "first_ts_ms": out["first_ts_ms_min_min"],
        "last_ts_ms": out["last_ts_ms_max_max"], "n_groups": out["count_all"], "main_group": per_group["log_group"].take(pa.array(last)),
    })


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the result from all messages (length, head, text, log_group, n, times) of leaves, one leaf after another."""

    def whole(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        begins = _begins(rows)
        ends, row = np.append(begins[1:], rows.num_rows), 0
        at = np.cumsum(rows["length"].to_numpy().astype(np.int64))[ends - 1]
        while row < len(begins):
            end = max(row + 1, int(np.searchsorted(at, (at[row - 1] if row else 0) + JUDGED, side="right")))
            yield from _judged(rows.slice(begins[row], ends[end - 1] - begins[row]), begins[row:end] - begins[row]).combine_chunks().to_batches()
            row = end

    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        if held and any(held[0][c][0].as_py() != rows[c][0].as_py() for c in ("length", "head")):
            yield from whole(pa.concat_tables(held))
            held = []
        last = int(_begins(rows)[-1])
        if last:
            yield from whole(pa.concat_tables([*held, rows.slice(0, last)]))
            held = []
        held.append(rows.slice(last))
    if held:
        yield from whole(pa.concat_tables(held))


def learned_templates(df: DataFrame, depth: int = DEPTH) -> DataFrame:
    """template, n_variables, n, first_ts_ms, last_ts_ms, n_groups, main_group of all messages."""
    shaped = shapes(df)
    counts = materialize(prefixes(shaped, depth), "tree")
    tree = branches(counts, depth)
    sizes = paths(counts, depth, tree).groupBy("length", "path").agg(F.sum("n").alias("total")).withColumn("own", F.col("length") - depth)
    by_words = F.ceil(F.col("own") * F.col("total") / TASK_WORDS)
    sizes = sizes.withColumns({
        "leaf": F.monotonically_increasing_id(),
        "large": (F.col("own") > 0) & (F.col("total") > 1) & ((F.col("own") * F.col("total") > TASK_WORDS) | (F.col("total") > TASK_ROWS)),
        "parts": F.least(by_words, F.greatest(F.lit(1), F.expr(f"total div {PART_ROWS}"))),
    })
    sizes = materialize(sizes, "leaves")
    seen = sizes.agg(
        F.ceil(F.sum(F.expr("if(own > 0 AND NOT large, own * total, 0)")) / TASK_WORDS).cast("int").alias("tasks"),
        F.count_if("large").alias("large"), F.count_if(F.col("own") <= 0).alias("short"),
    ).first()
    leaves, large, found = assign(shaped, tree), sizes.where("large").drop("large"), []
    if seen["tasks"]:
        # dealt out by the number of words, since nearly all of a task's bytes are words
        whole = leaves.where(F.col("length") > depth)
        if seen["large"]:
            whole = whole.join(F.broadcast(large.select("length", "path")), ["length", "path"], "left_anti")
        text = F.array_join(F.concat("path", F.expr(f"slice(words, {depth + 1}, length)")), " ")
        whole = whole.select("length", F.array_join("path", " ").alias("head"), text.alias("text"), "log_group", "n", "first_ts_ms", "last_ts_ms")
        dealt = whole.repartition(seen["tasks"], "length", "head").sortWithinPartitions("length", "head")
        kind = {c: df.schema[c].dataType.simpleString() for c in ("ts_ms", "log_group")}
        found.append(dealt.mapInArrow(judged, (
            f"template string, n_variables long, n long, first_ts_ms {kind['ts_ms']}, last_ts_ms {kind['ts_ms']}, n_groups long, main_group {kind['log_group']}"
        )))
    if seen["short"] or not found and not seen["large"]:
        none = F.array().cast("array<array<string>>")  # the path is all of the message
        found.append(summed(labelled(leaves.where(F.col("length") <= depth).withColumn("kept", none), depth)))
    if seen["large"]:
        kept = materialize(fixed_words(leaves, large, depth), "leaves")
        found.append(summed(labelled(leaves.join(_at_hand(kept), ["length", "path"]), depth)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
