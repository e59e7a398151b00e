"""Repeated runs of lines, found by winnowing and removed where they come later. DataFrame code only.

A line is deleted if it lies in `min_run` consecutive lines of a document that also stand, in the
same order, at an earlier place: in a document with a smaller id, or further up in the same one.
Runs are judged on the input. To find them, each window of `min_run` line hashes selects its
least hash (the first, if equal) as fingerprint, so equal windows select the same line at the
same offset and every repeated run is guaranteed to share a fingerprint. Positions are joined only
for fingerprints that occur twice; from there each match is extended to both sides, over the
windows that hold the fingerprint, by comparing their 128-bit keys with the first place of the
key. Overlapping repeated windows make up the maximal run.

Content decides, not the number of lines alone: a line of `alone` bytes or more says enough to be a run of length
one and is deleted wherever it stood before, whatever its neighbours; only shorter lines need a neighbour.
(`alone=None` asks for runs only.)

Groups are never gathered: fingerprints and windows are reduced to counts and first places by
partial aggregates, and joined back many to one, where adaptive execution splits a hot key.

Defined cases: lines end at `\\n` only; null text stays null, empty text is one empty line; rows
that repeat both id and text count as one document, so neither removes the other; rows
with equal ids and other texts come in the order of a hash; null ids come last. Extra columns,
whatever their names, are kept by `dedup`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common

MIN_RUN = 2
#: Bytes from which a line says enough to be a run of its own.
ALONE_BYTES = 100
LAST = 2**63 - 1
_PLACE = ("__id", "__key", "__at")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.withColumns({
        "__id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)),
        "__key": F.xxhash64(F.coalesce(text, F.lit(""))),
    })


def fingerprints(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each selected line: its hash, its place, and the windows that selected it."""
    text = F.col(f"`{text_col}`").cast("string")
    lines = _keyed(docs.where(text.isNotNull()), id_col, text_col).select("__id", "__key", F.split(text, "\n").alias("lines"))
    hashed = lines.where(F.size("lines") >= min_run).select(
        "__id", "__key",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(min_run), x)).alias("b"),
    )

    def window(i):
        own = F.slice(F.col("a"), i + 1, min_run)
        return F.struct(
            (i + F.array_position(own, F.array_min(own)).cast("int") - 1).alias("p"), i.alias("at"),
            F.xxhash64(own).alias("w1"), F.xxhash64(F.slice(F.col("b"), i + 1, min_run)).alias("w2"),
        )

    windows = hashed.select(
        "__id", "__key", "a", F.transform(F.sequence(F.lit(0), F.size("a") - min_run), window).alias("windows")
    )
    selected = windows.select(
        "__id", "__key",
        F.explode(
            F.transform(
                F.array_distinct(F.transform("windows", lambda w: w["p"])),
                lambda p: F.struct(
                    F.get(F.col("a"), p).alias("fp"),
                    # windows that select one line stand together, no more than min_run of them
                    F.filter(
                        F.slice(F.col("windows"), F.greatest(p - min_run + 2, F.lit(1)), min_run), lambda w: w["p"] == p
                    ).alias("windows"),
                ),
            )
        ).alias("m"),
    )
    return selected.select("m.fp", "__id", "__key", "m.windows")


def repeated_windows(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __key, __at: the windows that have an earlier equal one."""
    marks = common.materialize(fingerprints(docs, min_run, id_col, text_col), "winnow")
    place = F.struct("__id", "__key", F.element_at("windows", 1)["at"])
    shared = marks.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select("fp")
    matches = marks.join(shared, "fp").select("__id", "__key", F.explode("windows").alias("w"))
    windows = matches.select("__id", "__key", F.col("w.at").alias("__at"), "w.w1", "w.w2")
    here = F.struct(*_PLACE)
    first = windows.groupBy("w1", "w2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first != last")
    return windows.join(first.drop("last"), ["w1", "w2"]).where(here != F.col("first")).select(*_PLACE)


def repeated_alone(docs: DataFrame, alone: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __key, __at: the lines of `alone` bytes or more that have an earlier equal one."""
    text = F.col(f"`{text_col}`").cast("string")
    lines = _keyed(docs.where(text.isNotNull()), id_col, text_col).select(
        "__id", "__key", F.posexplode(F.split(text, "\n")).alias("__at", "line")
    ).where(F.octet_length("line") >= alone)
    hashed = lines.select(*_PLACE, F.xxhash64("line").alias("w1"), F.xxhash64(F.lit(1), "line").alias("w2"))
    marks, here = common.materialize(hashed, "lines"), F.struct(*_PLACE)
    first = marks.groupBy("w1", "w2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first != last")
    return marks.join(first.drop("last"), ["w1", "w2"]).where(here != F.col("first")).select(*_PLACE)


def dedup(
    docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", alone: int | None = ALONE_BYTES
) -> DataFrame:
    """`docs` with the kept lines as text, and `__lines` and `__removed`: lines before, lines deleted."""
    found, width = repeated_windows(docs, min_run, id_col, text_col), min_run
    if alone is not None:
        # windows and single lines overlap, so both are judged line by line
        each = F.explode(F.sequence(F.col("__at"), F.col("__at") + min_run - 1)).alias("__at")
        found, width = found.select("__id", "__key", each).unionByName(repeated_alone(docs, alone, id_col, text_col)), 1
    removed = found.groupBy("__id", "__key").agg(F.array_sort(F.collect_set("__at")).alias("__starts"))
    text = F.col(f"`{text_col}`").cast("string")
    joined = _keyed(docs, id_col, text_col).join(removed, ["__id", "__key"], "left")
    joined = joined.withColumns({
        "__all": F.coalesce(F.split(text, "\n"), F.array().cast("array<string>")),
        "__starts": F.coalesce("__starts", F.array().cast("array<int>")),
    })
    # what is kept lies between the end of one repeated window (or line) and the start of the next
    begin = F.concat(F.array(F.lit(0)), F.transform("__starts", lambda i: i + width))
    end = F.concat(F.col("__starts"), F.array(F.size("__all")))
    ranges = F.arrays_zip(begin.alias("a"), end.alias("b"))
    joined = joined.withColumn(
        "__ranges", F.filter(ranges, lambda r: r["a"] < r["b"])
    ).withColumn("__kept", F.flatten(F.transform("__ranges", lambda r: F.slice(F.col("__all"), r["a"] + 1, r["b"] - r["a"]))))
    untouched = text.isNull() | (F.size("__starts") == 0)
    return joined.withColumns({
        text_col: F.when(untouched, text).otherwise(F.array_join("__kept", "\n")),
        "__lines": F.size("__all").cast("long"),
        "__removed": (F.size("__all") - F.size("__kept")).cast("long"),
    }).select(*[f"`{c}`" for c in docs.columns], "__lines", "__removed")


def digests(docs: DataFrame, min_run: int = MIN_RUN, alone: int | None = ALONE_BYTES) -> DataFrame:
    narrow = common.id_text(docs)
    return dedup(narrow, min_run, alone=alone).select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
