"""Long repeated spans of words by de Bruijn compaction over sampled k-mers.

Nodes of the graph are k-mers of 12 words, sampled as the window minima of all windows of 50 words,
so that a repeated window is guaranteed to share its node. A node's edges are its contexts: the words
of all windows that chose it, that is the de Bruijn path of about 20 k-mers in and out of the
node, compacted into one edge with its source coordinates. Nodes that occur in one document only
leave the graph. A node with one context in all documents does not branch: everything on its
path is repeated, in all documents but the smallest. At a branching node the documents of one
context still share its whole path; only the first source of each context is verified window by window,
at its source coordinates, against the first sources of the node's other contexts. Paths of
neighbouring nodes overlap, and their union per document is the maximal repeated span.

All steps are joins and partial aggregates on (node, context) rows, about one row for 20 words; a node
that many documents share is never gathered.

Defined cases: a word is removed if a window of 50 words over it also starts in a document with a
smaller id; null and short texts lose nothing; documents with equal ids never remove each other's words;
rows that repeat id and text get equal results; null ids take no part. Only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import anchors, common, flat

WINDOW, K = 50, 12
SLICE = 1 << 20
SPANS = "array<struct<s:int,e:int>>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.id_text(docs, id_col, text_col).withColumn("key", common.text_key())


def nodes(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, key, node, context, o, a, b of every node occurrence; docs: doc_id, key, text."""

    def run(batches):
        for batch in batches:
            data, offsets = common.bytes_of(batch.column(2))
            for r0, r1, part, at in common.slices(data, offsets, SLICE):
                starts, ends, first = flat.words(part, at)
                word = flat.span_hash(part, starts, ends, flat.BYTE)
                own, node, context, o, a, b = anchors.anchors(word, first, k, window)
                rows = pa.array(own + r0)
                yield pa.record_batch(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(node), pa.array(context)]
                    + [pa.array(x.astype(np.int32)) for x in (o, a, b)],
                    ["doc_id", "key", "node", "context", "o", "a", "b"],
                )

    return docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "key", "text").mapInArrow(
        run, "doc_id long, key long, node long, context long, o int, a int, b int"
    )


def _windows(sources: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """doc_id, key, node, far, w, i: the windows of the contexts in `sources`, read at their coordinates."""
    todo = sources.groupBy("doc_id", "key").agg(F.collect_list(F.struct("node", "o", "a", "b")).alias("todo"))
    texts = docs.join(todo, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "text", "todo")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, at = common.bytes_of(batch.column(2)[i : i + 1])
                starts, ends, _ = flat.words(data, at)
                word = flat.span_hash(data, starts, ends, flat.BYTE)
                todo_ = batch.column(3)[i].as_py()
                found = anchors.window_hashes(word, [(t["a"], t["b"]) for t in todo_], window)
                count = np.array([len(x) for x in found])
                n = int(count.sum())
                step = np.concatenate([np.arange(c) for c in count])
                of = lambda name: np.repeat([t[name] for t in todo_], count)  # noqa: E731, B023
                yield pa.record_batch(
                    [
                        pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.full(n, batch.column(1)[i].as_py())),
                        pa.array(of("node")), pa.array((of("o") - step).astype(np.int32)), pa.array(np.concatenate(found)),
                        pa.array((of("a") + step).astype(np.int32)),
                    ],
                    ["doc_id", "key", "node", "far", "w", "i"],
                )

    return texts.mapInArrow(run, "doc_id long, key long, node long, far int, w long, i int")


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, key, s, e: spans of words that repeat windows of documents with smaller ids; docs: doc_id, key, text."""
    found = common.materialize(nodes(docs, window, k), "kmers")
    repeated = found.groupBy("node").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("context") != F.max("context")).alias("branches")
    ).where("lo < hi").select("node", "lo", "branches")
    # written, so that the join deals out both sides anew and the rows of a hot node can be split
    repeated = common.materialize(repeated, "nodes")
    graph = common.materialize(found.join(repeated, "node"), "graph")
    plain = graph.where("NOT branches")
    edges = graph.where("branches").drop("lo")
    # written: were it aggregated in the join, both would share one exchange, and a hot context could not be split
    first = common.materialize(edges.groupBy("node", "context").agg(F.min("doc_id").alias("lo")), "edges")
    edges = common.materialize(edges.join(first, ["node", "context"]), "edges")
    whole = plain.select("doc_id", "key", "lo", "a", "b").unionByName(edges.select("doc_id", "key", "lo", "a", "b")).where("doc_id > lo")
    spans = whole.select("doc_id", "key", F.col("a").alias("s"), (F.col("b") + window).alias("e"))
    windows = common.materialize(_windows(edges.where("doc_id = lo"), docs, window), "windows")
    by = ["node", "far", "w"]
    earlier = windows.groupBy(*by).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    later = windows.join(earlier.select(*by, "lo"), by).where("doc_id > lo")
    return spans.unionByName(later.select("doc_id", "key", F.col("i").alias("s"), (F.col("i") + window).alias("e")))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`docs` with its spans as an array; a document has no more spans than windows."""
    gathered = spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    joined = docs.join(gathered.withColumnsRenamed({"doc_id": "__id", "key": "__key"}), F.expr("doc_id = __id AND key = __key"), "left")
    return joined.select("doc_id", "text", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def span_array(value: pa.Scalar) -> np.ndarray:
    """(n, 2) starts and ends of one row's spans."""
    rows = value.values
    return np.stack([rows.field(0).to_numpy(), rows.field(1).to_numpy()], axis=1) if len(rows) else np.empty((0, 2), np.int64)


def _kept(text: str | None, spans: pa.Scalar) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept words joined by one space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not len(spans.values):
        return len(words), 0, b" ".join(words)
    gone = anchors.covered(span_array(spans), len(words))
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def dedup(docs: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_words, n_removed: the texts without repeated spans."""
    return _applied(docs, window, k, id_col, text_col, "text", lambda kept: kept.decode("utf-8", "replace"))


def digests(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, kept_sha256, n_words, n_removed."""
    return _applied(docs, window, k, "doc_id", "text", "kept_sha256", lambda kept: hashlib.sha256(kept).hexdigest())


def _applied(docs, window, k, id_col, text_col, name, said) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            rows = [_kept(t.as_py(), s) for t, s in zip(batch.column(1), batch.column(2))]
            yield pa.record_batch(
                [batch.column(0), pa.array([said(r[2]) for r in rows], pa.string())]
                + [pa.array([r[c] for r in rows], pa.int64()) for c in (0, 1)],
                ["doc_id", name, "n_words", "n_removed"],
            )

    return with_spans(keyed, repeated_spans(keyed, window, k)).mapInArrow(
        run, f"doc_id long, {name} string, n_words long, n_removed long"
    )
