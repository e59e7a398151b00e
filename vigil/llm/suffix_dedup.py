"""Repeated byte strings of 200 bytes by suffix sorting in buckets, with difference-cover ranks for ties.

The suffixes of all texts fall into buckets by content: the 16-byte string with the least hash among
the first 200 bytes of a suffix, and the bytes beside it. Suffixes that agree in 200 bytes choose the same string at
the same distance; if they begin at most 92 bytes ahead of it, they have the 92 bytes behind it in common,
else the 93 bytes before it. These bytes belong to the bucket's content, since 16 bytes of prose
alone occur again by chance, the more often the larger the table is. A bucket's members that stand together in a text share a context, the bytes that
all of them cover; equal contexts are counted first, by partial aggregates, and copies of a context
need no sorting. Only buckets with several contexts are sorted, one at a time, and only one
source of each context takes part. There the suffixes are compared by their first bytes up
to the next position of a difference cover (mod 13, four positions), and long ties are resolved by
the precomputed ranks of the cover samples and the last bytes behind the sample, so no suffix
is ever compared byte by byte over its length and memory is bounded by one batch of buckets.

A bucket with more than BUCKET contexts is dealt out further before it is sorted: by the distance of its suffixes to
the bucket's string, in ranges, since equal suffixes have one distance, and by the bytes that all suffixes of a
range cover. Groups that are still larger share nearly all of their bytes and are counted suffix by suffix.

Defined cases: a byte is removed if a 200-byte string over it starts anywhere else, in this document,
another one or a repeated row; so all copies go. Null and short texts lose nothing; rows with a null
id take no part. Only id and text are read. A text that loses a part of a character is cut at bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import anchors, common, flat
from vigil.llm.substring_dedup import span_array, with_spans

WINDOW, K = 200, 16
SLICE = 1 << 20
#: Contexts of a bucket that one task sorts, and bytes of contexts sorted together.
BUCKET, BATCH = 16_384, 1 << 20
#: Suffixes whose keys a task holds at once, the width of a range of distances in larger buckets, and its pieces that one task sorts.
SUFFIXES, WIDEST, GROUP = 1 << 19, 32, 16_384
#: A difference cover: every difference mod 13 is one of two of these residues.
PERIOD, COVER = 13, (0, 1, 3, 9)


def suffixes(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, key, node, context, o, a, b: the runs of suffixes of one bucket in each text."""
    half = (window - k) // 2

    def sides(data, first, own, o, a, b):
        """(row, node, context, o, a, b) of the runs, cut where the distance to the string exceeds `half`."""
        base = first[own]
        for side in (0, 1):
            some = np.flatnonzero(o > half if side else a + o - b <= half)
            at = base[some] + a[some] + o[some]
            begin, end = base[some] + a[some], base[some] + b[some]
            if side:  # all of the run's suffixes begin before at - half and cover the string
                end = np.minimum(end, at - half - 1)
                node = flat.span_hash(data, at - half - 1, at + k, flat.BYTE)
            else:  # they begin from at - half on, at the string at last
                begin = np.maximum(begin, at - half)
                node = flat.span_hash(data, at, at - half + window, flat.BYTE)
            context = flat.mix(flat.span_hash(data, begin, end + window, flat.BYTE) + (at - begin).astype(np.uint64))
            yield own[some], node.view(np.int64), context.view(np.int64), at - begin, begin - base[some], end - base[some]

    def run(batches):
        for batch in batches:
            data, offsets = common.bytes_of(batch.column(2))
            for r0, r1, part, at in common.slices(data, offsets, SLICE):
                own, _, _, *run_ = anchors.anchors(part, at, k, window, flat.BYTE)
                for own, node, context, o, a, b in sides(part, at, own, *run_):
                    rows = pa.array(own + r0)
                    yield pa.record_batch(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(node), pa.array(context)]
                        + [pa.array(x.astype(np.int32)) for x in (o, a, b)],
                        ["doc_id", "key", "node", "context", "o", "a", "b"],
                    )

    return docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "key", "text").mapInArrow(
        run, "doc_id long, key long, node long, context long, o int, a int, b int"
    )


def _strings(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """data[i:i + length] of all i, as values that compare like the strings."""
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    return np.ascontiguousarray(view[at]).view(f"V{length}").ravel()


def _rank(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def sort_buckets(data: np.ndarray, start: np.ndarray, bucket: np.ndarray, o: np.ndarray, count: np.ndarray, window: int = WINDOW):
    """Which suffixes of contexts have an equal one in their bucket: (context, suffix) of each.

    data: the contexts' bytes, one after the other, `start` where each begins; o: where its bucket's
    string is; count: its suffixes, from its beginning on.
    """
    total = int(count.sum())
    pieces = -(-total // SUFFIXES)
    if pieces == 1:
        return _sort_range(data, start, bucket, o, np.zeros(len(start), np.int64), count, window)
    # equal suffixes have one distance to their bucket's string, so ranges of distances are independent
    width = -(-(int(o.max()) + 1) // pieces)
    found = []
    for low in range(0, int(o.max()) + 1, width):
        first = np.maximum(o - (low + width - 1), 0)
        end = np.minimum(o - low + 1, count)
        some = first < end
        if some.any():
            ctx, step = _sort_range(data, start[some], bucket[some], o[some], first[some], end[some], window)
            found.append((np.flatnonzero(some)[ctx], step))
    ctx, step = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((step, ctx))
    return ctx[order], step[order]


def _sort_range(data, start, bucket, o, first, end, window):
    """As `sort_buckets`, for the suffixes `first` to `end` of each context."""
    length, count = window - PERIOD + 1, end - first
    total = int(count.sum())
    ctx = np.repeat(np.arange(len(start)), count)
    step = np.arange(total) - np.repeat(np.cumsum(count) - count - first, count)
    at, far = start[ctx] + step, o[ctx] - step
    # the next position of the cover: all suffixes that can be equal have the same distance to it
    ahead = np.array([next(d for d in range(PERIOD) if (d - f) % PERIOD in COVER) for f in range(PERIOD)])[far % PERIOD]
    samples, which = np.unique(at + ahead, return_inverse=True)
    sample_rank = _rank(_strings(data, samples, length))[which]
    head, tail = (np.zeros(total, np.int64) for _ in range(2))
    for d in range(PERIOD):
        own = np.flatnonzero(ahead == d)
        if len(own):
            if d:
                head[own] = _rank(_strings(data, at[own], d))
            if window - d - length:
                tail[own] = _rank(_strings(data, at[own] + d + length, window - d - length))
    keys = (tail, sample_rank, head, far, bucket[ctx])
    order = np.lexsort(keys)
    same = np.all([k[order][1:] == k[order][:-1] for k in keys], axis=0)
    again = np.zeros(total, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return ctx[again], step[again]


def _sources(branching: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """doc_id, key, node, o, a, bytes: the contexts read from their sources."""
    todo = branching.groupBy("doc_id", "key").agg(F.collect_list(F.struct("node", "o", "a", "b", "size")).alias("todo"))
    texts = docs.join(todo, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "text", "todo")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                rows = batch.column(3)[i].as_py()
                yield pa.record_batch(
                    [pa.array([batch.column(c)[i].as_py()] * len(rows), pa.int64()) for c in (0, 1)]
                    + [pa.array([r["node"] for r in rows], pa.int64())]
                    + [pa.array([r[c] for r in rows], pa.int32()) for c in ("o", "a")]
                    + [pa.array([r["size"] for r in rows], pa.int64())]
                    + [pa.array([text[r["a"] : r["b"] + window] for r in rows], pa.binary())],
                    ["doc_id", "key", "node", "o", "a", "size", "bytes"],
                )

    return texts.mapInArrow(run, "doc_id long, key long, node long, o int, a int, size long, bytes binary")


def _sorted_buckets(sources: DataFrame, window: int) -> DataFrame:
    """doc_id, key, s, e from buckets of bounded size, sorted one after the other in each partition."""
    ordered = sources.repartition("node").sortWithinPartitions("node")

    def emit(table: pa.Table):
        table = table.combine_chunks()
        data, start = common.bytes_of(table.column("bytes").cast(pa.large_binary()).combine_chunks().view(pa.large_utf8()))
        o = table.column("o").to_numpy().astype(np.int64)
        ctx, step = sort_buckets(data, start[:-1], table.column("node").to_numpy(), o, np.diff(start) - window + 1, window)
        if not len(ctx):
            return
        # neighbouring suffixes make one span
        new = np.ones(len(ctx), bool)
        new[1:] = (ctx[1:] != ctx[:-1]) | (step[1:] != step[:-1] + 1)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(ctx)) - 1
        rows = pa.array(ctx[begin])
        a = table.column("a").to_numpy()[ctx[begin]]
        yield pa.record_batch(
            [table.column("doc_id").take(rows).combine_chunks(), table.column("key").take(rows).combine_chunks()]
            + [pa.array((a + x).astype(np.int32)) for x in (step[begin], step[last] + window)],
            ["doc_id", "key", "s", "e"],
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(2).to_numpy()
            begins = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), batch.num_rows]
            lengths = np.concatenate([[0], np.cumsum([len(x.as_py()) for x in batch.column(6)])])
            for s, e in zip(begins, begins[1:]):
                fresh = not held or held[-1].column(2)[-1].as_py() != node[s]
                if fresh and size >= BATCH:
                    yield from emit(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(batch.slice(s, e - s))
                size += int(lengths[e] - lengths[s])
        if held:
            yield from emit(pa.Table.from_batches(held))

    columns = ("doc_id", "key", "node", "o", "a", "size", "bytes")
    return ordered.select(*columns).mapInArrow(run, "doc_id long, key long, s int, e int")


def _ranges(sources: DataFrame, window: int) -> DataFrame:
    """id, node, low, shared, whole: the ranges of distances that a context has suffixes in, with two hashes.

    shared: of the bytes that all suffixes of the range cover; whole: of all bytes that any of them covers, null
    where the context has not all of the range's distances.
    """

    def run(batches):
        for batch in batches:
            text, at = common.bytes_of(batch.column(3).cast(pa.large_binary()).view(pa.large_utf8()))
            o, size = batch.column(2).to_numpy().astype(np.int64), np.diff(at)
            first, last = (o - (size - window)) // WIDEST, o // WIDEST
            own = np.repeat(np.arange(len(o)), last - first + 1)
            low = (first[own] + np.arange(len(own)) - np.searchsorted(own, own)) * WIDEST
            high, begin = low + WIDEST - 1, at[:-1][own]
            shared = flat.span_hash_any(text, begin + o[own] - low, begin + o[own] - high + window, flat.BYTE).view(np.int64)
            inside = (high <= o[own]) & (o[own] - low + window <= size[own])
            whole = np.zeros(len(own), np.int64)
            whole[inside] = flat.span_hash_any(
                text, (begin + o[own] - high)[inside], (begin + o[own] - low + window)[inside], flat.BYTE
            ).view(np.int64)
            rows = pa.array(own)
            yield pa.record_batch(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(low.astype(np.int32)), pa.array(shared), pa.array(whole, mask=~inside)],
                ["id", "node", "low", "shared", "whole"],
            )

    return sources.select("id", "node", "o", "bytes").mapInArrow(run, "id long, node long, low int, shared long, whole long")


def _pieces(rows: DataFrame, window: int) -> DataFrame:
    """The rows with their context cut down to the suffixes of their range."""
    begin = F.greatest(F.col("o") - F.col("low") - (WIDEST - 1), F.lit(0))
    end = F.least(F.col("o") - F.col("low") + window, F.octet_length("bytes"))
    return rows.select(
        "doc_id", "key", "node", "low", "shared", (F.col("o") - begin).alias("o"), (F.col("a") + begin).alias("a"), F.lit(0).cast("long").alias("size"),
        F.substring("bytes", begin + 1, end - begin).alias("bytes"),
    )


def _single(pieces: DataFrame, window: int) -> DataFrame:
    """node, far, h, doc_id, key, s: every suffix of the pieces, by its distance and hash."""

    def run(batches):
        for batch in batches:
            text, at = common.bytes_of(batch.column(5).cast(pa.large_binary()).view(pa.large_utf8()))
            o, a = (batch.column(c).to_numpy().astype(np.int64) for c in (3, 4))
            count = np.diff(at) - window + 1
            own = np.repeat(np.arange(len(o)), count)
            step = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            start = at[:-1][own] + step
            h = flat.span_hash_any(text, start, start + window, flat.BYTE).view(np.int64)
            rows = pa.array(own)
            yield pa.record_batch(
                [batch.column(c).take(rows) for c in (0, 1, 2)]
                + [pa.array((o[own] - step).astype(np.int32)), pa.array(h), pa.array((a[own] + step).astype(np.int32))],
                ["doc_id", "key", "node", "far", "h", "s"],
            )

    return pieces.select("doc_id", "key", "node", "o", "a", "bytes").mapInArrow(
        run, "doc_id long, key long, node long, far int, h long, s int"
    )


def _spread_buckets(sources: DataFrame, window: int) -> DataFrame:
    """doc_id, key, s, e from buckets of any size, dealt out by range of distances and by content.

    Equal suffixes have one distance to their bucket's string, so ranges of distances are independent; and suffixes
    that are equal share the bytes that all suffixes of the range cover, so a range is dealt on by their hash. What is
    alone then holds no repeated suffix; where all bytes of a range occur again, all its suffixes are repeated and
    one copy goes on. The rest is sorted like small buckets; a group of more than GROUP pieces, which share
    nearly all of their bytes, is counted suffix by suffix.
    """
    sources = common.materialize(sources.withColumn("id", F.monotonically_increasing_id()), "hot")
    rows = common.materialize(_ranges(sources, window), "hot")
    again = common.materialize(rows.groupBy("node", "low", "shared").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "hot")
    full = rows.where("whole IS NOT NULL").groupBy("node", "low", "whole").agg(F.count("*").alias("copies"), F.min("id").alias("witness"))
    full = common.materialize(full.where("copies > 1"), "hot")
    kept = rows.join(again, ["node", "low", "shared"]).join(full, ["node", "low", "whole"], "left")
    all_ = F.col("copies").isNotNull()
    kept = kept.select("id", "node", "low", "shared", all_.alias("all"), (~all_ | (F.col("id") == F.col("witness"))).alias("goes_on"))
    kept = common.materialize(kept, "hot")
    for spent in (rows, again, full):
        common.discard(spent)
    first = F.col("a") + F.col("o") - F.col("low")
    done = kept.where("all").select("id", "low").join(sources, "id").select(
        "doc_id", "key", (first - (WIDEST - 1)).alias("s"), (first + window).alias("e")
    )
    rest = kept.where("goes_on").select("id", "low", "shared")
    rest = rest.join(sources, "id")
    sizes = kept.where("goes_on").groupBy("node", "low", "shared").agg(F.count("*").alias("m")).where("m > 1")
    sizes = common.materialize(sizes, "hot")
    pieces = _pieces(rest, window).join(sizes, ["node", "low", "shared"])
    small = pieces.where(F.col("m") <= GROUP).withColumn("node", F.xxhash64("node", "low", "shared"))
    spans = done.unionByName(_sorted_buckets(small, window))
    if sizes.where(F.col("m") > GROUP).isEmpty():
        return spans
    single = common.materialize(_single(pieces.where(F.col("m") > GROUP), window), "hot")
    by = ["node", "far", "h"]
    repeated = common.materialize(single.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "hot")
    found = single.join(repeated, by)
    return spans.unionByName(found.select("doc_id", "key", "s", (F.col("s") + window).alias("e")))


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, key, s, e: spans of bytes that occur elsewhere; docs: doc_id, key, text."""
    found = common.materialize(suffixes(docs, window, k), "suffixes")
    shared = found.groupBy("node").agg(
        F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("branches")
    ).where("n > 1").select("node", "branches")
    # written, so that the join deals out both sides anew and the rows of a hot bucket can be split
    shared = common.materialize(shared, "nodes")
    runs = common.materialize(found.join(shared, "node"), "buckets")
    common.discard(found)  # the largest intermediate table; `runs` has what is needed of it
    plain = runs.where("NOT branches")
    contexts = runs.where("branches").groupBy("node", "context").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "key", "a", "b", "o")).alias("at")
    )
    contexts = common.materialize(contexts, "contexts")
    copied = runs.where("branches").join(contexts.where("copies > 1").select("node", "context"), ["node", "context"])
    spans = plain.select("doc_id", "key", "a", "b").unionByName(copied.select("doc_id", "key", "a", "b")).select(
        "doc_id", "key", F.col("a").alias("s"), (F.col("b") + window).alias("e")
    )
    sizes = common.materialize(contexts.groupBy("node").agg(F.count("*").alias("size")), "contexts")
    sources = contexts.join(sizes, "node").select("node", "at.doc_id", "at.key", "at.a", "at.b", "at.o", "size")
    spans = spans.unionByName(_sorted_buckets(_sources(sources.where(F.col("size") <= BUCKET), docs, window), window))
    large = sources.where(F.col("size") > BUCKET)
    return spans if large.isEmpty() else spans.unionByName(_spread_buckets(_sources(large, docs, window), window))


def _kept(text: str | None, spans: pa.Scalar) -> tuple[int, int, int, bytes]:
    """Bytes, bytes removed, removed runs, and the remaining bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not len(spans.values):
        return len(raw), 0, 0, raw
    gone = anchors.covered(span_array(spans), len(raw))
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def _applied(docs, window, k, id_col, text_col, name, kind, said) -> DataFrame:
    keyed = common.id_text(docs, id_col, text_col).withColumn("key", common.text_key())

    def run(batches):
        for batch in batches:
            rows = [_kept(t.as_py(), s) for t, s in zip(batch.column(1), batch.column(2))]
            yield pa.record_batch(
                [batch.column(0), pa.array([said(r[3]) for r in rows], kind)]
                + [pa.array([r[c] for r in rows], pa.int64()) for c in (0, 1, 2)],
                ["doc_id", name, "n_bytes", "n_removed", "n_spans"],
            )

    return with_spans(keyed, repeated_spans(keyed, window, k)).mapInArrow(
        run, f"doc_id long, {name} {'binary' if kind == pa.binary() else 'string'}, n_bytes long, n_removed long, n_spans long"
    )


def dedup(docs: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans."""
    return _applied(docs, window, k, id_col, text_col, "kept", pa.binary(), lambda kept: kept)


def digests(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, kept_sha256, n_bytes, n_removed, n_spans."""
    return _applied(docs, window, k, "doc_id", "text", "kept_sha256", pa.string(), lambda kept: hashlib.sha256(kept).hexdigest())
