"""Near-duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A document's set holds its distinct shingles of five words. Equal sets are one class. The signature
of a class has 70 MinHash values of 16 bits each, split into 14 chunks of 5 values. Two signatures
that differ in at most 27 values agree, by the pigeonhole principle, in at least four of the five
values of some chunk; so a class enters a table under every chunk with every single value left out
(the allowed error of the chunk), and all pairs within that distance meet. (Pairs at the similarity
threshold differ in 17.5 values on average; the chance that one of them meets nowhere, also beyond
distance 27, is 8e-7, and it falls steeply with the similarity.)

A bucket of that table is not expanded into its pairs. Its smallest class stands for it: all others
are paired with that one, and near pairs are confirmed on the full shingle sets. Buckets whose
members are then all connected are done. In the others, members of different components are
compared by signature in blocks of a bounded size, and pairs that come near are confirmed there.
Components come from contracting the confirmed links.

Defined cases: null and empty texts, and texts without words, have the empty set and are linked with
nothing; fewer than five words make one shingle of the whole sequence; rows with equal ids are judged each by
their own text; null ids are kept, alone; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common, flat
from vigil.llm.components import components

WORDS, SHARE = 5, 75
CHUNKS, CHUNK = 14, 5
VALUES = CHUNKS * CHUNK
#: Pairs whose signatures differ in more values are not confirmed: 6.2 standard deviations at similarity 0.75.
FARTHEST = 40
#: Members of a block in buckets that need all their components compared, and about the bytes of their sets.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
SLICE = 1 << 20
_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _rng.integers(0, 2**63, VALUES, dtype=np.uint64) * flat.U(2) + flat.U(1)
_ADD = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
_PLACE = flat.mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | flat.U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, flat, and where each text's begin."""
    starts, ends, first = flat.words(data, offsets)
    n = len(offsets) - 1
    word = flat.span_hash(data, starts, ends, flat.FOLDED)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), np.maximum(count - WORDS + 1, np.minimum(count, 1)))
    begin = np.repeat(first[:-1], np.maximum(count - WORDS + 1, np.minimum(count, 1)))
    at = begin + np.arange(len(owner)) - np.searchsorted(owner, owner)
    hashed = np.zeros(len(owner), np.uint64)
    for k in range(WORDS):
        there = k < count[owner]
        hashed[there] += word[at[there] + k] * _PLACE[k]
    hashed = flat.mix(hashed + np.minimum(count, WORDS)[owner].astype(np.uint64))
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    fresh = np.ones(len(hashed), bool)
    fresh[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    return hashed[fresh], np.searchsorted(owner[fresh], np.arange(n + 1))


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits each, of the nonempty sets; zeros for the empty ones."""
    out = np.zeros((len(at) - 1, VALUES), np.uint16)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for k in range(VALUES):
            least = np.minimum.reduceat(sets * _MULTIPLY[k] + _ADD[k], at[full])
            out[full, k] = (flat.mix(least) & flat.U(0xFFFF)).astype(np.uint16)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """All keys of each signature: every chunk with every one of its values left out."""
    chunks = signature.reshape(len(signature), CHUNKS, CHUNK).astype(np.uint64)
    out = np.empty((len(signature), CHUNKS, CHUNK), np.uint64)
    for gone in range(CHUNK):
        rest = [k for k in range(CHUNK) if k != gone]
        packed = sum((chunks[:, :, k] << flat.U(16 * i) for i, k in enumerate(rest)), np.zeros((), np.uint64))
        name = (np.arange(CHUNKS, dtype=np.uint64) * flat.U(CHUNK) + flat.U(gone + 1)) * flat.BASE
        out[:, :, gone] = flat.mix(packed ^ flat.mix(name)[None, :])
    return out.reshape(len(signature), VALUES)


def _summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return (sums[at[1:]] - sums[at[:-1]]).view(np.int64)


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, d1, d2, sig: the set's size, its 128-bit digest and its signature; docs: doc_id, text, key."""

    def run(batches):
        for batch in batches:
            data, offsets = common.bytes_of(batch.column(1))
            for a, b, part, at in common.slices(data, offsets, SLICE):
                sets, first = shingle_sets(part, at)
                sig = signatures(sets, first)
                yield pa.record_batch(
                    [
                        batch.column(0)[a:b], batch.column(2)[a:b], pa.array(np.diff(first)), pa.array(_summed(flat.mix(sets), first)),
                        pa.array(_summed(flat.mix(sets ^ flat.BASE), first)), pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    ["doc_id", "key", "n", "d1", "d2", "sig"],
                )

    return docs.mapInArrow(common.returning(run), "doc_id long, key long, n long, d1 long, d2 long, sig binary")


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, shingles: the full sets, as binary."""

    def run(batches):
        for batch in batches:
            data, offsets = common.bytes_of(batch.column(1))
            for a, b, part, at in common.slices(data, offsets, SLICE):
                sets, first = shingle_sets(part, at)
                rows = [sets[first[i] : first[i + 1]].tobytes() for i in range(b - a)]
                yield pa.record_batch([batch.column(0)[a:b], pa.array(rows, pa.binary())], ["doc_id", "shingles"])

    return docs.mapInArrow(common.returning(run), "doc_id long, shingles binary")


def _signature_rows(column) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py(), np.uint16) for x in column]) if len(column) else np.empty((0, VALUES), np.uint16)


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, far of the pairs whose signatures are near enough; far: the values in which they differ."""
    sig = classes.select("rep", "sig")
    both = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b"
    )

    def run(batches):
        for batch in batches:
            far = (_signature_rows(batch.column(2)) != _signature_rows(batch.column(3))).sum(axis=1)
            out = pa.record_batch([batch.column(0), batch.column(1), pa.array(far, pa.int32())], ["a", "b", "far"])
            yield out.filter(pa.array(far <= FARTHEST))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(common.returning(run), "a long, b long, far int")


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= share * union on the full sets."""
    both = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b").join(
        sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a"
    )

    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < share * len(large):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common_ = int((large[at] == small).sum())
                good[i] = 100 * common_ >= share * (len(x) + len(y) - common_)
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "x", "y").mapInArrow(common.returning(run), "a long, b long")


def _crossing(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select(*pairs.columns)


def _in_blocks(members: DataFrame, comps: DataFrame, classes: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """a, b: links between different components that share a bucket; one link for a class and a component.

    Buckets that overlap are one family, so a class is looked at once and not once for each bucket. The
    largest component of a family is never compared within itself: only the other classes go out to all
    blocks. Near signatures are confirmed on the full sets in the same place, so pairs are never rows.
    """
    tagged = members.join(comps, members["rep"] == comps["node"], "left").select(
        "key", "lo", "rep", F.coalesce("component", "rep").alias("component")
    )
    open_ = tagged.groupBy("key").agg(
        F.count("*").alias("size"), F.min("component").alias("least"), F.max("component").alias("most")
    ).where("least != most AND size > 2").select("key")
    shared = common.materialize(tagged.join(open_, "key").groupBy("lo", "rep").agg(F.any_value("component").alias("component")), "open")
    family = components(shared.select(F.col("lo").alias("a"), F.col("rep").alias("b"))).select(
        F.col("node").alias("rep"), F.col("component").alias("family")
    )
    rows = common.materialize(shared.select("rep", "component").distinct().join(family, "rep"), "open")
    # blocks of a bounded number of members and of a bounded size of their sets
    load = F.sum(F.greatest(F.lit(1 / BLOCK), F.col("size") * 8 / BLOCK_BYTES))
    parts = rows.join(classes.select("rep", F.col("n").alias("size")), "rep").groupBy("family", "component").agg(load.alias("n"))
    sizes = parts.groupBy("family").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("many"), F.sum("n").alias("all")
    ).select(
        "family", "largest", F.greatest(F.ceil(F.col("all") - F.col("many") - 1e-9), F.lit(1)).cast("int").alias("few_blocks"),
        F.greatest(F.ceil(F.col("many") - 1e-9), F.lit(1)).cast("int").alias("many_blocks"),
    )
    rows = rows.join(sizes, "family").withColumn("few", F.col("component") != F.col("largest"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("few"), F.col("few_blocks")).otherwise(F.col("many_blocks"))).cast("int")
    # a cell (i, j) holds block i of the few, and block j of the few (j >= i) or of the many (behind them)
    of_few = F.transform(
        F.sequence(F.lit(0), F.col("few_blocks") + F.col("many_blocks") - 1),
        lambda o: F.struct(
            F.when(o < F.col("few_blocks"), F.least(o, F.col("own"))).otherwise(F.col("own")).alias("i"),
            F.when(o < F.col("few_blocks"), F.greatest(o, F.col("own"))).otherwise(o).alias("j"),
        ),
    )
    of_many = F.transform(
        F.sequence(F.lit(0), F.col("few_blocks") - 1), lambda o: F.struct(o.alias("i"), (F.col("own") + F.col("few_blocks")).alias("j"))
    )
    cells = F.when(F.col("few"), of_few).otherwise(of_many)
    dealt = rows.withColumn("own", own).select("family", "rep", "component", "few", F.explode(cells).alias("c"))
    dealt = dealt.select("family", F.col("c.i").alias("i"), F.col("c.j").alias("j"), "few", "rep", "component")
    full = classes.select("rep", "sig").join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    ordered = dealt.join(full, "rep").select("family", "i", "j", "few", "rep", "component", "sig", "shingles")
    ordered = ordered.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    def compare(table: pa.Table):
        table = table.combine_chunks()
        few, rep, comp = (table.column(c).to_numpy() for c in ("few", "rep", "component"))
        sig = _signature_rows(table.column("sig").combine_chunks())
        data, at = common.bytes_of(table.column("shingles").cast(pa.large_binary()).combine_chunks().view(pa.large_utf8()))
        flat_sets, at = np.frombuffer(data.tobytes(), np.uint64), at // 8
        size = np.diff(at)
        out: list[tuple[int, int]] = []
        for x in np.flatnonzero(few):
            hit = np.flatnonzero((sig != sig[x]).sum(axis=1) <= FARTHEST)
            hit = hit[(comp[hit] != comp[x]) & (100 * np.minimum(size[hit], size[x]) >= share * np.maximum(size[hit], size[x]))]
            if not len(hit):
                continue
            mine = flat_sets[at[x] : at[x + 1]]
            theirs = np.concatenate([flat_sets[at[y] : at[y + 1]] for y in hit])
            found = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            both = np.add.reduceat(found, np.concatenate([[0], np.cumsum(size[hit])[:-1]]))
            hit = hit[100 * both >= share * (size[hit] + size[x] - both)]
            # any link to a component will do
            hit = hit[np.unique(comp[hit], return_index=True)[1]]
            out += [(min(rep[x], rep[y]), max(rep[x], rep[y])) for y in hit]
        if out:
            yield pa.record_batch([pa.array(np.array(c, np.int64)) for c in zip(*out)], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = [batch.column(c).to_numpy() for c in range(3)]
            cuts = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in cell], axis=0)) + 1).tolist()
            if held and [held[-1].column(c)[-1].as_py() for c in range(3)] != [c[0] for c in cell]:
                yield from compare(pa.Table.from_batches(held))
                held = []
            edges = [0, *cuts, batch.num_rows]
            for s, e in zip(edges, edges[1:]):
                held.append(batch.slice(s, e - s))
                if e < batch.num_rows:
                    yield from compare(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from compare(pa.Table.from_batches(held))

    return ordered.mapInArrow(common.returning(run), "a long, b long").distinct()


def classes_and_links(docs: DataFrame, share: int = SHARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, key, n, d1, d2), classes of equal sets (rep, doc_id, n, d1, d2), and the component of each rep.

    rep: a class's number, its least doc_id, or a hash where another class has that; docs: doc_id, text, key.
    """
    rows = common.materialize(_described(docs), "minhash")
    # partial aggregates first: a class of equal sets is one row before it is shuffled
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(
        F.min(F.struct("doc_id", "key")).alias("source"), F.any_value("sig").alias("sig")
    )
    classes = common.materialize(classes.select("source.*", "n", "d1", "d2", "sig"), "minhash")
    # rows that share an id may have several sets
    owner = classes.groupBy(F.col("doc_id").alias("of")).agg(F.min(F.struct("n", "d1", "d2")).alias("owner"))
    own = F.struct("n", "d1", "d2") == F.col("owner")
    rep = F.when(own, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "n", "d1", "d2"))
    classes = classes.join(owner, F.col("doc_id") == F.col("of")).select(rep.alias("rep"), "doc_id", "key", "n", "d1", "d2", "sig")
    classes = common.materialize(classes, "minhash")

    def keyed(batches):
        for batch in batches:
            keys = chunk_keys(_signature_rows(batch.column(1))).view(np.int64)
            at = np.arange(len(keys) + 1, dtype=np.int32) * VALUES
            yield pa.record_batch(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.ravel()))], ["rep", "keys"]
            )

    keys = classes.select("rep", "sig").mapInArrow(common.returning(keyed), "rep long, keys array<long>").select("rep", F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key", "lo")
    # written, so that the join below deals out both sides anew and a hot bucket can be split
    buckets = common.materialize(buckets, "buckets")
    members = common.materialize(keys.join(buckets, "key"), "buckets")
    stars = members.where("lo < rep").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct()
    near = common.materialize(_near(stars, classes), "near")
    # all classes that share a bucket with two or more others may still be compared below
    wide = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 2").select("key")
    ends = near.select(F.explode(F.array("a", "b")).alias("rep"))
    ends = ends.unionByName(members.join(wide, "key", "left_semi").select("rep")).distinct()
    read = classes.join(ends, "rep").select("rep", "doc_id", "key")
    texts = docs.join(read, ["doc_id", "key"]).select(F.col("rep").alias("doc_id"), "text")
    sets = common.materialize(_sets(texts).dropDuplicates(["doc_id"]), "sets")
    # first the nearest pair of every class, which connects most, then what is still open
    first = near.groupBy("b").agg(F.min_by("a", F.struct("far", "a")).alias("a")).select("a", "b")
    links = common.materialize(_confirmed(first, sets, share), "links")
    comps = components(links)
    links = common.materialize(links.unionByName(_confirmed(_crossing(near, comps), sets, share)), "links")
    comps = components(links)
    links = common.materialize(links.unionByName(_in_blocks(members, comps, classes, sets, share)), "links")
    return rows, classes, components(links)


def near_duplicates(docs: DataFrame, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row, and `text_key`, which tells rows of one id apart."""
    narrow = common.bounded(common.id_text(docs, id_col, text_col)).withColumn("key", common.text_key())
    rows, classes, comps = classes_and_links(narrow, share)
    of_class = classes.join(comps, classes["rep"] == comps["node"], "left").select(
        "n", "d1", "d2", "doc_id", F.coalesce("component", "rep").alias("root")
    )
    # written, so that the join deals out both sides anew and a large component can be split
    of_class = common.materialize(of_class, "classes")
    least = common.materialize(of_class.groupBy("root").agg(F.min("doc_id").alias("component_id")), "classes")
    of_class = of_class.join(least, "root").select("n", "d1", "d2", "component_id")
    out = rows.select("doc_id", "key", "n", "d1", "d2").join(of_class, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.col("key").alias("text_key"),
    )
