"""Near-duplicates by SimHash: a generalised pigeonhole search over 64-bit fingerprints.

Documents with one fingerprint are one class. Classes whose fingerprints differ in at most three bits are
linked, and found like this:

1. Bits are grouped by their correlation over all fingerprints into four blocks of 16, correlated bits
   together, so that what is uneven about the fingerprints lies in few blocks.
2. The exact counts of every block value give, for any fingerprint, how many others come within 0, 1, 2 or 3
   bits of it in a block. These tables have a fixed size, whatever the input's.
3. The blocks are the partitions, or pairs of blocks are: whichever costs less by those counts (on few
   fingerprints the former, on billions the latter).
4. Each fingerprint gets its own threshold for each partition by dynamic programming: the thresholds sum to
   3 - partitions + 1, -1 leaves a partition out, and the sum of estimated candidates and probes is least.
   By the generalised pigeonhole principle a fingerprint within three bits is within the threshold in
   some partition.
5. Every class is indexed by its value in each partition, probes all values within its threshold, and what
   meets under a value is verified on all 64 bits.

Pairs are never rows: a bucket is compared in place, in cells of a bounded number of indexed and probing
classes, and a cell returns at most one link a class, a forest that connects what the found pairs
connect. Components come from contracting these links.

Defined cases: null and empty texts, and texts without words, have the fingerprint zero and are linked like any
other; fewer words than a shingle make one shingle of them all; texts of any length are read in pieces;
equal rows and equal ids keep a row each; rows with a null id belong to their class, whose id is the least that is
not null (null if there is none); an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common
from vigil.llm.components import components, forest

WORDS, SEED, FAR = 3, 42, 3
BITS, BLOCKS = 64, 4
WIDTH = BITS // BLOCKS
#: What a probe costs, in comparisons.
PROBE = 8
#: Classes of a cell that are compared with each other, and numbers held at once by a comparison.
CELL, HELD = 8192, 1 << 20
#: Up to this size the pairs of whole buckets are laid out together.
SMALL = 32
SLICE = 1 << 16


# fingerprints

def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    word = text.lower().split()  # of bytes: A-Z only, and the six ASCII separators
    if not word:
        return 0
    joined = b" ".join(word)
    ends = np.cumsum(np.fromiter(map(len, word), np.int64, len(word)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(word) - words + 1, 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(word)) - 1 :].tolist()
    of, set_ = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, n, SLICE):
        hashed = np.array([of(joined[s:e], seed) for s, e in zip(starts[i : i + SLICE], ends[i : i + SLICE])], np.uint64)
        set_ += bits(hashed).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view(np.uint64)[0])


def bits(values: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones for each value, the lowest bit first."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for every row."""

    def run(batches):
        for batch in batches:
            data, at = common.bytes_of(batch.column(1))
            raw = [fingerprint(data[a:b].tobytes(), words, seed) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch([batch.column(0), pa.array(np.array(raw, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return common.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


# statistics of a fixed size

def _values(batch: pa.RecordBatch, name: str = "fp") -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _summed(fps: DataFrame, make, size: int) -> np.ndarray:
    """The sum of `make(values)`, an array of `size` numbers, over all fingerprints."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += make(_values(batch))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["at", "n"])

    summed = fps.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[summed.column("at").to_numpy()] = summed.column("n").to_numpy()
    return out


def bit_groups(fps: DataFrame, n: int) -> np.ndarray:
    """All bits, correlated ones side by side: the first WIDTH are the first block, and so on."""

    def products(values):
        table = bits(values).astype(np.float32)  # exact: a batch has far fewer than 2 ** 24 rows
        return (table.T @ table).astype(np.int64).ravel()

    both = _summed(fps, products, BITS * BITS).reshape(BITS, BITS) / max(n, 1)
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    related = np.round(np.abs((both - np.outer(mean, mean)) / np.outer(spread, spread)), 9)
    np.fill_diagonal(related, 0)
    left, order = list(range(BITS)), []
    while left:
        group = [max(left, key=lambda b: (related[b, left].max(), -b))]
        left.remove(group[0])
        while len(group) < WIDTH:
            group.append(max(left, key=lambda b: (related[b, group].sum(), -b)))
            left.remove(group[-1])
        order += group
    return np.array(order)


def block_values(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The value of each block of each fingerprint."""
    packed = np.packbits(np.ascontiguousarray(bits(values)[:, order]), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u2")


def near_counts(counts: np.ndarray) -> np.ndarray:
    """[distance, value]: how many have a block value at that distance (0 to FAR) from a value."""
    out = np.zeros((FAR + 1, len(counts)), np.float64)
    out[0] = counts
    value = np.arange(len(counts))
    for bit in range(WIDTH):
        flipped = out[:, value ^ (1 << bit)]
        out[1:] += flipped[:-1]
    return out


@dataclass(frozen=True)
class Plan:
    """The blocks' bits, the counts per block, the number of fingerprints, and the partitions as pairs or single blocks."""

    order: np.ndarray
    near: np.ndarray  # [block, distance, value]
    n: int
    parts: int

    @property
    def width(self) -> int:
        return BITS // self.parts

    def keys(self, values: np.ndarray) -> np.ndarray:
        """[fingerprint, partition]: the partition's value."""
        return block_values(values, self.order).view("<u2" if self.parts == BLOCKS else "<u4").astype(np.uint64)

    def candidates(self, values: np.ndarray) -> np.ndarray:
        """[fingerprint, partition, threshold + 1]: the estimated number of classes within the threshold."""
        block = block_values(values, self.order)
        at = np.stack([self.near[b][:, block[:, b]].T for b in range(BLOCKS)], axis=1)
        joined = BLOCKS // self.parts
        if joined > 1:  # blocks taken as independent
            share, at = at / max(self.n, 1), np.zeros((len(values), self.parts, FAR + 1))
            for p in range(self.parts):
                one, two = share[:, joined * p], share[:, joined * p + 1]
                for d in range(FAR + 1):
                    at[:, p, d] = self.n * sum(one[:, e] * two[:, d - e] for e in range(d + 1))
        out = np.zeros((len(values), self.parts, FAR + 2))
        np.cumsum(at, axis=2, out=out[:, :, 1:])
        return out

    def thresholds(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[fingerprint, partition] and the least cost of each fingerprint, by dynamic programming over partitions.

        Thresholds plus one sum to FAR + 1, however many partitions there are.
        """
        probes = np.cumsum([0] + [comb(self.width, d) for d in range(FAR + 1)])
        cost = self.candidates(values) + PROBE * probes
        best = np.full((len(values), FAR + 2), np.inf)
        best[:, 0] = 0
        chosen = np.zeros((self.parts, len(values), FAR + 2), np.int8)
        for p in range(self.parts):
            now = np.full_like(best, np.inf)
            for total in range(FAR + 2):
                options = np.stack([best[:, total - u] + cost[:, p, u] for u in range(total + 1)], axis=1)
                chosen[p, :, total] = options.argmin(axis=1)
                now[:, total] = options.min(axis=1)
            best = now
        out = np.empty((len(values), self.parts), np.int8)
        left = np.full(len(values), FAR + 1)
        for p in range(self.parts - 1, -1, -1):
            used = chosen[p, np.arange(len(values)), left]
            out[:, p], left = used - 1, left - used
        return out, best[:, FAR + 1]

    def masks(self, threshold: int) -> np.ndarray:
        """All changes of one to `threshold` bits of a partition's value."""
        one = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
        found, level = [], np.zeros(1, np.uint64)
        highest = np.full(1, -1)
        for _ in range(threshold):
            rows = [(m | one[b], b) for m, h in zip(level, highest) for b in range(h + 1, self.width)]
            level, highest = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows])
            found.append(level)
        return np.concatenate(found) if found else np.empty(0, np.uint64)


def plan(fps: DataFrame, n: int) -> Plan:
    order = bit_groups(fps, n)
    step = np.arange(BLOCKS) << WIDTH

    def counted(values):
        return np.bincount((block_values(values, order) + step).ravel(), minlength=BLOCKS << WIDTH)

    counts = _summed(fps, counted, BLOCKS << WIDTH).reshape(BLOCKS, 1 << WIDTH)
    near = np.stack([near_counts(c) for c in counts]).astype(np.float32)
    plans = [Plan(order, near, n, parts) for parts in (BLOCKS, BLOCKS // 2)]
    costs = _summed(fps, lambda values: np.array([p.thresholds(values)[1].sum() for p in plans]).astype(np.int64), len(plans))
    return plans[int(costs.argmin())]


# index and probes

INDEX, ASKS = 1, 2


def entries(fps: DataFrame, by: Plan) -> DataFrame:
    """key, fp, role: every class under its value of each partition, and under every value that it probes."""

    def run(batches):
        changes = {t: by.masks(t) for t in range(FAR + 1)}
        for batch in batches:
            all_ = _values(batch)
            # a slice's widest probing: every class with all single and double changes of a partition
            for i in range(0, len(all_), 1024):
                values = all_[i : i + 1024]
                value, limit = by.keys(values), by.thresholds(values)[0]
                for p in range(by.parts):
                    name = np.uint64(p) << np.uint64(by.width)
                    own = np.where(limit[:, p] >= 0, INDEX | ASKS, INDEX)
                    yield _entry(value[:, p] | name, values, own)
                    for t in range(1, FAR + 1):
                        some = np.flatnonzero(limit[:, p] == t)
                        if len(some):
                            probed = (value[some, p][:, None] ^ changes[t][None, :]) | name
                            yield _entry(probed.ravel(), np.repeat(values[some], len(changes[t])), np.full(probed.size, ASKS))

    return fps.mapInArrow(run, "key long, fp long, role int")


def _entry(key, fp, role):
    return pa.record_batch(
        [pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(role.astype(np.int32))], ["key", "fp", "role"]
    )


def _dealt(rows: DataFrame, cell: int) -> DataFrame:
    """The entries with the cells (i, j) they take part in: indexed block i against probing block j of a bucket."""
    blocks = lambda role: F.ceil(F.sum(F.when(F.col("role").bitwiseAND(role) > 0, 1).otherwise(0)) / cell)
    heavy = rows.groupBy("key").agg(blocks(INDEX).alias("ni"), blocks(ASKS).alias("nj")).where("ni + nj > 2 OR (ni + nj > 1 AND least(ni, nj) = 0)")
    heavy = common.materialize(heavy, "simhash")
    mine = lambda count, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(count)).cast("int")
    cells = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))
    as_index = F.transform(F.sequence(F.lit(0).cast("long"), F.col("nj") - 1), lambda j: cells(mine("ni", 1), j, INDEX))
    asking = F.transform(F.sequence(F.lit(0).cast("long"), F.col("ni") - 1), lambda i: cells(i, mine("nj", 2), ASKS))
    nothing = F.array().cast("array<struct<i:int,j:int,role:int>>")
    spread = F.concat(
        F.when(F.col("role").bitwiseAND(INDEX) > 0, as_index).otherwise(nothing),
        F.when(F.col("role").bitwiseAND(ASKS) > 0, asking).otherwise(nothing),
    )
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("role").alias("role")))
    # a bucket that nobody asks, or that holds nobody, is left out
    tagged = rows.join(heavy, "key", "left").where("ni IS NULL OR least(ni, nj) > 0")
    return tagged.select("key", "fp", F.explode(F.when(F.col("ni").isNull(), whole).otherwise(spread)).alias("x")).select("key", "x.i", "x.j", "fp", "x.role")


# verification

def compare(fp: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what one cell's pairs within FAR bits connect: at most one for each class."""
    nodes, at = np.unique(fp, return_inverse=True)
    indexed, asking = np.unique(at[role & INDEX > 0]), np.unique(at[role & ASKS > 0])
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    step = max(1, HELD // max(len(indexed), 1))
    for i in range(0, len(asking), step):
        part = asking[i : i + step]
        x, y = np.nonzero(np.bitwise_count(nodes[part][:, None] ^ nodes[indexed][None, :]) <= FAR)
        a, b = np.concatenate([a, part[x]]), np.concatenate([b, indexed[y]])
        if len(a) > 4 * len(nodes):
            label = forest(len(nodes), a, b)
            a = np.flatnonzero(label != np.arange(len(nodes)))
            b = label[a]
    label = forest(len(nodes), a, b)
    a = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[a], nodes[label[a]]


def _compare_small(group: np.ndarray, fp: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All links within many groups of at most SMALL entries; group: ascending numbers."""
    first = np.searchsorted(group, group)
    size = np.searchsorted(group, group, side="right") - first
    a = np.repeat(np.arange(len(group)), size)
    b = np.repeat(first, size) + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
    good = (role[a] & ASKS > 0) & (role[b] & INDEX > 0) & (fp[a] != fp[b])
    a, b = a[good], b[good]
    good = np.bitwise_count(fp[a] ^ fp[b]) <= FAR
    return fp[a[good]], fp[b[good]]


def _links(dealt: DataFrame) -> DataFrame:
    """a, b: links between classes."""
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def emit(a, b):
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole cells."""
        table = table.combine_chunks()
        cell = [table.column(c).to_numpy() for c in ("key", "i", "j")]
        fp, role = table.column("fp").to_numpy().view(np.uint64), table.column("role").to_numpy()
        new = np.ones(len(fp), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cell], axis=0)
        group, begins = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(fp))
        size = np.diff(begins)
        light = (size <= SMALL)[group]
        if light.any():
            a, b = _compare_small(group[light], fp[light], role[light])
            if len(a):
                yield emit(a, b)
        for g in np.flatnonzero(size > SMALL):
            a, b = compare(fp[begins[g] : begins[g + 1]], role[begins[g] : begins[g + 1]])
            if len(a):
                yield emit(a, b)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = [batch.column(c).to_numpy() for c in range(3)]
            if held and [held[-1].column(c)[-1].as_py() for c in range(3)] != [c[0] for c in cell]:
                yield from judge(pa.Table.from_batches(held))
                held = []
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cell], axis=0)) + 1
            if len(cuts):
                # all cells but the last are whole here
                yield from judge(pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))]))
                held = [batch.slice(int(cuts[-1]))]
            else:
                held.append(batch)
        if held:
            yield from judge(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, "a long, b long").distinct()


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """a, b: links between distinct fingerprints (fp) that connect all within FAR bits of each other."""
    n = fps.count()
    return _links(_dealt(entries(fps, plan(fps, n)), cell))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    rows = common.materialize(fingerprints(docs, id_col, text_col), "simhash")
    classes = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash")
    found = components(common.materialize(links(classes.select("fp"), cell), "simhash"))
    of = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    # written, so that the joins below deal out both sides anew and one large component can be split
    of = common.materialize(of, "simhash")
    roots = common.materialize(of.groupBy("root").agg(F.min("least").alias("component_id")), "simhash")
    named = common.materialize(of.join(roots, "root").select("fp", "component_id"), "simhash")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
