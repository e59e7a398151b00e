"""The Merkle manifest against a plain tree in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from vigil.llm import merkle_manifest as mm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(r, text):
    fields = (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def slow_tree(hashes, fanout):
    """The root, and for every leaf its (left, right) siblings from below."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    paths = []
    for at in range(len(hashes)):
        path = []
        for level in levels[:-1]:
            begin = at // fanout * fanout
            path.append((level[begin:at], level[at + 1 : begin + fanout]))
            at //= fanout
        paths.append(path)
    return levels[-1][0] if hashes else None, paths


def slow(rows, fanout=16):
    parts = {}
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        low = None if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        h = slow_leaf(r, r["text"])
        parts.setdefault(r["source"], []).append((r["doc_id"], h, slow_leaf(r, low) if hit else h))
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = slow_tree([x[1] for x in parts[name]], fanout)
    root, above = slow_tree([trees[n][0] for n in names], fanout)
    out = []
    for name, up in zip(names, above):
        for (doc, leaf, start), path in zip(parts[name], trees[name][1]):
            seen, fold = "", start
            for left, right in path + up:
                seen += "".join(left + right)
                fold = H(*left, fold, *right)
            out.append((doc, leaf, trees[name][0], root, H(seen), fold, fold == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check(df, by_id, fanout=16):
    rows = [r.asDict() for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert by_id(mm.audit(df, fanout).select(*COLUMNS)) == slow(rows, fanout)


def test_awkward_documents(docs, clashing, by_id):
    check(docs, by_id)
    check(docs, by_id, fanout=2)
    assert by_id(mm.audit(clashing)) == by_id(mm.audit(docs))


@pytest.mark.parametrize("fanout", [3, 16])
def test_a_hot_source_and_many_small_ones(spark, by_id, fanout):
    sources = ["hot"] * 300 + [None] * 17 + [""] + [f"s{i}" for i in range(20)] + ["é", "z"] * 16
    rows = [(i * 7 % 401, f"Text {i} A" if i % 9 else None, None if i % 4 else "en", s, i) for i, s in enumerate(sources)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(6), by_id, fanout)


def test_one_row_and_none(spark, empty, by_id):
    assert mm.audit(empty).collect() == []
    check(spark.createDataFrame([(5, "One", "en", None, 3)], SCHEMA), by_id)
    check(spark.createDataFrame([(None, None, None, None, None)], SCHEMA), by_id)


def test_only_changed_rows_fail(spark):
    rows = [(i, "ABC" if i % 2 else "abc", "en", "s", 3) for i in range(200)]
    out = mm.audit(spark.createDataFrame(rows, SCHEMA)).collect()
    bad = {r.doc_id for r in out if not r.verified}
    assert bad == {i for i in range(200) if i % 2 and zlib.crc32(str(i).encode()) % 5 == 0}


def test_numbers_within_parts(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("part"), (-F.col("id")).alias("id"))
    out = mm.numbered(rows.repartition(7), ["id"]).collect()
    for part in "ab":
        mine = sorted((r.id, r.idx, r.n) for r in out if r.part == part)
        assert [i for _, i, _ in mine] == list(range(len(mine))) and {n for *_, n in mine} == {len(mine)}
