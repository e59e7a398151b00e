"""Language identification by nearest centroids.

A text becomes a normalised TF-IDF vector of hashed letter n-grams (1 to 3 bytes of the
lower-cased text, runs of anything but letters taken as one space). Several spherical k-means
centroids per language stand for its varieties; the language of the nearest centroid by cosine
is predicted. A text that is farther from its centroid than any training text of its length
class was, by a margin, is rejected.

The model is fitted on a sample of labelled rows bounded by `max_train_rows` in all (shared
equally by the languages), chosen by a hash of the id: a documented bound of the classifier.
Everything else reads all rows and whole texts.

Defined cases: a null text and a text without a letter (of any script; number characters such as `²` or `½` are
none) are `und` with score 0 and rejected; rows
with a null language or id don't train; a null id is not held out; ties go to the language that
sorts first; without any labelled row all is `und`. Only id, text and language are read, the
last in training only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm import common

DIMS, CENTROIDS, ROUNDS = 4096, 4, 12
MAX_TRAIN_ROWS = 2400
#: Bytes of text whose n-grams are counted at once.
SLICE = 1_000_000
#: Texts whose dense vectors are held at once.
ROWS = 128
#: A text is rejected below this share of the least cosine seen in training in its length class.
MARGIN = 0.5
_LETTER = regex.compile(r"\p{L}")
# lower-case ASCII letters and bytes beyond ASCII stay; all else is a space
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams, one row for each text."""
    n = len(offsets) - 1
    if n == 1 and len(data) > 2 * SLICE:  # a very long text in parts; n-grams over their borders are left out
        parts = [data[i : i + SLICE] for i in range(0, len(data), SLICE)]
        return sum(features(p, np.array([0, len(p)])) for p in parts)
    flat = _FOLD[data]
    out = np.zeros(n * DIMS, np.float32)
    if not len(flat):
        return out.reshape(n, DIMS)
    # the second byte of most accented capitals differs from the small letter's by 32
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = flat[lead + 1]
    flat[lead + 1] = np.where((second >= 0x80) & (second < 0x9F), second + 32, second)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    blank = flat == 32
    keep = np.ones(len(flat), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
    flat, row = flat[keep].astype(np.int64), row[keep]
    for size in (1, 2, 3):
        if len(flat) < size:
            break
        end = len(flat) - size + 1
        gram = np.full(end, size, np.int64)
        for k in range(size):
            gram = gram * 257 + flat[k : k + end]
        same = row[:end] == row[size - 1 :]
        bucket = ((gram * 0x9E3779B1) >> 12) & (DIMS - 1)
        out += np.bincount((row[:end] * DIMS + bucket)[same], minlength=n * DIMS)
    return out.reshape(n, DIMS)


def _normal(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _normal(np.log1p(counts) * idf)


def length_class(grams: np.ndarray) -> np.ndarray:
    """Doublings of the number of n-grams."""
    return np.minimum(np.log2(np.maximum(grams, 1)).astype(int), 31)


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(seeds) < min(k, len(x)):
        nearest = (x @ x[seeds].T).max(axis=1)
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-9:
            break
        seeds.append(far)
    centres = x[seeds]
    for _ in range(ROUNDS):
        owner = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[owner == c].sum(axis=0) if (owner == c).any() else centres[c] for c in range(len(centres))])
        centres = _normal(sums)
    return centres.astype(np.float32)


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the rows that never trains."""
    crc = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    return F.coalesce(crc % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train_rows: int = MAX_TRAIN_ROWS) -> dict:
    """The model: languages, IDF, centroids and the language of each, least cosine by length class."""
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    usable = ids.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    langs = max(1, usable.select("lang").distinct().count())
    each = max(1, max_train_rows // langs)
    # rows come in the order of their hashes; a share of the hashes that holds each language's first ones
    # with great certainty is ranked, so that the window over a frequent language stays small
    usable = usable.withColumn("h", F.xxhash64("doc_id"))
    share = F.least(F.lit(1.0), (each + 10 * F.sqrt(F.lit(float(each))) + 50) / F.count("*"))
    # written, so that its size is known and the rows need not be dealt out by language to meet it
    limit = common.materialize(usable.groupBy(F.col("lang").alias("of")).agg(share.alias("share")), "languages")
    near = usable.join(limit, F.col("lang") == F.col("of")).where(
        (F.col("share") == 1) | (F.col("h").cast("double") < F.col("share") * 2.0**64 - 2.0**63)
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = near.withColumn("r", rank).where(F.col("r") <= each).select("doc_id").distinct()

    def count(batches):
        for batch in batches:
            data, offsets = common.bytes_of(batch.column(0))
            for a, b, part, at in common.slices(data, offsets, SLICE):
                rows = features(part, at)
                used = [np.flatnonzero(r).astype(np.uint16) for r in rows]
                sparse = [u.tobytes() for u in used], [r[u].tobytes() for r, u in zip(rows, used)]
                yield pa.record_batch(
                    [batch.column(1)[a:b], *(pa.array(x, pa.binary()) for x in sparse)], ["lang", "at", "count"]
                )

    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # at most max_train_rows ids
    sample = texts.join(F.broadcast(chosen), "doc_id").select("text", "lang").mapInArrow(common.returning(count), "lang string, at binary, count binary")
    rows = sample.toArrow()
    if not rows.num_rows:
        return {"langs": [], "idf": None, "centres": None, "owner": None, "least": None}
    lang = np.array(rows.column(0).to_pylist())
    # repeated ids may bring more rows than asked for: the sample is put in a fixed order
    values = [np.frombuffer(v.as_py(), np.float32) for v in rows.column(2)]
    grams = np.array([v.sum() for v in values])
    order = [i for i in np.lexsort((grams, lang)) if grams[i] > 0]
    x = np.zeros((len(order), DIMS), np.float32)
    for row, i in enumerate(order):
        x[row, np.frombuffer(rows.column(1)[i].as_py(), np.uint16)] = values[i]
    lang, grams = lang[order], grams[order]
    if not len(lang):
        return {"langs": [], "idf": None, "centres": None, "owner": None, "least": None}
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1).astype(np.float32)
    # in place: this is the largest thing that the driver holds
    np.log1p(x, out=x)
    x *= idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names = sorted(set(lang.tolist()))
    per = [k_means(x[lang == name], CENTROIDS) for name in names]
    centres = np.concatenate(per)
    near = (x @ centres.T).max(axis=1)
    least = np.full(32, np.inf)
    np.minimum.at(least, length_class(grams), near)
    seen = np.isfinite(least)
    # classes without training texts take the least of all classes
    least[~seen] = least[seen].min()
    # a shorter text may not be judged more strictly than a longer one
    least = np.minimum.accumulate(least[::-1])[::-1]
    return {
        "langs": names, "idf": idf, "centres": centres,
        "owner": np.repeat(np.arange(len(names)), [len(c) for c in per]), "least": (least * MARGIN).astype(np.float32),
    }


def labelled(batches, model: dict):
    """(id, text) batches as (id, language, score, rejected) batches."""
    names = np.array(model["langs"] or ["und"], object)
    for batch in batches:
        texts = batch.column(1)
        lettered = np.fromiter((bool(t.is_valid and _LETTER.search(t.as_py())) for t in texts), bool, len(texts))
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        rejected = np.ones(len(texts), bool)
        data, offsets = common.bytes_of(texts)
        for a, b, part, at in common.slices(data, offsets, SLICE) if model["langs"] else ():
            for c in range(0, b - a, ROWS):
                rows = slice(a + c, min(a + c + ROWS, b))
                own = at[c : c + rows.stop - rows.start + 1]
                counts = features(part[own[0] : own[-1]], own - own[0])
                near = weighted(counts, model["idf"]) @ model["centres"].T
                best = np.argmax(near, axis=1)
                value = np.clip(near[np.arange(len(best)), best], 0, 1)
                ok = lettered[rows]
                lang[rows] = np.where(ok, names[model["owner"][best]], "und")
                score[rows] = np.where(ok, value, 0)
                rejected[rows] = ~ok | (value < model["least"][length_class(counts.sum(axis=1))])
        yield pa.record_batch(
            [batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rejected)],
            ["doc_id", "lang_pred", "score", "rejected"],
        )


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row."""
    return common.bounded(common.id_text(docs, id_col, text_col)).mapInArrow(
        common.returning(lambda batches: labelled(batches, model)), "doc_id long, lang_pred string, score double, rejected boolean"
    )


def keep(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text the model doesn't reject."""

    def filtered(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            small = pa.record_batch([pa.array(range(batch.num_rows), pa.int64()), text], ["doc_id", "text"])
            mask = pa.array(~_rejects(small, model))
            yield batch.filter(mask)

    return common.bounded(docs).mapInArrow(common.returning(filtered), docs.schema)


def _rejects(batch: pa.RecordBatch, model: dict) -> np.ndarray:
    out = next(iter(labelled([batch], model)))
    return out.column(3).to_numpy(zero_copy_only=False)
