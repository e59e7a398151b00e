"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import (
    centroids, decontaminate, exact_topk, language_id, line_dedup, merkle_manifest, minhash_dedup, resharding, secret_scan,
    sentencepiece_codec, simhash_dedup, substring_dedup, suffix_dedup,
)
from vigil.llm.common import materialize, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]

#: The model among the public tokenizers' files.
PIECE_MODEL = "piece_bpe_32k.model"


def model_path(name: str = PIECE_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark, d):
    return sentencepiece_codec.digests(table(spark, d, "documents"), model_path())


def op2_secret_scan(spark, d):
    return secret_scan.digests(secret_scan.scan(table(spark, d, "documents")))


def op3_decontaminate(spark, d):
    return decontaminate.matches(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op4_line_dedup(spark, d):
    return line_dedup.digests(table(spark, d, "documents"))


def op5_minhash_dedup(spark, d):
    return minhash_dedup.near_duplicates(table(spark, d, "documents"), share=75).drop("text_key")


def op6_language_id(spark, d):
    docs = table(spark, d, "documents")
    return language_id.predict(docs, language_id.fit(docs)).withColumn("held_out", language_id.held_out())


def op7_exact_topk(spark, d):
    return exact_topk.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op8_resharding(spark, d):
    """From shards by source, of very unequal sizes, to 40 shards of equal size; places as read back from the rewritten files."""
    docs, old, shards = table(spark, d, "documents"), F.crc32(F.col("source").cast("binary")), 40
    moved = materialize(resharding.reshard(docs, old, shards), "reshard")
    path = shared_dir(spark, "shards")
    touched = resharding.rewrite(docs, moved, path, old_shard=old, shards=shards)
    return resharding.placed(docs, moved, path, touched).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_substring_dedup(spark, d):
    return substring_dedup.digests(table(spark, d, "documents"))


def op10_suffix_dedup(spark, d):
    return suffix_dedup.digests(table(spark, d, "documents"))


def op11_simhash_dedup(spark, d):
    return simhash_dedup.near_duplicates(table(spark, d, "documents"))


def op12_merkle_manifest(spark, d):
    return merkle_manifest.audit(table(spark, d, "documents"))


def op13_centroid_clustering(spark, d):
    return centroids.report(table(spark, d, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_secret_scan, op3_decontaminate, op4_line_dedup,
        op5_minhash_dedup, op6_language_id, op7_exact_topk, op8_resharding, op9_substring_dedup,
        op10_suffix_dedup, op11_simhash_dedup, op12_merkle_manifest, op13_centroid_clustering,
    )
}
_in = lambda values: ", ".join(f"'{v}'" for v in values)
_number = lambda c: f"(({c} >= '0' AND {c} < ':') OR {c} IN ({_in(decontaminate.NUMBER_WORDS)}))"
_EDGES = decontaminate.EDGES.replace("'", "''")

_field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
_leaf = lambda text: "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
#: CRC-32 bit by bit: every byte is mixed in, then shifted out in eight steps (-1).
_crc32 = lambda c: (
    "xor(4294967295, list_reduce(flatten(list_transform(string_split(" + c + ", ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), "
    "lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END, 4294967295::BIGINT))"
)
#: The rounds one after the other: the assignment to the centroids of a round, then its centroids.
_ROUNDS = "\n".join(
    f"""
        a{r} AS MATERIALIZED (
            SELECT v.at, min_by(k, (d, k)) AS k, min(d) AS d FROM (
                SELECT v.at, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
                FROM v, c{r} c
            ) v GROUP BY v.at
        ),
        c{r + 1} AS MATERIALIZED (
            SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
                SELECT k, list(x ORDER BY i) AS x FROM (
                    SELECT k, i, floor(sum(y)::DOUBLE / count(*))::BIGINT AS x FROM (
                        SELECT a.k, unnest(v.x) AS y, generate_subscripts(v.x, 1) AS i FROM a{r} a JOIN v ON a.at = v.at
                    ) GROUP BY k, i
                ) GROUP BY k
            ) m ON m.k = c.k
        ),"""
    for r in range(centroids.ROUNDS + 1)
)

ORACLES: dict[str, str] = {
    "op3_decontaminate": rf"""
        WITH src AS (
            SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL
            UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE text IS NOT NULL
        ),
        w AS (SELECT side, id, regexp_split_to_array(trim(text, e' \t\n\x0b\f\r'), '[\x20\t-\r]+') AS words FROM src),
        t AS (SELECT side, id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
        r AS (SELECT *, trim(lower(word), '{_EDGES}') AS raw FROM t),
        p AS (
            SELECT *, lag(raw) OVER before AS praw, lag(word) OVER before AS pword FROM r
            WINDOW before AS (PARTITION BY side, id ORDER BY i)
        ),
        k AS (
            SELECT side, id, i, raw, CASE
                WHEN {_number('raw')} THEN '{decontaminate.NUM}'
                WHEN raw IN ({_in(decontaminate.UNITS)}) AND {_number('praw')} THEN '{decontaminate.UNIT}'
                WHEN substr(word, 1, 1) <> lower(substr(word, 1, 1)) AND substr(word, 2) = lower(substr(word, 2))
                    AND right(pword, 1) NOT IN ('.', '!', '?') THEN '{decontaminate.NAME}'
                ELSE raw END AS word
            FROM p
        ),
        whole AS (SELECT side, id, list(word ORDER BY i) AS word, list(raw ORDER BY i) AS raw, any_value(first) FILTER (i = 1) AS first FROM (
            SELECT k.*, r.word AS first FROM k JOIN r USING (side, id, i)
        ) GROUP BY side, id),
        -- the first word of an item in the other forms that it has behind other words
        arr AS (
            SELECT side, id, word, raw, NULL AS must FROM whole
            UNION ALL
            SELECT side, id, list_prepend(form, word[2 :]), raw, raw[1] FROM (
                SELECT *, unnest([
                    CASE WHEN substr(first, 1, 1) <> lower(substr(first, 1, 1)) AND substr(first, 2) = lower(substr(first, 2)) THEN '{decontaminate.NAME}' END,
                    CASE WHEN raw[1] IN ({_in(decontaminate.UNITS)}) THEN '{decontaminate.UNIT}' END
                ]) AS form FROM whole WHERE side = 'b' AND NOT {_number('raw[1]')}
            ) WHERE form IS NOT NULL
        ),
        lengths AS (
            SELECT DISTINCT least(len(word), {decontaminate.WINDOW}) AS n FROM arr
            WHERE side = 'b' AND len(word) >= {decontaminate.LEAST_WORDS}
        ),
        g AS (
            SELECT side, id, n, must, unnest(list_transform(range(1, CASE WHEN must IS NULL THEN len(word) - n + 2 ELSE 2 END), lambda j: {{
                'at': j, 'h': array_to_string(word[j : j + n - 1], ' '), 'words': word[j : j + n - 1], 'raw': raw[j : j + n - 1]
            }})) AS x
            FROM arr JOIN lengths ON len(word) >= n
            WHERE side = 'd' OR (least(len(word), {decontaminate.WINDOW}) = n AND len(word) >= {decontaminate.LEAST_WORDS})
        ),
        pairs AS (
            SELECT d.id AS doc_id, b.id AS item_id, b.x.at AS item_at, d.x.at - b.x.at AS shift, d.n,
                   list_filter(range(1, d.n + 1), lambda i: starts_with(d.x.words[i], '{decontaminate.NAME[0]}')) AS free,
                   d.x.raw AS now, b.x.raw AS was
            FROM g d JOIN g b ON d.side = 'd' AND b.side = 'b' AND d.n = b.n AND d.x.h = b.x.h
            WHERE b.must IS NULL OR d.x.raw[1] = b.must
        ),
        good AS (SELECT * FROM pairs WHERE (2 * len(free) <= n AND n >= {decontaminate.LEAST_TEMPLATE}) OR now = was),
        slot AS (SELECT doc_id, item_id, shift, was[i] AS was, now[i] AS now FROM (SELECT *, unnest(free) AS i FROM good)),
        judged AS (
            SELECT doc_id, item_id, shift, bool_or(lo <> hi) AS broken, count(*) FILTER (lo <> was) AS replaced
            FROM (SELECT doc_id, item_id, shift, was, min(now) AS lo, max(now) AS hi FROM slot GROUP BY ALL) GROUP BY ALL
        ),
        found AS (
            SELECT g.doc_id, g.item_id, count(DISTINCT item_at) AS n_matched, max(n) AS words, min(coalesce(replaced, 0)) AS n_replaced
            FROM good g LEFT JOIN judged j ON g.doc_id = j.doc_id AND g.item_id = j.item_id AND g.shift = j.shift
            WHERE NOT coalesce(broken, false) GROUP BY ALL
        )
        SELECT doc_id, item_id, (len(a.word) - least(len(a.word), {decontaminate.WINDOW}) + 1)::BIGINT AS n_windows,
               n_matched::BIGINT AS n_matched, n_replaced::BIGINT AS n_replaced,
               2 * n_matched >= (len(a.word) - least(len(a.word), {decontaminate.WINDOW}) + 1)
                   OR n_matched + words - 1 >= {decontaminate.COVERED} AS contaminated
        FROM found JOIN whole a ON a.side = 'b' AND a.id = item_id
    """,
    "op4_line_dedup": f"""
        WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
        pair AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM line),
        again AS (
            SELECT doc_id, i FROM (
                SELECT doc_id, i, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) AS r
                FROM pair WHERE next IS NOT NULL
            ) WHERE r > 1
        ),
        single AS (
            SELECT doc_id, i FROM (
                SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS r
                FROM line WHERE strlen(line) >= {line_dedup.ALONE_BYTES}
            ) WHERE r > 1
        ),
        gone AS (SELECT doc_id, i FROM again UNION SELECT doc_id, i + 1 FROM again UNION SELECT doc_id, i FROM single),
        kept AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n
            FROM line ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(len(d.lines), 0)::BIGINT AS n_lines,
               (coalesce(len(d.lines), 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
               sha256(coalesce(k.text, '')) AS kept_sha256
        FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
    "op5_minhash_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
            ) AS w FROM documents
        ),
        s AS (
            SELECT doc_id, CASE
                WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh
            FROM d
        ),
        e AS (SELECT doc_id, unnest(sh) AS x, len(sh) AS n FROM s),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id
            HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
        ),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS node, doc_id AS c FROM d UNION SELECT b, c FROM reach JOIN both_ways ON node = a)
        SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, r.c AS component_id, r.c = s.doc_id AS kept
        FROM s JOIN (SELECT node, min(c) AS c FROM reach GROUP BY node) r ON s.doc_id = r.node
    """,
    "op7_exact_topk": """
        WITH rows AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, r.vec_id,
                   list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM rows q JOIN rows r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        ) WHERE rank <= 20
    """,
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        win AS (
            SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda j: md5(array_to_string(w[j : j + 49], ' ')))) AS h
            FROM d WHERE len(w) >= 50
        ),
        lo AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN lo USING (h) WHERE doc_id > lo),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
            FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(k.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
    "op10_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        win AS (
            SELECT doc_id, unnest(range(1, octet_length(b) - 198)) AS i,
                   unnest(list_transform(range(1, octet_length(b) - 198), lambda j: md5(array_slice(b, j, j + 199)))) AS h
            FROM d WHERE octet_length(b) >= 200
        ),
        again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
        hit AS (SELECT doc_id, i FROM win SEMI JOIN again USING (h)),
        mark AS (SELECT doc_id, i, i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS new FROM hit),
        run AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM mark),
        span AS (SELECT doc_id, r, min(i) AS s, max(i) + 200 AS e FROM run GROUP BY doc_id, r),
        cut AS (SELECT doc_id, list(s ORDER BY s) AS starts, list(e ORDER BY s) AS ends, sum(e - s) AS gone FROM span GROUP BY doc_id),
        kept AS (
            SELECT d.doc_id, b, starts, coalesce(gone, 0) AS gone,
                   list_zip(list_prepend(1, ends), list_append(starts, octet_length(b) + 1)) AS parts
            FROM d LEFT JOIN cut USING (doc_id)
        )
        SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, gone::BIGINT AS n_removed, coalesce(len(starts), 0)::BIGINT AS n_spans,
               CASE WHEN starts IS NULL THEN sha256(b)
               ELSE sha256(unhex(array_to_string(list_transform(parts, lambda p: hex(array_slice(b, p[1], p[2] - 1))), ''))) END AS kept_sha256
        FROM kept
    """,
    "op12_merkle_manifest": rf"""
        WITH RECURSIVE src AS (
            SELECT doc_id, source, lang, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                   coalesce('s' || source, '') AS part, coalesce({_crc32('doc_id::VARCHAR')} % 5 = 0, false) AS hit
            FROM documents
        ),
        leaf AS (
            SELECT doc_id, part, h, CASE WHEN hit THEN forged ELSE h END AS start,
                   row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY part) AS n
            FROM (SELECT doc_id, part, hit, {_leaf('text')} AS h, {_leaf('low')} AS forged FROM src)
        ),
        node AS (
            SELECT part, 0 AS lvl, idx, h, n FROM leaf
            UNION ALL
            SELECT part, any_value(lvl) + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 15) // 16
            FROM node WHERE n > 1 GROUP BY part, idx // 16
        ),
        sub AS (SELECT part, lvl, h, row_number() OVER (ORDER BY part) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
        top AS (
            SELECT 0 AS lvl, idx, h, n FROM sub
            UNION ALL
            SELECT any_value(lvl) + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 15) // 16
            FROM top WHERE n > 1 GROUP BY idx // 16
        ),
        beside AS (
            SELECT a.part, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
                   coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
            FROM node a JOIN node b ON a.part = b.part AND a.lvl = b.lvl AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY ALL
        ),
        above AS (
            SELECT a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
                   coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
            FROM top a JOIN top b ON a.lvl = b.lvl AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY ALL
        ),
        step AS (
            SELECT part, idx AS at, lvl, idx, h, start AS f, '' AS seen FROM leaf, (SELECT 0 AS lvl)
            UNION ALL
            SELECT s.part, s.at, s.lvl + 1, s.idx // 16, s.h, sha256(b.l || s.f || b.r), s.seen || b.l || b.r
            FROM step s JOIN beside b ON s.part = b.part AND s.lvl = b.lvl AND s.idx = b.idx
        ),
        up AS (
            SELECT s.part, s.at, s.h, sub.h AS subroot, 0 AS lvl, sub.idx, s.f, s.seen FROM step s JOIN sub ON s.part = sub.part AND s.lvl = sub.lvl
            UNION ALL
            SELECT u.part, u.at, u.h, u.subroot, u.lvl + 1, u.idx // 16, sha256(b.l || u.f || b.r), u.seen || b.l || b.r
            FROM up u JOIN above b ON u.lvl = b.lvl AND u.idx = b.idx
        )
        SELECT doc_id, u.h AS leaf, subroot, top.h AS root, sha256(seen) AS proof_sha256, f AS folded_root, f = top.h AS verified
        FROM up u JOIN top ON top.n = 1 AND u.lvl = top.lvl JOIN leaf ON leaf.part = u.part AND leaf.idx = u.at
    """,
    "op13_centroid_clustering": f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) AS at, vec_id,
                   list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS x
            FROM embeddings
            WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id), x) - 1 AS k, x FROM v
            WHERE vec_id IS NOT NULL ORDER BY sha256('{centroids.SEED}:' || vec_id), x LIMIT {centroids.CLUSTERS}
        ),{_ROUNDS}
        total AS (SELECT k, sum(d)::BIGINT AS s FROM a{centroids.ROUNDS} GROUP BY k)
        SELECT vec_id, a.k::INTEGER AS cluster, a.d AS distance, total.s AS cluster_inertia, (SELECT sum(s) FROM total)::BIGINT AS inertia,
               sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{centroids.ROUNDS} a JOIN v ON a.at = v.at JOIN c{centroids.ROUNDS} c ON c.k = a.k JOIN total ON total.k = a.k
    """,
}
