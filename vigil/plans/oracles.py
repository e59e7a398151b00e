"""The same results in plain SQL over the sample tables, for checking the queries."""

from __future__ import annotations

from vigil.functions.text import HEADER, SPACE
from vigil.operators import convo, templates
from vigil.plans import detection, queries as q
from vigil.sources.tables import DOC_BASE_MS


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _iso(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"


NL = "chr(10)"
SUSPECT = (
    "regexp_matches(message, "
    "'(?i)error|exception|timeout|failed|panic|oom|deadlock|throttle|5[0-9][0-9]')"
)

EV = (
    "ev AS (SELECT event_id::VARCHAR AS id, '/app/' || event_type AS log_group, "
    "'user-' || user_id AS log_stream, epoch_us(ts) // 1000 AS ts_ms, "
    "event_type || ' value=' || value || ' props=' || props AS message FROM events)"
)
DOC = (
    "doc AS (SELECT doc_id, doc_id::VARCHAR AS id, source AS log_group, lang AS log_stream, "
    f"{DOC_BASE_MS} + doc_id * 60000 AS ts_ms, text AS message FROM documents)"
)
QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]"
DOCV = (
    f"{DOC}, docv AS (SELECT doc.*, e.embedding, "
    f"list_cosine_distance(e.embedding::DOUBLE[], {QUERY}) AS dist "
    "FROM doc JOIN embeddings e ON e.vec_id = doc.doc_id)"
)
LOGS = (
    f"{EV}, {DOC}, logs AS (SELECT id, log_group, log_stream, ts_ms, message FROM ev "
    "UNION ALL SELECT 'd' || id, log_group, log_stream, ts_ms, message FROM doc)"
)
TICKED = (
    f"{LOGS}, ticked AS (SELECT *, ((ts_ms + {q.TICK - 1}) // {q.TICK}) * {q.TICK} AS tick_ms, "
    f"{SUSPECT} AS sus FROM logs WHERE length(message) >= 10)"
)
COUNTS = (
    f"{TICKED}, counts AS (SELECT tick_ms, log_group, count(*) AS n, "
    "count(*) FILTER (sus) AS n_suspects, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms "
    "FROM ticked GROUP BY ALL), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY tick_ms "
    "ORDER BY n DESC, first_ts_ms, log_group) AS rank FROM counts)"
)
SAMPLES = (
    "sampled AS (SELECT *, row_number() OVER (PARTITION BY tick_ms ORDER BY ts_ms, id) AS sample_no "
    "FROM ticked WHERE sus QUALIFY sample_no <= 5)"
)
CONTEXT = (
    f"{COUNTS}, {SAMPLES}, "
    "summary AS (SELECT tick_ms, min(first_ts_ms) AS first_ts_ms, max(last_ts_ms) AS last_ts_ms, "
    "sum(n)::BIGINT AS event_count, sum(n_suspects)::BIGINT AS suspect_count, "
    "list({'group': log_group, 'count': n} ORDER BY rank) FILTER (rank <= 5) AS aggregates, "
    "arg_min(log_group, rank) AS top_group FROM ranked GROUP BY tick_ms), "
    "listed AS (SELECT tick_ms, list({'id': id, 'log_group': log_group, 'log_stream': log_stream, "
    "'ts_ms': ts_ms, 'message': message} ORDER BY sample_no) AS samples FROM sampled GROUP BY tick_ms), "
    "context AS (SELECT s.*, coalesce(l.samples, []) AS samples "
    "FROM summary s LEFT JOIN listed l USING (tick_ms))"
)
SCORED = (
    "scored AS (SELECT tick_ms, log_group, n AS total, n_suspects AS suspects, "
    "round(n_suspects / n, 4) AS ratio, "
    "CASE WHEN n_suspects / n >= 0.5 THEN 'critical' WHEN n_suspects / n >= 0.25 THEN 'high' "
    "WHEN n_suspects / n >= 0.1 THEN 'medium' WHEN n_suspects / n >= 0.02 THEN 'low' "
    "ELSE 'info' END AS severity, "
    "round(n_suspects / (n_suspects + 5.0::DOUBLE), 4) AS confidence, "
    "n_suspects || ' suspect events in ' || log_group AS title, "
    "n_suspects || ' of ' || n || ' events matched' AS summary "
    "FROM counts WHERE n_suspects > 0)"
)
BUILT = (
    f"{CONTEXT}, {SCORED}, built AS (SELECT s.tick_ms AS now_ms, s.log_group AS ord, "
    "s.title || '|' || substr(sha1(substr(to_json(c.aggregates)::VARCHAR, 1, 300)), 1, 16) || '|' || "
    "strftime(make_timestamp(s.tick_ms * 1000), '%Y-%m-%dT%H') AS dedupe_key, "
    "s.log_group || '|' || s.severity AS group_key, "
    "'open' AS status, s.severity, s.title, s.summary, c.top_group AS affected_group, "
    "c.first_ts_ms, c.last_ts_ms, c.event_count, s.confidence, c.aggregates, c.samples, "
    "to_json(list_transform(c.samples, lambda x: x.id))::VARCHAR AS sample_ids, "
    "to_json({'aggregates': c.aggregates, 'sample_count': len(c.samples), "
    "'confidence': s.confidence, 'tags': ['rule']})::VARCHAR AS vector_context "
    "FROM scored s JOIN context c USING (tick_ms) "
    "WHERE s.severity <> 'info' AND s.confidence >= 0.15)"
)


def _fold(source: str) -> str:
    """Rows with one group key applied in the order (now_ms, ord)."""
    first = lambda c: f"arg_min({c}, {{'t': now_ms, 'o': ord}}) AS {c}"
    last = lambda c: f"arg_max({c}, {{'t': now_ms, 'o': ord}}) AS {c}"
    return (
        "SELECT substr(sha256(group_key), 1, 32) AS id, min(now_ms) AS created_ms, "
        f"max(now_ms) AS updated_ms, 'open' AS status, {first('severity')}, {first('title')}, "
        f"{last('summary')}, {last('affected_group')}, {first('first_ts_ms')}, "
        "max(last_ts_ms) AS last_ts_ms, sum(event_count)::BIGINT AS event_count, "
        f"{first('sample_ids')}, {last('vector_context')}, group_key AS dedupe_key, "
        f"min(now_ms) > {q.MID} AS created, max(now_ms) > {q.MID} AS touched "
        f"FROM {source} GROUP BY group_key"
    )


MERGED = f"{BUILT}, merged AS ({_fold('built')})"
ALERTS = (
    f"{MERGED}, firsts AS (SELECT *, '[' || upper(severity) || '][' || "
    "floor(confidence * 100 + 0.5)::BIGINT || '%] ' || title AS alert_title "
    f"FROM built QUALIFY min(now_ms) OVER (PARTITION BY group_key) > {q.MID} AND "
    "row_number() OVER (PARTITION BY group_key ORDER BY now_ms, ord) = 1), "
    "alerts AS (SELECT substr(sha256(group_key), 1, 32) AS incident_id, severity, "
    f"'*' || alert_title || '*' || {NL} || summary || {NL} || 'Groups: ' || "
    "array_to_string(list_transform(aggregates, lambda g: g.\"group\" || '(' || g.count || ')'), ', ') "
    f"|| {NL} || 'Samples: ' || len(samples) AS chat, substr(alert_title, 1, 100) AS subject, "
    "to_json({'id': substr(sha256(group_key), 1, 32), 'title': alert_title, 'severity': severity, "
    "'confidence': confidence, 'summary': summary, 'aggregates': aggregates, "
    "'samples': samples[1:2]})::VARCHAR AS topic FROM firsts), "
    "outbox AS (SELECT incident_id, 'slack' AS channel, severity, NULL AS subject, chat AS body FROM alerts "
    "UNION ALL SELECT incident_id, 'sns', severity, subject, topic FROM alerts)"
)

_trim = f"regexp_replace(line, '[{SPACE}]+\\z', '')"
LINES = (
    f"{DOC}, bodies AS (SELECT *, CASE WHEN log_stream = 'en' THEN {_iso('ts_ms')} || ' en [' || doc_id "
    "|| '] ' || message ELSE message END AS body FROM doc), "
    "raw AS (SELECT log_group AS file, doc_id AS chunk, "
    f"unnest(string_split(body, {NL})) AS line, "
    f"generate_subscripts(string_split(body, {NL}), 1) - 1 AS line_no FROM bodies), "
    f"parsed AS (SELECT file, chunk, line_no, {_trim} AS line, "
    f"regexp_matches({_trim}, {_lit(HEADER)}) AS is_header FROM raw), "
    "header AS (SELECT *, "
    f"CASE WHEN is_header THEN epoch_us(regexp_extract(line, {_lit(HEADER)}, 1)::TIMESTAMP) // 1000 END AS ts_ms, "
    f"CASE WHEN is_header THEN regexp_extract(line, {_lit(HEADER)}, 2) END AS log_stream, "
    f"CASE WHEN is_header THEN regexp_extract(line, {_lit(HEADER)}, 3) ELSE line END AS part FROM parsed)"
)

_result = (
    "id, log_group, log_stream, ts_ms, message, round(dist, 6) + 0.0 AS distance, "
    "round(1 - dist, 6) + 0.0 AS score"
)
_PAIRS = (
    "queries AS (SELECT label::VARCHAR AS qid, arg_min(embedding, vec_id) AS query FROM embeddings GROUP BY label), "
    "pairs AS (SELECT qid, vec_id::VARCHAR AS id, "
    "list_cosine_distance(embedding::DOUBLE[], query::DOUBLE[]) AS dist FROM queries, embeddings), "
    "best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM pairs)"
)
_VIEW = (
    "id, ts_ms, substr(log_group, 1, 19) AS log_group, substr(log_stream, 1, 19) AS log_stream, "
    "substr(message, 1, 59) AS message"
)
_CATALOG = (
    "SELECT log_group, count(*) AS n, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms FROM logs"
)
_USABLE = "coalesce(len(list_filter(embedding, lambda x: coalesce(x, 0) <> 0)) > 0, false)"
_LEFT = (
    f"{DOC}, docl AS (SELECT doc.*, e.embedding FROM doc LEFT JOIN embeddings e ON e.vec_id = doc.doc_id), "
    f"judged AS (SELECT *, {_USABLE} AS usable, "
    f"coalesce(regexp_matches(message, '[^{SPACE}]'), false) AS filled FROM docl)"
)
_TEMPLATE = (
    "regexp_replace(regexp_replace(regexp_replace(message, "
    "'[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<uuid>', 'g'), "
    "'0x[0-9a-fA-F]+', '<hex>', 'g'), '[0-9]+', '<n>', 'g')"
)


def _cut(n: int, keep: int) -> str:
    return f"CASE WHEN length(message) > {n} THEN substr(message, 1, {keep}) || '...' ELSE message END"


_TAG = (
    "CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN "
    "'<|im_' || role || '|>' || role || '<|im_middle|>' || text || '<|im_end|>' ELSE '' END"
)
_ASSISTANT = _lit(convo.TAG_OPEN.format(role="assistant"))
_PROMPT_LINES = (
    "list_transform(samples, lambda s: '- [' || "
    + _iso("s.ts_ms")
    + " || '] ' || s.log_group || ' ' || s.log_stream || ': ' || CASE WHEN length(s.message) > 500 "
    "THEN substr(s.message, 1, 497) || '...' ELSE s.message END)"
)
_GAP = f"{q.SESSION_GAP_MS}"


_PANES = (
    f"WITH {LOGS}, w AS (SELECT *, {SUSPECT} AS sus, unnest(range(pane, pane + {q.LOOK_BACK_MS}, {q.PANE_MS})) AS window_ms FROM "
    f"(SELECT *, (ts_ms + {q.PANE_MS - 1}) // {q.PANE_MS} * {q.PANE_MS} AS pane FROM logs)) "
    "SELECT window_ms, log_group, count(*) AS n, count(*) FILTER (sus) AS n_suspects, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms, "
    "round(count(*) FILTER (sus) / count(*), 6) + 0.0 AS rate FROM w GROUP BY window_ms, log_group"
)
#: A word stays if so many messages of its node have it.
_FIXED = f"here >= least({templates.LEAST}, total) AND here * {templates.PARTS} >= total"


def _sessions(source: str) -> str:
    return (
        f"hits AS (SELECT log_group, ts_ms FROM {source} WHERE {SUSPECT}), "
        "marked AS (SELECT *, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY log_group ORDER BY ts_ms) "
        f"> {_GAP}, true)::INT AS opens FROM hits), "
        "numbered AS (SELECT *, sum(opens) OVER (PARTITION BY log_group ORDER BY ts_ms) AS no FROM marked), "
        "sessions AS (SELECT log_group, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms, "
        "count(*) AS n FROM numbered GROUP BY log_group, no)"
    )


_NEAREST = f"WITH {DOCV} SELECT {_result} FROM docv WHERE length(message) >= 32 ORDER BY dist, id LIMIT 20"

# Word counts by slot, as the hash embedder makes them.
_SLOTS = (
    f"{DOC}, doc_word AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(message), "
    "'[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS w FROM doc), "
    f"slot AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {q.DIM} AS s, count(*)::DOUBLE AS n FROM doc_word GROUP BY ALL)"
)
_ASKED = (
    "asked AS (SELECT unnest(list_filter(regexp_split_to_array(lower((SELECT arg_min(text, item_id) FROM benchmark)), "
    "'[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS w), "
    f"wanted AS (SELECT ('0x' || substr(md5(w), 1, 8))::BIGINT % {q.DIM} AS s, count(*)::DOUBLE AS n FROM asked GROUP BY ALL)"
)

_TERMS = "list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')"
_BM25 = (
    f"text AS (SELECT id, {_TERMS.format(text='message')} AS w FROM doc), "
    "size AS (SELECT count(*) AS rows, greatest(sum(len(w)), 1) AS words FROM text), "
    "post AS (SELECT term, id, l, count(*) AS tf FROM (SELECT id, len(w) AS l, unnest(w) AS term FROM text) GROUP BY ALL), "
    f"query AS (SELECT DISTINCT unnest({_TERMS.format(text='(SELECT arg_min(text, item_id) FROM benchmark)')}) AS term), "
    "hit AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM post SEMI JOIN query USING (term)), "
    "scored AS (SELECT id, round(sum(ln(1 + (rows - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE "
    "/ (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / (words::DOUBLE / rows)))), 9) AS score FROM hit, size GROUP BY id)"
)

_EVENTS = (
    f"WITH {DOC}, raw AS (SELECT log_group, log_stream, ts_ms, doc_id, "
    f"unnest(string_split('[' || doc_id || '] ' || message, {NL})) AS line, "
    f"generate_subscripts(string_split('[' || doc_id || '] ' || message, {NL}), 1) AS line_no FROM doc), "
    f"cut AS (SELECT * REPLACE ({_trim} AS line) FROM raw) "
    f"SELECT log_group, log_stream, ts_ms, string_agg(line, {NL} ORDER BY line_no) AS message "
    "FROM cut WHERE line <> '' GROUP BY log_group, log_stream, ts_ms, doc_id"
)

ORACLES: dict[str, str] = {
    "embed_hash": (
        f"WITH {_SLOTS}, total AS (SELECT id, sqrt(sum(n * n)) AS len, max(n) AS top FROM slot GROUP BY id) "
        f"SELECT doc.id, {q.DIM} AS dim, CASE WHEN len IS NULL THEN 0.0 ELSE 1.0 END AS norm, "
        "round(coalesce(top / len, 0.0), 5) + 0.0 AS largest FROM doc LEFT JOIN total USING (id)"
    ),
    "search_by_text": (
        f"WITH {_SLOTS}, {_ASKED}, len AS (SELECT id, sqrt(sum(n * n)) AS len FROM slot GROUP BY id), "
        "dot AS (SELECT id, sum(slot.n * wanted.n) AS dot FROM slot JOIN wanted USING (s) GROUP BY id), "
        "found AS (SELECT doc.*, 1 - coalesce(dot, 0) / (len * (SELECT sqrt(sum(n * n)) FROM wanted)) AS dist "
        "FROM doc JOIN len USING (id) LEFT JOIN dot USING (id) WHERE length(message) >= 32) "
        f"SELECT {_result} FROM found ORDER BY round(dist, 6), id LIMIT 20"
    ),
    "lexical_search": f"WITH {DOC}, {_BM25} SELECT id, round(score, 6) + 0.0 AS score FROM scored ORDER BY scored.score DESC, id LIMIT 20",
    "fused_search": (
        f"WITH {_SLOTS}, {_ASKED}, {_BM25}, len AS (SELECT id, sqrt(sum(n * n)) AS len FROM slot GROUP BY id), "
        "dot AS (SELECT id, sum(slot.n * wanted.n) AS dot FROM slot JOIN wanted USING (s) GROUP BY id), "
        "near AS (SELECT id, round(1 - coalesce(dot, 0) / (len * (SELECT sqrt(sum(n * n)) FROM wanted)), 6) AS dist "
        "FROM doc JOIN len USING (id) LEFT JOIN dot USING (id) WHERE length(message) >= 32), "
        "v AS (SELECT id, row_number() OVER (ORDER BY dist, id) AS r FROM near QUALIFY r <= 50), "
        "l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM scored QUALIFY r <= 50) "
        "SELECT id, round(coalesce(1.0::DOUBLE / (60 + l.r), 0) + coalesce(1.0::DOUBLE / (60 + v.r), 0), 9) + 0.0 AS score, "
        "l.r::INTEGER AS by_words, v.r::INTEGER AS by_vector FROM l FULL JOIN v USING (id) "
        "ORDER BY coalesce(1.0::DOUBLE / (60 + l.r), 0) + coalesce(1.0::DOUBLE / (60 + v.r), 0) DESC, id LIMIT 20"
    ),
    # the exact ten nearest: the index is held to them
    "ann_search": f"WITH {DOCV} SELECT {_result} FROM docv ORDER BY dist, id LIMIT 10",
    "cosine_distance": (
        f"SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], {QUERY}), 6) + 0.0 AS distance "
        "FROM embeddings"
    ),
    "semantic_search": _NEAREST,
    "cell_search": _NEAREST,
    "search_filtered": (
        f"WITH {DOCV} SELECT {_result} FROM docv WHERE length(message) >= 32 AND log_group = 'src7' "
        f"AND ts_ms >= {q.DOC_AS_OF - 10 * 3_600_000} ORDER BY dist, id LIMIT 10"
    ),
    "multi_search": (
        f"WITH {_PAIRS} SELECT qid, rank::INTEGER AS rank, id, round(dist, 6) + 0.0 AS distance FROM best WHERE rank <= 5"
    ),
    "search_stats": (
        f"WITH {_PAIRS} SELECT qid, count(*) AS n_results, round(avg(1 - dist), 6) + 0.0 AS mean_score, "
        "round(min(dist), 6) + 0.0 AS best_distance FROM best WHERE rank <= 20 GROUP BY qid"
    ),
    "hybrid_search": (
        f"WITH {DOCV}, top AS (SELECT * FROM docv WHERE length(message) >= 32 ORDER BY dist, id LIMIT 100) "
        f"SELECT {_result} FROM top WHERE {SUSPECT}"
    ),
    "vector_dim_check": (
        f"SELECT coalesce(len(embedding), -1)::INTEGER AS dim, count(*) AS n, coalesce(len(embedding), -1) = {q.DIM} AS ok "
        "FROM embeddings GROUP BY ALL"
    ),
    "vector_from_json": (
        "SELECT vec_id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 5) + 0.0 AS total FROM embeddings"
    ),
    "browse_recent": f"WITH {EV} SELECT {_VIEW} FROM ev ORDER BY ev.ts_ms DESC, ev.id LIMIT 50",
    "browse_filtered": (
        f"WITH {EV} SELECT {_VIEW} FROM ev WHERE ev.log_group LIKE '%err_r v%9%' OR ev.log_stream LIKE '%err_r v%9%' "
        "OR ev.message LIKE '%err_r v%9%' ORDER BY ev.ts_ms DESC, ev.id LIMIT 50"
    ),
    "latest_stream": (
        f"WITH {EV} SELECT log_group, log_stream, ts_ms AS last_ts_ms FROM ev QUALIFY row_number() OVER "
        "(PARTITION BY log_group ORDER BY ts_ms DESC, log_stream DESC) = 1"
    ),
    "latest_events": (
        f"WITH {EV}, newest AS (SELECT log_group, log_stream FROM ev QUALIFY row_number() OVER "
        "(PARTITION BY log_group ORDER BY ts_ms DESC, log_stream DESC) = 1) "
        "SELECT log_group, log_stream, id, ts_ms, message, (row_number() OVER (PARTITION BY log_group "
        "ORDER BY ts_ms DESC, id DESC))::INTEGER AS recency FROM ev JOIN newest USING (log_group, log_stream) "
        f"WHERE ts_ms >= {q.AS_OF - 20 * q.DAY_MS} QUALIFY recency <= 50"
    ),
    "group_catalog": f"WITH {LOGS} {_CATALOG} GROUP BY log_group",
    "group_filter": f"WITH {LOGS} {_CATALOG} WHERE contains(lower(log_group), 'pur') GROUP BY log_group",
    "group_fanout": (
        f"WITH {EV} SELECT id, log_group, ts_ms FROM ev WHERE log_group IN ('/app/error', '/app/click')"
    ),
    "min_len": f"WITH {DOC} SELECT id, length(message) AS n_chars FROM doc WHERE length(message) >= 32",
    "since_filter": (
        f"WITH {DOC} SELECT id, ts_ms FROM doc WHERE length(message) >= 10 "
        f"AND ts_ms >= {q.DOC_AS_OF - 10 * 3_600_000}"
    ),
    "recent_errors": (
        f"WITH {LOGS} SELECT id, ts_ms, message FROM logs WHERE contains(lower(message), 'error') "
        "ORDER BY ts_ms DESC, id LIMIT 5"
    ),
    "parse_header": (
        f"WITH {LINES} SELECT file, chunk, line_no, is_header, ts_ms, log_stream, sha1(part) AS rest_sha1 FROM header"
    ),
    "assemble_events": (
        f"WITH {LINES}, numbered AS (SELECT *, sum(is_header::INT) OVER (PARTITION BY file "
        "ORDER BY chunk, line_no)::BIGINT AS event_no FROM header WHERE line <> '') "
        "SELECT file AS log_group, event_no, max(log_stream) AS log_stream, max(ts_ms) AS ts_ms, "
        f"string_agg(part, {NL} ORDER BY chunk, line_no) AS message FROM numbered WHERE event_no > 0 "
        "GROUP BY file, event_no"
    ),
    "strip_ansi": f"WITH {EV} SELECT id, log_group || ' ' || message AS clean FROM ev",
    "embed_text": (
        f"WITH {DOC} SELECT id, least(length(message), 4000) AS n_chars, sha1(substr(message, 1, 4000)) AS embed_sha1, "
        "sha1(message) AS raw_sha1 FROM doc"
    ),
    "mean_pool": (
        "WITH cells AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, "
        "generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) "
        "SELECT label, count(*) AS n, pos, round(avg(x), 6) + 0.0 AS value FROM cells GROUP BY label, pos"
    ),
    "token_pool": (
        "WITH cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, "
        "generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) "
        f"SELECT vec_id, i % {q.DIM // 4} AS pos, round(avg(x), 6) + 0.0 AS value FROM cells GROUP BY ALL"
    ),
    "first_token_pool": (
        "WITH cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, "
        "generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) "
        f"SELECT vec_id, i AS pos, round(x, 6) + 0.0 AS value FROM cells WHERE i < {q.DIM // 4}"
    ),
    "plugin_embedder": (
        f"WITH {DOC}, whole AS (SELECT id, regexp_replace(message, e'\\x1b\\[[0-9;]*[A-Za-z]', '', 'g') AS t FROM doc) "
        "SELECT id, length(t)::BIGINT AS length, (length(t) - length(replace(t, ' ', '')))::BIGINT AS spaces FROM whole"
    ),
    "since_dialect_b": f"WITH {EV} SELECT id, ts_ms FROM ev WHERE ts_ms >= {q.AS_OF - 36 * 3_600_000}",
    "conv_files": (
        "SELECT conv_id::VARCHAR AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text "
        "FROM conversations"
    ),
    "quality_filter": f"WITH {_LEFT} SELECT id, log_group FROM judged WHERE usable AND filled",
    "reject_counts": (
        f"WITH {_LEFT} SELECT log_group, count(*) AS total, count(*) FILTER (NOT usable) AS failed_embeddings, "
        "count(*) FILTER (NOT filled) AS blank_messages, count(*) FILTER (usable AND filled) AS kept "
        "FROM judged GROUP BY log_group"
    ),
    "stable_id": (
        f"WITH {LOGS} SELECT id, sha256(log_group || chr(1) || log_stream || chr(1) || ts_ms || chr(1) || message "
        "|| chr(1) || id) AS stable_id FROM logs"
    ),
    "message_templates": (
        f"WITH {LOGS}, shaped AS (SELECT *, {_TEMPLATE} AS template FROM logs), "
        "per_group AS (SELECT template, log_group, count(*) AS n, min(ts_ms) AS lo, max(ts_ms) AS hi "
        "FROM shaped GROUP BY ALL) "
        "SELECT template, sum(n)::BIGINT AS n, min(lo) AS first_ts_ms, max(hi) AS last_ts_ms, "
        "count(*) AS n_groups, arg_max(log_group, {'n': n, 'g': log_group}) AS main_group "
        "FROM per_group GROUP BY template"
    ),
    "learned_templates": (
        f"WITH {LOGS}, w AS (SELECT message, log_group, count(*) AS n, min(ts_ms) AS lo, max(ts_ms) AS hi, "
        "regexp_split_to_array(trim(message, e' \\t\\n\\x0b\\f\\r'), '[\\x20\\t-\\r]+') AS w FROM logs "
        "WHERE message IS NOT NULL GROUP BY message, log_group), "
        "s AS (SELECT *, len(w) AS l, row_number() OVER () AS no FROM w), "
        "t1 AS (SELECT l, sum(n) AS total FROM s GROUP BY l), b1 AS (SELECT l, w[1] AS x, sum(n) AS here FROM s GROUP BY ALL), "
        f"s1 AS (SELECT s.*, CASE WHEN {_FIXED} THEN x ELSE '<*>' END AS p1 FROM s JOIN b1 ON s.l = b1.l AND w[1] = x JOIN t1 ON s.l = t1.l), "
        "t2 AS (SELECT l, p1, sum(n) AS total FROM s1 WHERE l > 1 GROUP BY ALL), "
        "b2 AS (SELECT l, p1, w[2] AS x, sum(n) AS here FROM s1 WHERE l > 1 GROUP BY ALL), "
        f"s2 AS (SELECT s1.*, CASE WHEN {_FIXED} THEN x ELSE '<*>' END AS p2 FROM s1 JOIN b2 ON s1.l = b2.l AND s1.p1 = b2.p1 AND w[2] = x "
        "JOIN t2 ON s1.l = t2.l AND s1.p1 = t2.p1 UNION ALL SELECT s1.*, NULL FROM s1 WHERE l = 1), "
        "t3 AS (SELECT l, p1, p2, sum(n) AS total FROM s2 WHERE l > 2 GROUP BY ALL), "
        "word AS (SELECT no, l, p1, p2, n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM s2 WHERE l > 2), "
        "b3 AS (SELECT l, p1, p2, i, x, sum(n) AS here FROM word WHERE i > 2 GROUP BY ALL), "
        f"rest AS (SELECT no, string_agg(CASE WHEN {_FIXED} THEN word.x ELSE '<*>' END, ' ' ORDER BY word.i) AS r, "
        f"count(*) FILTER (NOT ({_FIXED}) OR word.x = '<*>') AS v "
        "FROM word JOIN b3 ON word.l = b3.l AND word.p1 = b3.p1 AND word.p2 = b3.p2 AND word.i = b3.i AND word.x = b3.x "
        "JOIN t3 ON word.l = t3.l AND word.p1 = t3.p1 AND word.p2 = t3.p2 GROUP BY no), "
        "shaped AS (SELECT s2.*, concat_ws(' ', p1, p2, r) AS template, "
        "coalesce(v, 0) + (p1 = '<*>')::INT + coalesce((p2 = '<*>')::INT, 0) AS n_variables FROM s2 LEFT JOIN rest USING (no)), "
        "per_group AS (SELECT template, n_variables, log_group, sum(n) AS n, min(lo) AS lo, max(hi) AS hi FROM shaped GROUP BY ALL) "
        "SELECT template, n_variables::BIGINT AS n_variables, sum(n)::BIGINT AS n, min(lo) AS first_ts_ms, max(hi) AS last_ts_ms, "
        "count(*) AS n_groups, arg_max(log_group, {'n': n, 'g': log_group}) AS main_group FROM per_group GROUP BY template, n_variables"
    ),
    "window_scan": (
        f"WITH {LOGS}, win AS (SELECT * FROM logs WHERE ts_ms > {q.AS_OF - 28 * q.DAY_MS} AND ts_ms <= {q.AS_OF} "
        "AND length(message) >= 10), cut AS (SELECT max(ts_ms) AS t FROM (SELECT ts_ms FROM win ORDER BY ts_ms, id LIMIT 1000)) "
        "SELECT id, log_group, ts_ms FROM win WHERE ts_ms <= (SELECT t FROM cut)"
    ),
    "suspects": f"WITH {LOGS} SELECT id, log_group, ts_ms FROM logs WHERE {SUSPECT}",
    "group_counts": (
        f"WITH {LOGS} SELECT log_group, count(*) AS n, count(*) FILTER ({SUSPECT}) AS n_suspects, "
        "min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms FROM logs GROUP BY log_group"
    ),
    "group_counts_json": (
        f"WITH {LOGS}, top AS (SELECT log_group, count(*) AS n, min(ts_ms) AS lo FROM logs GROUP BY log_group "
        "ORDER BY n DESC, lo, log_group LIMIT 5) SELECT to_json(list({'group': log_group, 'count': n} "
        "ORDER BY n DESC, lo, log_group))::VARCHAR AS aggregates FROM top"
    ),
    "top_groups": f"WITH {COUNTS} SELECT tick_ms, rank::INTEGER AS rank, log_group, n FROM ranked WHERE rank <= 5",
    "samples": f"WITH {TICKED}, {SAMPLES} SELECT tick_ms, sample_no::INTEGER AS sample_no, id FROM sampled",
    "evidence_samples": (
        f"WITH {TICKED} SELECT tick_ms, log_group, (row_number() OVER (PARTITION BY tick_ms, log_group "
        "ORDER BY ts_ms, id))::INTEGER AS sample_no, id FROM ticked WHERE sus QUALIFY sample_no <= 3"
    ),
    "representative_evidence": (
        f"WITH {DOCV}, e AS (SELECT log_group, id, embedding::DOUBLE[] AS v FROM docv), "
        "m AS (SELECT log_group, list(a ORDER BY i) AS mv FROM (SELECT log_group, i, avg(x) AS a FROM "
        "(SELECT log_group, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY ALL) GROUP BY log_group), "
        "pool AS (SELECT e.log_group, id, v, round(list_cosine_distance(v, mv), 9) AS d, "
        "row_number() OVER (PARTITION BY e.log_group ORDER BY round(list_cosine_distance(v, mv), 9), id) AS place "
        "FROM e JOIN m ON e.log_group = m.log_group QUALIFY place <= 20), "
        "p1 AS (SELECT * FROM pool WHERE place = 1), "
        "a1 AS (SELECT pool.*, round(list_cosine_distance(pool.v, p1.v), 9) AS near FROM pool JOIN p1 USING (log_group) WHERE pool.place <> 1), "
        "p2 AS (SELECT * FROM a1 QUALIFY row_number() OVER (PARTITION BY log_group ORDER BY near DESC, place) = 1), "
        "a2 AS (SELECT a1.* REPLACE (least(a1.near, round(list_cosine_distance(a1.v, p2.v), 9)) AS near) FROM a1 JOIN p2 USING (log_group) "
        "WHERE a1.place <> p2.place), "
        "p3 AS (SELECT * FROM a2 QUALIFY row_number() OVER (PARTITION BY log_group ORDER BY near DESC, place) = 1) "
        "SELECT log_group, pick::INTEGER AS pick, id, round(d, 6) + 0.0 AS distance FROM (SELECT log_group, 1 AS pick, id, d FROM p1 "
        "UNION ALL SELECT log_group, 2, id, d FROM p2 UNION ALL SELECT log_group, 3, id, d FROM p3)"
    ),
    "window_panes": _PANES,
    "stream_panes": _PANES,
    "change_points": (
        f"WITH {LOGS}, c AS (SELECT log_group AS g, ts_ms // 3600000 * 3600000 AS b, count(*) AS n FROM logs GROUP BY ALL), "
        "cal AS (SELECT g, unnest(range(lo, hi + 1, 3600000)) AS b FROM (SELECT g, min(b) AS lo, max(b) AS hi FROM c GROUP BY g)), "
        "r AS (SELECT cal.g, cal.b, coalesce(c.n, 0) AS n, (cal.b % 86400000) // 3600000 AS hour FROM cal LEFT JOIN c ON cal.g = c.g AND cal.b = c.b), "
        "m AS (SELECT g, hour, median(n) AS e FROM r GROUP BY ALL), rm AS (SELECT r.*, e FROM r JOIN m USING (g, hour)), "
        "d AS (SELECT g, hour, median(abs(n - e)) AS mad FROM rm GROUP BY ALL), "
        "z AS (SELECT rm.*, (n - e) / greatest(1.4826::DOUBLE * mad, 1.0) AS z FROM rm JOIN d USING (g, hour)), "
        "s AS (SELECT g, b, n, e, 'up' AS direction, z - 0.5::DOUBLE AS step FROM z UNION ALL SELECT g, b, n, e, 'down', -z - 0.5::DOUBLE FROM z), "
        "p AS (SELECT *, round(sum(step) OVER o, 9) AS p FROM s WINDOW o AS (PARTITION BY g, direction ORDER BY b ROWS UNBOUNDED PRECEDING)), "
        "q AS (SELECT *, round(p - least(0.0, min(p) OVER o), 6) AS cusum FROM p "
        "WINDOW o AS (PARTITION BY g, direction ORDER BY b ROWS UNBOUNDED PRECEDING)), "
        "f AS (SELECT *, lag(cusum, 1, 0.0) OVER w AS before, max(CASE WHEN cusum = 0 THEN b END) OVER o AS zero, min(b) OVER o AS first FROM q "
        "WINDOW w AS (PARTITION BY g, direction ORDER BY b), o AS (PARTITION BY g, direction ORDER BY b ROWS UNBOUNDED PRECEDING)) "
        "SELECT g AS log_group, direction, coalesce(zero + 3600000, first) AS onset_ms, b AS bucket_ms, n, e AS expected, round(cusum, 4) + 0.0 AS cusum "
        "FROM f WHERE cusum > 5 AND before <= 5"
    ),
    "sketch_bounds": (
        f"WITH {LOGS} SELECT log_group, count(*) AS n, true AS streams_within, true AS median_within, true AS n_exact "
        "FROM logs WHERE log_group IS NOT NULL GROUP BY log_group"
    ),
    "window_summary": (
        f"WITH {CONTEXT} SELECT tick_ms, first_ts_ms, last_ts_ms, event_count, suspect_count, "
        "to_json(aggregates)::VARCHAR AS aggregates FROM context"
    ),
    "error_rate": (
        f"WITH {EV} SELECT log_group, log_stream, ts_ms // 3600000 * 3600000 AS bucket_ms, count(*) AS total, "
        f"count(*) FILTER ({SUSPECT}) AS n_suspects, "
        f"round(count(*) FILTER ({SUSPECT}) / count(*), 6) + 0.0 AS rate FROM ev GROUP BY ALL"
    ),
    "error_trend": (
        f"WITH {LOGS}, buckets AS (SELECT log_group, ts_ms // 3600000 * 3600000 AS bucket_ms, count(*) AS total, "
        f"count(*) FILTER ({SUSPECT}) AS n_suspects FROM logs GROUP BY ALL), "
        "rates AS (SELECT *, n_suspects / total AS r, lag(n_suspects / total) OVER (PARTITION BY log_group "
        "ORDER BY bucket_ms) AS p FROM buckets) SELECT log_group, bucket_ms, total, n_suspects, "
        "round(r, 6) + 0.0 AS rate, round(p, 6) + 0.0 AS previous_rate, round(r - p, 6) + 0.0 AS change FROM rates"
    ),
    "ingest_rate": (
        f"WITH {EV}, slots AS (SELECT 4 - least(({q.AS_OF} - ts_ms) // 3600000, 4) AS bucket FROM ev "
        f"WHERE ts_ms BETWEEN {q.AS_OF - 5 * 3_600_000} AND {q.AS_OF}) "
        "SELECT b::INTEGER AS bucket, count(slots.bucket) AS n FROM range(5) t(b) "
        "LEFT JOIN slots ON slots.bucket = b GROUP BY b"
    ),
    "score_windows": f"WITH {COUNTS}, {SCORED} SELECT * FROM scored",
    "external_scores": (
        f"WITH {CONTEXT} SELECT tick_ms, len(samples) || ' sample lines' AS title, CASE WHEN len(samples) >= 5 THEN 'high' ELSE 'low' END AS severity, "
        "least(len(samples) / 8, 1.0)::DOUBLE AS confidence FROM context WHERE len(samples) / 8 >= 0.2"
    ),
    "incident_gate": (
        f"WITH {COUNTS}, {SCORED} SELECT tick_ms, title, severity, confidence FROM scored "
        "WHERE severity IN ('high', 'critical') AND confidence >= 0.3"
    ),
    "alert_prompt": (
        f"WITH {CONTEXT} SELECT tick_ms, concat_ws({NL}, {_lit(detection.PROMPT_HEADER)}, "
        f"'Time range: ' || {_iso(f'tick_ms - {q.TICK}')} || ' .. ' || {_iso('tick_ms')}, "
        "'Aggregates: ' || substr(to_json(aggregates)::VARCHAR, 1, 1500), "
        "'Samples (' || len(samples) || '):', "
        f"CASE WHEN len(samples) > 0 THEN array_to_string({_PROMPT_LINES}, {NL}) END, "
        f"{_lit(detection.PROMPT_FOOTER)}) AS prompt FROM context"
    ),
    "normalize_severity": (
        "WITH s AS (SELECT o_orderkey, CASE lower(split_part(o_orderpriority, '-', -1)) WHEN 'high' THEN 'high' "
        "WHEN 'low' THEN 'low' WHEN 'critical' THEN 'critical' WHEN 'info' THEN 'info' ELSE 'medium' END AS severity "
        "FROM orders) SELECT o_orderkey, severity, "
        "(list_position(['info', 'low', 'medium', 'high', 'critical'], severity) - 1)::INTEGER AS severity_rank FROM s"
    ),
    "clamp_confidence": (
        "SELECT c_custkey, round(least(1.0, greatest(0.0, c_acctbal / 5000)), 6) + 0.0 AS from_number, "
        "0.0::DOUBLE AS from_text FROM customer"
    ),
    "parse_incidents": (
        f"WITH {COUNTS}, {SCORED} SELECT tick_ms, 0 AS ord, title, severity, confidence, summary FROM scored"
    ),
    "dedupe_key": f"WITH {BUILT} SELECT now_ms, title, dedupe_key FROM built",
    "incident_build": (
        f"WITH {BUILT} SELECT now_ms, dedupe_key, status, severity, title, summary, affected_group, first_ts_ms, "
        "last_ts_ms, event_count, sample_ids, vector_context FROM built"
    ),
    "incident_merge": f"WITH {MERGED} SELECT * FROM merged",
    "incident_list": f"WITH {MERGED} SELECT id, created_ms, severity, title FROM merged ORDER BY created_ms DESC, id",
    "incident_evidence": (
        f"WITH {BUILT}, wanted AS (SELECT substr(sha256(dedupe_key), 1, 32) AS incident_id, "
        "unnest(samples) AS s, generate_subscripts(samples, 1) - 1 AS pos FROM built) "
        "SELECT incident_id, pos::INTEGER AS pos, s.id AS id, s.log_group AS log_group, s.ts_ms AS ts_ms FROM wanted"
    ),
    "incident_timeline": (
        f"WITH {LOGS} SELECT id, log_group, ts_ms, ts_ms - lag(ts_ms) OVER (PARTITION BY log_group "
        "ORDER BY ts_ms, id) AS gap_ms FROM logs"
    ),
    "incident_sessions": f"WITH {LOGS}, {_sessions('logs')} SELECT * FROM sessions",
    "incident_correlation": (
        f"WITH {LOGS}, {_sessions('logs')}, s AS (SELECT log_group AS k, first_ts_ms AS lo, last_ts_ms AS hi FROM sessions) "
        "SELECT least(a.k, b.k) AS key_a, greatest(a.k, b.k) AS key_b, count(*) AS n, count(*) FILTER (a.k < b.k) AS n_a_first, "
        "min(b.lo) AS first_ms, max(b.lo) AS last_ms, sum(greatest(least(a.hi, b.hi) - b.lo, 0))::BIGINT AS both_ms "
        "FROM s a JOIN s b ON a.k <> b.k AND (a.lo < b.lo OR (a.lo = b.lo AND (a.k < b.k OR (a.k = b.k AND a.hi < b.hi)))) "
        f"AND b.lo <= a.hi + {q.MARGIN_MS} GROUP BY 1, 2"
    ),
    "incident_report": (
        f"WITH {BUILT}, "
        "slots AS (SELECT tick_ms, ts_ms // 3600000 * 3600000 AS slot_ms, count(*) AS n, "
        "count(*) FILTER (sus) AS n_suspects FROM ticked GROUP BY ALL), "
        "timelines AS (SELECT tick_ms, list({'slot_ms': slot_ms, 'n': n, 'n_suspects': n_suspects} "
        "ORDER BY slot_ms) AS timeline FROM slots GROUP BY tick_ms), "
        "busy AS (SELECT tick_ms, log_group, log_stream, count(*) AS n FROM ticked GROUP BY ALL), "
        "busiest AS (SELECT *, row_number() OVER (PARTITION BY tick_ms ORDER BY n DESC, log_group, log_stream) AS rank FROM busy), "
        "streams AS (SELECT tick_ms, list({'rank': rank, 'log_group': log_group, 'log_stream': log_stream, 'n': n} "
        "ORDER BY rank) AS streams FROM busiest GROUP BY tick_ms) "
        "SELECT substr(sha256(dedupe_key), 1, 32) AS incident_id, severity, title, event_count, "
        'to_json(aggregates)::VARCHAR AS "groups", to_json(streams)::VARCHAR AS streams, '
        "to_json(timeline)::VARCHAR AS timeline, sample_ids "
        "FROM built JOIN timelines t ON t.tick_ms = now_ms JOIN streams s ON s.tick_ms = now_ms"
    ),
    "alert_outbox": f"WITH {ALERTS} SELECT * FROM outbox",
    "alert_routing": (
        f"WITH {ALERTS} SELECT incident_id, severity, channel FROM outbox WHERE severity = 'critical' "
        "OR (severity = 'high' AND channel = 'sns') OR (severity IN ('medium', 'low') AND channel = 'slack')"
    ),
    "cursor_upsert": (
        f"WITH {LOGS} SELECT log_group AS pipeline_id, max(ts_ms) AS last_ts_ms, "
        "arg_max(id, {'t': ts_ms, 'i': id}) AS last_id FROM logs GROUP BY log_group"
    ),
    "sql_limited": q.SQL_LIMITED + " LIMIT 1000",
    "sql_envelope": (
        "SELECT to_json(list({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_totalprice': o_totalprice} "
        "ORDER BY o_totalprice DESC, o_orderkey))::VARCHAR AS \"rows\", "
        f'count(*) AS score, 5 AS "limit" FROM ({q.SQL_LIMITED} LIMIT 5)'
    ),
    "sql_join": q.SQL_JOIN,
    "sql_semi_anti": q.SQL_SEMI_ANTI,
    "sql_rollup": q.SQL_ROLLUP,
    "sql_set_ops": q.SQL_SET_OPS.replace("sum(k) AS total", "sum(k)::BIGINT AS total"),
    "sql_vector_search": (
        f"SELECT vec_id, label, round(list_cosine_distance(embedding::DOUBLE[], {QUERY}), 6) AS distance "
        "FROM embeddings ORDER BY distance, vec_id LIMIT 20"
    ),
    "derive_columns": (
        "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, round(value * 2 + 1, 4) AS scaled, "
        "CASE WHEN event_type = 'error' THEN 'bad' ELSE 'good' END AS kind FROM events"
    ),
    "truncate_text": f"WITH {DOC} SELECT id, {_cut(100, 97)} AS short, {_cut(80, 80)} AS preview FROM doc",
    "iso_time": f"WITH {EV} SELECT id, {_iso('ts_ms')} AS iso, substr({_iso('ts_ms')}, 1, 13) AS hour FROM ev",
    "in_timezone": (
        f"WITH {EV} SELECT id, strftime(make_timestamp(ts_ms * 1000) - INTERVAL 5 HOUR, "
        "'%-m/%-d/%Y, %-I:%M:%S %p') AS local_time FROM ev"
    ),
    "failure_class": (
        f"WITH {LOGS} SELECT id, CASE WHEN contains(message, 'Connection refused') THEN 'Service not running' "
        "WHEN contains(message, 'timeout') OR contains(message, 'timed out') THEN 'Request timeout' "
        "WHEN contains(message, '404') THEN 'Endpoint not found' WHEN contains(message, '500') THEN 'Server error' "
        "WHEN contains(message, 'Could not resolve host') THEN 'Host unreachable' ELSE 'Connection failed' END "
        "AS failure_class FROM logs"
    ),
    "rows_as_json": (
        "SELECT to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus, "
        "'priority': nullif(o_orderpriority, '5-LOW')})::VARCHAR AS json FROM orders"
    ),
    "conv_summary": (
        "SELECT conv_id, count(*) - 1 AS message_count, max(turn) AS last_turn, "
        "arg_max(CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END, turn) AS preview "
        "FROM conversations GROUP BY conv_id"
    ),
    "conv_render": (
        f"SELECT conv_id, 0::BIGINT AS part, string_agg({_TAG}, '' ORDER BY turn) || {_ASSISTANT} AS prompt "
        "FROM conversations GROUP BY conv_id"
    ),
    "conv_render_tools": (
        "WITH marked AS (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last_user "
        f"FROM conversations) SELECT conv_id, 0::BIGINT AS part, string_agg(CASE WHEN turn = last_user "
        f"THEN {_lit(convo.tool_text(q.TOOLS))} ELSE '' END || {_TAG}, '' ORDER BY turn) || {_ASSISTANT} AS prompt "
        "FROM marked GROUP BY conv_id"
    ),
    "conv_messages_json": (
        "SELECT conv_id, 0::BIGINT AS part, to_json(list({'role': role, 'content': text} ORDER BY turn))::VARCHAR "
        "AS messages FROM conversations GROUP BY conv_id"
    ),
    "conv_with_system": (
        "SELECT conv_id, turn, role, text FROM conversations UNION ALL "
        f"SELECT conv_id, min(turn) - 1, 'system', {_lit(convo.SYSTEM_TEMPLATE.replace('{{TODAY}}', q.TODAY))} "
        "FROM conversations GROUP BY conv_id HAVING NOT bool_or(role = 'system')"
    ),
    "conv_keep_first": (
        "SELECT conv_id, turn, role, text FROM conversations "
        "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1"
    ),
    "conv_delete": (
        "SELECT conv_id, turn, role, text FROM conversations "
        "WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
    ),
    "fold_token_lines": (
        "SELECT conv_id AS stream_id, 0::BIGINT AS part, "
        f"coalesce(string_agg(CASE WHEN role IN ('user', 'assistant') THEN text ELSE trim(replace(text, {NL}, ' ')) END, '' "
        "ORDER BY turn) FILTER (turn * 2 < 9), '') AS text FROM conversations GROUP BY conv_id"
    ),
    "stream_rate": (
        f"WITH {EV}, buckets AS (SELECT ts_ms // 3600000 * 3600000 AS bucket_ms, count(*) AS n FROM ev GROUP BY ALL) "
        "SELECT * FROM buckets"
    ),
    "stream_audit": (
        f"WITH {LOGS}, j AS (SELECT ts_ms, (ts_ms // 60000) % {q.LANDINGS} AS part, NOT coalesce(regexp_matches(message, '[^{SPACE}]'), false) AS bad FROM logs), "
        "mx AS (SELECT part, max(ts_ms) FILTER (NOT bad) AS m FROM j GROUP BY part), "
        "wm AS (SELECT part, max(m) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) "
        f"- {q.LATENESS_MS} AS w FROM mx) "
        "SELECT part::INTEGER AS batch, count(*) AS n_input, count(*) FILTER (NOT bad AND NOT coalesce(ts_ms < w, false)) AS n_stored, "
        "count(*) FILTER (NOT bad AND coalesce(ts_ms < w, false)) AS n_late, count(*) FILTER (bad) AS n_rejected FROM j JOIN wm USING (part) GROUP BY part"
    ),
    "stream_session_incidents": (
        f"WITH {EV}, {_sessions('ev')} SELECT * FROM sessions "
        f"WHERE last_ts_ms + {_GAP} <= (SELECT max(ts_ms) FROM hits) - 600000"
    ),
    "stream_dedupe": f"WITH {EV} SELECT id, ts_ms FROM ev",
    "stream_ingest": _EVENTS,
    "stream_assembly": _EVENTS,
    "stream_detect": (
        f"WITH {BUILT}, closed AS (SELECT * FROM built WHERE now_ms <= (SELECT max(ts_ms) - 1 FROM ticked) - {q.DETECT_DELAY_MS}), "
        f"merged AS ({_fold('closed')}) SELECT id, created_ms, updated_ms, severity, title, first_ts_ms, last_ts_ms, "
        "event_count, sample_ids, dedupe_key FROM merged"
    ),
}
