import json

import pytest
from pyspark.sql import functions as F

from vigil.operators import adhoc, convo
from vigil.sources import conversations, tables


def test_guard():
    assert adhoc.check_select("SELECT 1;") == "SELECT 1"
    assert adhoc.check_select("  select * from t ; ") == "select * from t"
    for bad in ("WITH x AS (SELECT 1) SELECT * FROM x", "DELETE FROM t", "(SELECT 1)", "selects"):
        with pytest.raises(ValueError):
            adhoc.check_select(bad)
    assert adhoc.check_select("WITH x AS (SELECT 1) SELECT * FROM x", allow_with=True)


def test_limits(spark):
    spark.range(3000).createOrReplaceTempView("t")
    count = lambda sql, **kw: adhoc.run_select(spark, sql, **kw).count()
    assert count("SELECT * FROM t") == 100
    assert count("SELECT * FROM t", limit=5) == 5
    assert count("SELECT * FROM t", limit=5000) == 1000
    assert count("SELECT * FROM t", limit=5000, max_limit=None) == 3000
    assert count("SELECT * FROM t WHERE id IN (SELECT id FROM t LIMIT 2000)") == 100
    with pytest.raises(Exception):
        adhoc.run_select(spark, "SELECT 1; SELECT 2")
    row = adhoc.envelope(spark, "SELECT id FROM t ORDER BY id", limit=3).first()
    assert (json.loads(row.rows), row.score, row["limit"]) == ([{"id": 0}, {"id": 1}, {"id": 2}], 3, 3)


def test_rows_as_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert tables.rows_as_json(df).first()[0] == '{"a":1,"b":null}'


TURNS = [
    (1, 0, "system", "sys"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"),
    (1, 4, "tool", "r"), (1, 5, "other", "x"), (2, 0, "user", "hello" * 20),
]


@pytest.fixture
def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")


def prompt_of(rows, tools=None):
    last = max((t for t, r, _ in rows if r == "user"), default=None)
    out = ""
    for t, role, text in rows:
        if role not in convo.ROLES:
            continue
        if tools and t == last:
            out += convo.tool_text(tools)
        out += f"<|im_{role}|>{role}<|im_middle|>{text}<|im_end|>"
    return out + "<|im_assistant|>assistant<|im_middle|>"


@pytest.mark.parametrize("span", [10_000, 2, 1])
@pytest.mark.parametrize("tools", [None, {"sql": "runs sql", "time": "tells time"}])
def test_render_in_any_number_of_parts(turns, span, tools):
    got = convo.render(turns, tools, span).orderBy("conv_id", "part").collect()
    for conv in (1, 2):
        whole = "".join(r.prompt for r in got if r.conv_id == conv)
        assert whole == prompt_of([t[1:] for t in TURNS if t[0] == conv], tools)
    assert tools is None or "Available tools:\nsql: runs sql\ntime: tells time\n\n" in got[-1].prompt or span < 3


def test_messages_json(spark, turns):
    got = json.loads(convo.messages_json(turns).where("conv_id = 1").first().messages)
    assert got[0] == {"role": "system", "content": "sys"} and len(got) == 6
    called = turns.withColumn("call_id", F.lit("c1"))
    got = json.loads(convo.messages_json(called).where("conv_id = 1").first().messages)
    assert got[4] == {"role": "tool", "tool_call_id": "c1", "content": "r"} and "tool_call_id" not in got[0]


def test_summary_system_clear_delete(spark, turns):
    got = {r.conv_id: r for r in convo.summary(turns).collect()}
    assert (got[1].message_count, got[1].preview) == (5, "x")
    assert got[2].preview == ("hello" * 20)[:50] + "..."
    with_sys = convo.with_system(turns, "2025-01-01").where("role = 'system'").orderBy("conv_id").collect()
    assert [r.turn for r in with_sys] == [0, -1] and "Date: 2025-01-01" in with_sys[1].text
    assert sorted(map(tuple, convo.keep_first(turns).collect())) == [TURNS[0], TURNS[6]]
    ids = spark.createDataFrame([(1,)], "conv_id long")
    assert [r.conv_id for r in convo.delete(turns, ids).collect()] == [2]
    assert convo.delete(turns).count() == 0


LINES = [
    'data: {"content":"Hel"}', '{"delta":"lo"}', " ", "plain text", "5", '{"content":5}', '{"content":5,"delta":"!"}',
    "data:", "data: [DONE]", '{"content":"ignored after done"}', "[DONE]",
]


@pytest.mark.parametrize("span", [10_000, 2])
def test_fold_token_lines(spark, span):
    rows = [("a", i, line) for i, line in enumerate(LINES)] + [("b", 0, '{"content":"x"}'), ("b", 9, "y")]
    df = spark.createDataFrame(rows, "stream_id string, line_no long, line string")
    got = convo.fold_token_lines(df, span).orderBy("stream_id", "part").collect()
    text = lambda s: "".join(r.text for r in got if r.stream_id == s)
    assert text("a") == "Helloplain text!" and text("b") == "xy"


def test_conversation_files(spark, tmp_path):
    doc = {
        "id": "c1", "name": "c1", "endpoint": "e", "createdAt": "2025", "updatedAt": "2026",
        "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "hi"}],
    }
    (tmp_path / "c1.json").write_text(json.dumps(doc, indent=2))
    turns = conversations.to_turns(conversations.read_files(spark, str(tmp_path)))
    row = convo.summary(turns).first()
    assert (row.conv_id, row.message_count, row.preview, row.updated_at) == ("c1", 1, "hi", "2026")
    conversations.write_turns(turns, str(tmp_path / "out"))
    back = conversations.read_turns(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, turns.collect()))
