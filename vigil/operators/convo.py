"""Conversation histories as prompts, message lists and summaries.

Turns come as rows (conv_id, turn, role, text). Operators that write one text per
conversation give one row (part 0) each, whatever the turn numbers. With `span` a
conversation is written as parts of so many turns in order, for conversations too long
for one value; the parts in order are the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import text as tx

# Role tags of the prompt format and the text around a tool list.
ROLES = ("system", "user", "assistant", "tool")
TAG_OPEN = "<|im_{role}|>{role}<|im_middle|>"
TAG_CLOSE = "<|im_end|>"
TOOLS_BEFORE = "\n\nAvailable tools:\n"
TOOLS_AFTER = "\n\nCall a tool by its name, with its arguments."

SYSTEM_TEMPLATE = (
    "You investigate incidents in log data.\n"
    "Date: {{TODAY}}\n"
    "Back every finding with rows, state how sure you are, and name a remedy with its risk."
)
DONE = "[DONE]"


def part_of(key: str, position: str, span: int | None = None) -> Column:
    """0, or with `span` the number of the part by rank of the position."""
    if span is None:
        return F.lit(0).cast("long")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(position)) - 1
    return F.call_function("div", rank.cast("long"), F.lit(span))


def _segment(role: Column, text: Column) -> Column:
    out = None
    for name in ROLES:
        tagged = F.concat(F.lit(TAG_OPEN.format(role=name)), text, F.lit(TAG_CLOSE))
        out = F.when(role == name, tagged) if out is None else out.when(role == name, tagged)
    return out


def tool_text(tools: dict[str, str]) -> str:
    listed = "\n".join(f"{name}: {about}" for name, about in tools.items())
    return TOOLS_BEFORE + listed + TOOLS_AFTER


def render(turns: DataFrame, tools: dict[str, str] | None = None, span: int | None = None) -> DataFrame:
    """(conv_id, part, prompt): tagged turns, then an open assistant tag.

    The tool list goes before the last user turn. Roles without a tag are left out.
    """
    segment = F.struct("turn", _segment(F.col("role"), F.coalesce("text", F.lit(""))).alias("s"))
    placed = turns.withColumn("part", part_of("conv_id", "turn", span))
    texts = placed.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(segment)).alias("segments")
    )
    # The window sees one slim row per part; the texts stay where (conv_id, part) puts them.
    whole = Window.partitionBy("conv_id")
    marks = (
        placed.groupBy("conv_id", "part")
        .agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("own_user"))
        .select(
            "conv_id",
            "part",
            F.max("own_user").over(whole).alias("last_user"),
            (F.col("part") == F.max("part").over(whole)).alias("is_last"),
        )
    )
    parts = texts.join(marks, ["conv_id", "part"])
    if tools:
        text = lambda p: F.when(
            p["turn"] == F.col("last_user"), F.concat(F.lit(tool_text(tools)), p["s"])
        ).otherwise(p["s"])
    else:
        text = lambda p: p["s"]
    tail = F.when(F.col("is_last"), F.lit(TAG_OPEN.format(role="assistant"))).otherwise("")
    return parts.select(
        "conv_id",
        "part",
        F.concat(F.array_join(F.transform("segments", text), ""), tail).alias("prompt"),
    )


def messages_json(turns: DataFrame, span: int | None = None) -> DataFrame:
    """(conv_id, part, messages): JSON arrays of {role, content}; tool turns carry their call id."""
    fields = [F.col("role"), F.coalesce("text", F.lit("")).alias("content")]
    if "call_id" in turns.columns:
        fields.insert(1, F.when(F.col("role") == "tool", F.col("call_id")).alias("tool_call_id"))
    listed = F.array_sort(F.collect_list(F.struct("turn", F.struct(*fields).alias("m"))))
    return turns.withColumn("part", part_of("conv_id", "turn", span)).groupBy("conv_id", "part").agg(
        F.to_json(F.transform(listed, lambda e: e["m"])).alias("messages")
    )


def with_system(turns: DataFrame, today: str, template: str = SYSTEM_TEMPLATE) -> DataFrame:
    """Give conversations without a system turn one, placed before their first turn."""
    prompt = template.replace("{{TODAY}}", today)
    lacking = (
        turns.groupBy("conv_id")
        .agg(F.max(F.col("role") == "system").alias("has"), (F.min("turn") - 1).alias("turn"))
        .where(~F.col("has"))
        .select("conv_id", "turn", F.lit("system").alias("role"), F.lit(prompt).alias("text"))
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(lacking)


def summary(turns: DataFrame, n: int = 50) -> DataFrame:
    """Messages after the first one, a preview of the last message, its turn."""
    last = F.max_by(F.struct("turn", tx.preview("text", n).alias("preview")), "turn").alias("last")
    extra = [F.max("updated_at").alias("updated_at")] if "updated_at" in turns.columns else []
    return turns.groupBy("conv_id").agg(
        (F.count(F.lit(1)) - 1).alias("message_count"), last, *extra
    ).select(
        "conv_id",
        "message_count",
        F.col("last.turn").alias("last_turn"),
        F.col("last.preview").alias("preview"),
        *(["updated_at"] if extra else []),
    )


def keep_first(turns: DataFrame) -> DataFrame:
    """Clear conversations down to their first message."""
    first = F.min_by(F.struct("turn", "role", "text"), "turn").alias("m")
    return turns.groupBy("conv_id").agg(first).select("conv_id", "m.*")


def delete(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Turns that remain after deleting the conversations in `ids`, or all of them."""
    if ids is None:
        return turns.limit(0)
    return turns.join(ids.select("conv_id"), "conv_id", "left_anti")


def fold_token_lines(lines: DataFrame, span: int | None = None) -> DataFrame:
    """Captured answer lines (stream_id, line_no, line) to (stream_id, part, text).

    `data:` is optional, nothing after the end mark counts, JSON objects give their
    `content` or `delta` text, any other line is taken as it is.
    """
    trimmed = tx.trim_space("line")
    payload = F.when(
        trimmed.startswith("data:"), tx.trim_space(F.substring(trimmed, 6, 2_147_483_647))
    ).otherwise(trimmed)
    parsed = F.try_parse_json("payload")

    def string_at(path: str) -> Column:
        value = F.try_variant_get("json", path, "variant")
        is_text = F.schema_of_variant(value) == "STRING"
        return F.when(is_text, F.try_variant_get("json", path, "string"))

    token = F.when(F.col("json").isNull(), F.col("payload")).otherwise(
        F.coalesce(string_at("$.content"), string_at("$.delta"), F.lit(""))
    )
    tokens = (
        lines.withColumn("payload", payload)
        .where(F.col("payload") != "")
        .withColumn("json", parsed)
        .select(
            "stream_id",
            "line_no",
            (F.col("payload") == DONE).alias("is_done"),
            token.alias("token"),
        )
    )
    placed = tokens.withColumn("part", part_of("stream_id", "line_no", span))
    texts = placed.groupBy("stream_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "token"))).alias("tokens")
    )
    whole = Window.partitionBy("stream_id")
    ends = (
        placed.groupBy("stream_id", "part")
        .agg(F.min(F.when(F.col("is_done"), F.col("line_no"))).alias("own_done"))
        .select(
            "stream_id", "part", F.min("own_done").over(whole).alias("done"),
            F.min(F.when(F.col("own_done").isNotNull(), F.col("part"))).over(whole).alias("done_part"),
        )
        .where(F.col("done").isNull() | (F.col("part") <= F.col("done_part")))
    )
    before_end = lambda t: F.col("done").isNull() | (t["line_no"] < F.col("done"))
    return texts.join(ends, ["stream_id", "part"]).select(
        "stream_id",
        "part",
        F.array_join(
            F.transform(F.filter("tokens", before_end), lambda t: t["token"]), ""
        ).alias("text"),
    )
