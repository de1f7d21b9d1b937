"""Training turns from messages: reasoning, tool calls and grouped tool results in one markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What a role is called in a training turn.
TURN_ROLES = {"system": "system", "user": "human", "assistant": "gpt", "tool": "tool"}


def quoted(value: Column) -> Column:
    """A string as JSON; null is the empty string."""
    listed = F.to_json(F.array(F.coalesce(value, F.lit(""))))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def parsed(value: Column, starts: str) -> Column:
    """The text of a JSON value that begins with one of ``starts`` and is whole, else null."""
    trimmed = F.trim(value)
    return F.when(F.substring(trimmed, 1, 1).isin(*starts) & F.try_parse_json(trimmed).isNotNull(), trimmed)


def call_markup(calls: Column) -> Column:
    """A block for each call, on lines of its own; arguments that aren't an object become {}."""
    block = lambda c: F.concat(F.lit('<tool_call>\n{"name": '), quoted(c["name"]), F.lit(', "arguments": '), F.coalesce(parsed(c["arguments"], "{"), F.lit("{}")), F.lit("}\n</tool_call>"))
    return F.array_join(F.transform(calls, block), "\n")


def assistant_value(content: Column, reasoning: Column, calls: Column) -> Column:
    """Always with a block of thought: the reasoning, else what the content marks as thought, else an empty one."""
    said = T.scratchpad_to_think(F.coalesce(content, F.lit("")))
    own = F.when(F.trim(reasoning) != "", F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>\n"), said)).otherwise(said)
    thought = F.when(own.contains("<think>"), own).otherwise(F.concat(F.lit("<think>\n</think>\n"), own))
    marked = call_markup(calls)
    return F.when(F.coalesce(marked, F.lit("")) == "", thought).otherwise(F.concat(F.rtrim(thought, F.lit(" \t\r\n")), F.lit("\n"), marked))


def training_turns(messages: DataFrame) -> DataFrame:
    """(session_id, place, from, value) of messages (session_id, turn, role, content, reasoning, tool_calls, tool_call_id).

    Results that follow a message are one turn, a block each; a result is named by its place among the calls of that
    message, ``unknown`` beyond them or before any message. Content that is a JSON object or array stays one. Null
    content is empty, null roles are a user's, other roles keep their name. Turns of one number are ordered by content.
    """
    role = F.coalesce("role", F.lit("user"))
    order = Window.partitionBy("session_id").orderBy("turn", "content")
    group = F.sum((role != "tool").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = messages.select("session_id", "turn", "content", "reasoning", "tool_calls", "tool_call_id", role.alias("role"), group.alias("_group"))
    is_tool = F.col("role") == "tool"
    within = Window.partitionBy("session_id", "_group").orderBy("turn", "content")
    heads = F.first(F.when(~is_tool, F.transform("tool_calls", lambda c: c["name"])), ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    nth = F.sum(is_tool.cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    named = placed.withColumn("_name", F.when(is_tool, F.coalesce(F.try_element_at(heads, F.greatest(nth, F.lit(1))), F.lit("unknown"))))
    block = F.concat(F.lit('<tool_response>\n{"tool_call_id": '), quoted(F.col("tool_call_id")), F.lit(', "name": '), quoted(F.col("_name")), F.lit(', "content": '), F.coalesce(parsed(F.col("content"), "{["), quoted(F.col("content"))), F.lit("}\n</tool_response>"))
    value = F.when(is_tool, block).when(F.col("role") == "assistant", assistant_value(F.col("content"), F.col("reasoning"), F.col("tool_calls"))).otherwise(F.coalesce("content", F.lit("")))
    called = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TURN_ROLES.items() for x in pair]), F.col("role")), F.col("role"))
    rows = named.select("session_id", F.col("_group"), is_tool.alias("_tool"), called.alias("from"), "turn", value.alias("value"))
    turns = rows.groupBy("session_id", "_group", "_tool", "from").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return turns.select("session_id", (F.col("_group") * 2 + F.col("_tool").cast("long")).alias("place"), "from", "value")


def anchored_roles(window: DataFrame, anchor: int, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """Messages of the given roles, and the anchor whatever its role."""
    return window.where(F.col("role").isin(*roles) | (F.col("id") == anchor))
