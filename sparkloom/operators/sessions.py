"""Operators on sessions and messages: frames, lineage, seams, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def around(messages: DataFrame, anchor: int, k: int) -> DataFrame:
    """The messages up to k places before and after the anchor in its session; none if it is missing."""
    k = max(0, k)
    w = Window.partitionBy("session_id").orderBy("turn")
    own = messages.where(F.col("id") == anchor).select("session_id")
    placed = messages.join(F.broadcast(own), "session_id", "left_semi").withColumn("rn", F.row_number().over(w))
    at = placed.where(F.col("id") == anchor).select("session_id", F.col("rn").alias("at"))
    return placed.join(F.broadcast(at), "session_id").where(F.abs(F.col("rn") - F.col("at")) <= k).withColumn("offset", F.col("rn") - F.col("at"))


def lineage(sessions: DataFrame, start: int, up: bool = True) -> DataFrame:
    """id and depth of the ancestors (or descendants) of a session, itself first.

    A lineage has no more levels than there are sessions; a circle, which has, is an error.
    """
    step = "s.id = t.parent_session_id" if up else "s.parent_session_id = t.id"
    sql = f"""WITH RECURSIVE t(id, parent_session_id, depth) MAX RECURSION LEVEL {sessions.count() + 2} AS (
        SELECT id, parent_session_id, 0 FROM {{s0}} WHERE id = {int(start)}
        UNION ALL SELECT s.id, s.parent_session_id, t.depth + 1 FROM {{s1}} s JOIN t ON {step})
        SELECT id, depth FROM t"""
    return sessions.sparkSession.sql(sql, s0=sessions, s1=sessions)


def first_of_role(messages: DataFrame, tail: int) -> DataFrame:
    """Protected messages: the first of each role and the last ``tail`` of each session."""
    by_role = Window.partitionBy("session_id", "role").orderBy("turn")
    back = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return messages.select("*", F.row_number().over(by_role).alias("_r"), F.row_number().over(back).alias("_b")).where((F.col("_r") == 1) | (F.col("_b") <= tail)).drop("_r", "_b")


def spill(results: DataFrame, group: str, key: str, size: str, budget: int, saving: Column) -> DataFrame:
    """Largest first, what must be spilled until each group's total is within its budget."""
    w = Window.partitionBy(group).orderBy(F.desc(size), key).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(size).over(Window.partitionBy(group))
    return results.withColumn("_over", total - F.coalesce(F.sum(saving).over(w), F.lit(0))).where(F.col("_over") > budget).drop("_over")


def tail_within(messages: DataFrame, budget: int, tokens: Column) -> DataFrame:
    """The longest tail of each session whose tokens stay within the budget; the last message always."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return messages.select("*", F.sum(tokens).over(w).alias("_sum"), F.row_number().over(w).alias("_rn")).where((F.col("_sum") <= budget) | (F.col("_rn") == 1)).drop("_sum", "_rn")


def tail_groups_within(messages: DataFrame, budget: int, tokens: Column) -> DataFrame:
    """As ``tail_within``, by whole groups: a message and the tool results that follow it stay together or go together."""
    order = Window.partitionBy("session_id").orderBy("turn")
    grouped = messages.withColumn("_group", F.sum((F.col("role") != "tool").cast("int")).over(order))
    sized = grouped.withColumn("_size", F.sum(tokens).over(Window.partitionBy("session_id", "_group")))
    back = Window.partitionBy("session_id").orderBy(F.desc("_group"), F.desc("turn"))
    # Summed once a group, at its last message.
    ends = F.row_number().over(Window.partitionBy("session_id", "_group").orderBy(F.desc("turn"))) == 1
    summed = sized.withColumn("_end", ends).withColumn("_sum", F.sum(F.when(F.col("_end"), F.col("_size")).otherwise(0)).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    summed = summed.withColumn("_last", F.max("_group").over(Window.partitionBy("session_id")))
    # A group's sum stands at its last message and, from there on back, at all others of it.
    return summed.where((F.col("_sum") <= budget) | (F.col("_group") == F.col("_last"))).drop("_group", "_size", "_end", "_sum", "_last")


def merge_runs(messages: DataFrame) -> DataFrame:
    """Neighbouring messages of one role, but tools, as one message."""
    w = Window.partitionBy("session_id").orderBy("turn")
    new = (F.lag("role").over(w).isNull()) | (F.lag("role").over(w) != F.col("role")) | (F.col("role") == "tool")
    runs = messages.withColumn("run", F.sum(new.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("turn", "content")))
    return runs.groupBy("session_id", "run").agg(F.first("role").alias("role"), F.array_join(F.transform(parts, lambda x: x["content"]), "\n").alias("content"))
