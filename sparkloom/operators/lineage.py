"""Chains of parents for all rows at once, by pointer doubling: a round halves what is left of each chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import removed, written


def ends(links: DataFrame) -> DataFrame:
    """id, end, hops and circular of every row of links (id, next): where following ``next`` leads.

    A chain ends at a row without ``next`` or whose ``next`` isn't a row. Rows on a circle, or on a way into one, have
    no end: they are circular. Null ids are left out; of repeated ids the least ``next`` counts. Each round joins the
    rows that haven't arrived with the rows their pointers are at, so a chain of n takes about log2(n) rounds, and
    whatever has made more than 2^rounds hops without arriving is on its way round a circle.
    """
    kind = links.schema["id"].dataType
    rows = links.where("id is not null").groupBy("id").agg(F.min("next").alias("next"))
    rows = written(rows, "chain-rows")
    known = rows.select(F.col("id").alias("next"), F.lit(True).alias("_known"))
    steps = rows.join(known, "next", "left").select("id", F.when(F.col("_known"), F.col("next")).alias("at"))
    steps = written(steps, "chain-steps")
    done = [steps.where("at is null").select("id", F.col("id").alias("end"), F.lit(0).cast("long").alias("hops"))]
    gone, ways, n = [rows], steps.where("at is not null").withColumn("hops", F.lit(1).cast("long")), steps.count()
    most, last = 1, written(ways, "chain-ways")
    gone.append(last)
    while most <= 2 * n:
        # Where a pointer's row has arrived, its end is this row's end; else the pointer goes on to where that one is.
        there = last.select("id", F.col("at").alias("beyond"), F.lit(None).cast(kind).alias("end"), F.col("hops").alias("more"))
        for part in done:
            there = there.unionByName(part.select("id", F.lit(None).cast(kind).alias("beyond"), "end", F.col("hops").alias("more")))
        moved = last.join(there.withColumnRenamed("id", "at"), "at").select("id", F.coalesce("beyond", "end").alias("at"), "end", (F.col("hops") + F.col("more")).alias("hops"))
        moved = written(moved, "chain-moved")
        gone.append(moved)
        done.append(moved.where("end is not null").select("id", "end", "hops"))
        last = moved.where("end is null").select("id", "at", "hops")
        most *= 2
        if last.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = out.withColumn("circular", F.lit(False)).unionByName(last.select("id", F.lit(None).cast(kind).alias("end"), F.lit(None).cast("long").alias("hops"), F.lit(True).alias("circular")))
    out = written(out, "chain-ends")
    removed(*gone, steps)
    return out


def roots(sessions: DataFrame) -> DataFrame:
    """id, root and depth of every session; a session in a circle of parents is its own root, at no depth."""
    found = ends(sessions.select("id", F.col("parent_session_id").alias("next")))
    return found.select("id", F.coalesce("end", "id").alias("root"), F.col("hops").alias("depth"))


def resume_targets(sessions: DataFrame, spoken: DataFrame) -> DataFrame:
    """id and target of every session: the first one with messages on the way from it by newest children, else itself.

    Of children that started at once the greatest id is the newest. ``spoken`` holds the ids of sessions with messages.
    """
    said = spoken.select("id").distinct().withColumn("said", F.lit(True))
    children = sessions.where("parent_session_id is not null").groupBy(F.col("parent_session_id").alias("id")).agg(F.max_by(F.col("id"), F.struct("started_at", "id")).alias("child"))
    rows = sessions.select("id").join(said, "id", "left").join(children, "id", "left")
    found = ends(rows.select("id", F.when(F.col("said").isNull(), F.col("child")).alias("next")))
    return found.join(said.select(F.col("id").alias("end"), "said"), "end", "left").select("id", F.when(F.col("said"), F.col("end")).otherwise(F.col("id")).alias("target"))
