"""Fuzzy subsequence ranking as a fold over the characters of a query, within the row and without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points of a match, of one next to the last, of one at a word's start, of the first character, of a prefix
# and of the whole; what a skipped character costs, up to so many; and what each character of the target costs.
MATCH, NEXT, BOUNDARY, FIRST, PREFIX, WHOLE, GAPS, LENGTH = 1.0, 5.0, 3.0, 5.0, 8.0, 20.0, 3, 0.01
# What ends a word.
SEPARATORS = r"[-_/.\s]"


def score(target: Column, token: str) -> Column:
    """Points of a token whose characters stand in the target in order, each as early as can be; null if they don't."""
    token = token.lower()
    low = F.lower(target)

    def step(s: Column, ch: Column) -> Column:
        at = F.call_function("locate", ch, low, s["at"] + 1).cast("int")
        before, here = F.substr(target, at - 1, F.lit(1)), F.substr(target, at, F.lit(1))
        camel = (before == F.lower(before)) & (here != F.lower(here)) & (here == F.upper(here))
        begins = (at == 1) | before.rlike(SEPARATORS) | camel
        gap = F.least(at - s["at"] - 1, F.lit(GAPS)).cast("double")
        close = F.when(s["at"] == 0, 0.0).when(at == s["at"] + 1, NEXT).otherwise(-gap)
        points = s["score"] + MATCH + close + F.when(begins, BOUNDARY).otherwise(0.0) + F.when(at == 1, FIRST).otherwise(0.0)
        return F.when(s["ok"] & (at > 0), F.struct(points.alias("score"), at.alias("at"), F.lit(True).alias("ok"))).otherwise(F.struct(s["score"].alias("score"), s["at"].alias("at"), F.lit(False).alias("ok")))

    start = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("at"), F.lit(True).alias("ok"))
    found = F.aggregate(F.array(*[F.lit(c) for c in token]), start, step)
    prefix = F.when(found["at"] == len(token), PREFIX).otherwise(0.0)  # as many characters as places: none is skipped
    whole = F.when(low == token, WHOLE).otherwise(0.0)
    return F.when(found["ok"], found["score"] + prefix + whole - F.length(low) * LENGTH)


def score_all(target: Column, query: str) -> Column:
    """The sum of the points of a query's tokens, all of which must match; an empty query has none to give."""
    total = F.lit(0.0)
    for token in query.split():
        total = total + score(target, token)
    return total


def ranked(rows: DataFrame, target: str, query: str, order: list[str], k: int | None = None) -> DataFrame:
    """Rows that match with their score, best first and ties in their ``order``; the first ``k`` are kept by each task."""
    found = rows.withColumn("score", score_all(F.col(target), query)).where("score is not null").orderBy(F.desc("score"), *order)
    return found.limit(k) if k is not None else found
