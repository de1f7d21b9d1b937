"""Checks of files and of writes to them: rules with a scope of paths, and writes that overtake what others wrote."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A stated rule. ``only_path`` fires on the path alone; else ``scope`` and ``beyond`` say for which paths
    substrings, and then a regular expression, are looked for in the content."""

    name: str
    only_path: str | None = None
    scope: str | None = None
    beyond: str | None = None
    substrings: tuple[str, ...] = ()
    regex: str | None = None

    def fires(self, path: Column, content: Column) -> Column:
        path = F.coalesce(path, F.lit(""))
        if self.only_path:
            return path.rlike(self.only_path)
        looked = F.lit(False)
        for part in self.substrings:
            looked = looked | content.contains(part)
        if self.regex:
            looked = looked | content.rlike(self.regex)
        for pattern, wanted in ((self.scope, True), (self.beyond, False)):
            if pattern:
                looked = (path.rlike(pattern) if wanted else ~path.rlike(pattern)) & looked
        return looked


def scanned(files: DataFrame, rules: list[Rule], key: str = "id", most_bytes: int = 262_144) -> DataFrame:
    """(key, rule): each rule that fires on a file, once. Files without content, or with more than ``most_bytes``
    of it, are left alone: that bound is the feature. Rules are stated by the caller, so they go to the rows."""
    content = F.col("content")
    fired = F.array_compact(F.array(*[F.when(r.fires(F.col("path"), content), F.lit(r.name)) for r in rules]))
    within = files.where((content != "") & (F.octet_length(content) <= most_bytes))
    return within.select(key, F.explode(fired).alias("rule"))


def stale_writes(log: DataFrame, key: str = "id") -> DataFrame:
    """(key, task, path, stale) of the writes in a log (key, at, task, path, kind, modified, partial); null is a safe one.

    ``kind`` is read or write; ``modified`` is the file's time of change as seen then, null where there is no file. A
    write counts as its task's reading of the whole. In order of weight: ``sibling_unread`` (another task wrote last,
    this one never read), ``sibling`` (it wrote after this one read), ``drifted`` (changed on disk since), ``partial``
    (only a part was read), ``unread``. A first touch of a path that nobody wrote is safe. Frames run, so a path's rows
    are sorted and passed once; rows of one time are ordered by key.
    """
    by_path = Window.partitionBy("path").orderBy("at", key).rowsBetween(Window.unboundedPreceding, -1)
    by_task = Window.partitionBy("path", "task").orderBy("at", key).rowsBetween(Window.unboundedPreceding, -1)
    is_write = F.col("kind") == "write"
    writer = F.last(F.when(is_write, F.struct("task", "at", F.col(key).alias("k"))), ignorenulls=True).over(by_path)
    partial = ~is_write & F.coalesce("partial", F.lit(False))
    stamp = F.last(F.struct("modified", "at", F.col(key).alias("k"), partial.alias("partial")), ignorenulls=True).over(by_task)
    seen = log.select(key, "task", "path", "kind", "modified", writer.alias("w"), stamp.alias("s")).where("kind = 'write'")
    sibling = F.col("w").isNotNull() & ~F.col("w.task").eqNullSafe(F.col("task"))
    later = F.struct("w.at", "w.k") > F.struct("s.at", "s.k")
    stale = (
        F.when((F.col("s").isNull() & F.col("w").isNull()) | F.col("modified").isNull(), F.lit(None).cast("string"))
        .when(sibling & F.col("s").isNull(), "sibling_unread")
        .when(sibling & later, "sibling")
        .when(F.col("s").isNotNull() & ~F.col("s.modified").eqNullSafe(F.col("modified")), "drifted")
        .when(F.col("s.partial"), "partial")
        .when(F.col("s").isNull(), "unread")
    )
    return seen.select(key, "task", "path", stale.alias("stale"))
