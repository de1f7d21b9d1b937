"""Path prefixes by equality: a path meets its ancestors, and paths of a batch meet their neighbours in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain(path: Column) -> Column:
    """A path with single slashes, without ``.``, ``..`` where something stands before it, and a slash at its end."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p != "..", F.array_append(done, p)).when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(up, "/"))


def ancestors(path: Column) -> Column:
    """A plain path and all folders above it, the nearest last; the root's own is a slash."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.when((n == 1) & path.startswith("/"), "/").otherwise(F.array_join(F.slice(steps, F.lit(1), n), "/")))


def longest_prefix(files: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """``files`` with the root (of the column ``root``) that is their nearest ancestor or themselves; null where none is.

    Files are joined by their folders, so no pair is tried in vain: distinct folders are matched once each, and a file
    needs only its folder's root unless it is one itself.
    """
    known = roots.select(plain(F.col("root")).alias("_root"), F.col("root")).dropDuplicates(["_root"])
    rows = files.withColumn("_path", plain(F.col(path)))
    folders = rows.select("_path").distinct()
    met = folders.select("_path", F.posexplode(ancestors(F.col("_path"))).alias("_depth", "_root")).join(known, "_root")
    nearest = met.groupBy("_path").agg(F.max_by("root", "_depth").alias("root"))
    return rows.join(nearest, "_path", "left").drop("_path")


def overlapping(calls: DataFrame, batch: str, path: str) -> DataFrame:
    """batch and whether two of its paths are the same or one holds the other: neighbours in order tell."""
    own = F.concat(plain(F.col(path)), F.lit("/"))
    rows = calls.where(F.col(path).isNotNull()).select(batch, own.alias("_path"))
    before = F.lag("_path").over(Window.partitionBy(batch).orderBy("_path"))
    return rows.select(batch, F.coalesce(F.col("_path").startswith(before), F.lit(False)).alias("_meets")).groupBy(batch).agg(F.max("_meets").alias("overlap"))


def parallel_batches(calls: DataFrame, never: tuple[str, ...], scoped: tuple[str, ...], safe: tuple[str, ...]) -> DataFrame:
    """batch and parallel: whether the calls (batch, tool, arguments as JSON) of a batch may run at the same time.

    Not if there is only one, if any is exclusive or unknown, if its arguments are no JSON object, or if the paths of tools
    on files are missing, blank or overlap. A relative path is one below the same folder as others.
    """
    given = F.try_parse_json("arguments")
    is_object = F.coalesce(F.trim("arguments").startswith("{") & given.isNotNull(), F.lit(False))
    on_file = F.col("tool").isin(list(scoped))
    path = F.when(on_file, F.try_variant_get(given, "$.path", "string"))
    fits = ~F.col("tool").isin(list(never)) & is_object & F.when(on_file, F.coalesce(F.trim(path) != "", F.lit(False))).otherwise(F.col("tool").isin(list(safe)))
    rows = calls.select("batch", "tool", fits.alias("fits"), path.alias("path"))
    each = rows.groupBy("batch").agg(((F.count("*") > 1) & F.min(F.coalesce("fits", F.lit(False)))).alias("fits"))
    return each.join(overlapping(rows, "batch", "path"), "batch", "left").select("batch", (F.col("fits") & ~F.coalesce("overlap", F.lit(False))).alias("parallel"))
