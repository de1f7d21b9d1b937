"""Writers and the table operators of stores."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .pieces import with_ordinal


def jsonl_by_outcome(rows: DataFrame, path: str, flag: str = "completed") -> None:
    """Completed and failed rows in folders of their own, appended to."""
    rows.write.mode("append").partitionBy(flag).json(path)


def jsonl_batches(rows: DataFrame, path: str, size: int, order: list[str]) -> None:
    """ceil(n / size) folders ``batch=i`` from 0, a file each: the rows in ``order``, ``size`` at a time, the last ones fewer.

    The order is kept within files. No rows, no file; a column called ``batch`` is an error. Rows equal in ``order`` stand in any order.
    """
    if size < 1 or "batch" in rows.columns:
        raise ValueError("size must be positive, and no column be called batch")
    placed = numbered(rows.withColumn("_all", F.lit(0)), "_all", order, "_place").drop("_all")
    dealt = placed.withColumn("batch", F.floor((F.col("_place") - 1) / size)).repartition("batch").sortWithinPartitions("batch", "_place")
    dealt.drop("_place").write.mode("overwrite").partitionBy("batch").json(path)


def merged(spark: SparkSession, paths: list[str], out: str | None = None) -> DataFrame:
    """Part files as one table, in the order of their names as text, then of the rows in each; the file called ``out`` is left out."""
    read = spark.read.json(paths)
    rows = read.select("*", F.col("_metadata.file_name").alias("_name"))
    if out:
        rows = rows.where(F.col("_metadata.file_name") != out)
    return with_ordinal(rows, "_row").orderBy("_name", "_row").drop("_name", "_row")


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder that holds the table at ``path`` now; null if none was ever written whole."""
    hadoop, where, fs = _files(spark, path)
    pointer = hadoop.Path(where, "_current")
    if not fs.exists(pointer):
        return None
    opened = fs.open(pointer)
    try:
        return f"{path}/{opened.readUTF()}"
    finally:
        opened.close()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``replaced`` wrote last."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(version)


def replaced(rows: DataFrame, path: str) -> None:
    """The whole table anew, seen at once: a version is written beside the others, then a pointer to it is renamed into place.

    A writer that fails leaves the table as it was, and ``rows`` may be read from it. The version before stays for readers
    that have begun; older ones go. Two writers at a time: the later rename counts.
    """
    spark = rows.sparkSession
    before, name = current_version(spark, path), f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    hadoop, where, fs = _files(spark, path)
    fresh = hadoop.Path(where, f"_{name}")
    out = fs.create(fresh)
    out.writeUTF(name)
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, hadoop.Path(where, "_current"), options)
    kept = {name, (before or "").rpartition("/")[2]}
    for status in fs.listStatus(where):
        old = status.getPath().getName()
        if old.startswith("v-") and old not in kept:
            fs.delete(status.getPath(), True)


def csv_with_header(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def imported_cards(rows: DataFrame, default: str) -> DataFrame:
    """Front, back and collection of imported rows: blank ones are skipped, a blank collection is the default."""
    full = rows.where((F.trim("front") != "") & (F.trim("back") != ""))
    return full.withColumn("collection", F.coalesce(F.nullif(F.trim("collection"), F.lit("")), F.lit(default)))


def exported_cards(rows: DataFrame, path: str) -> None:
    """Front, back and collection as CSV without a header, as ``imported_cards`` takes them."""
    rows.select("front", "back", "collection").write.mode("overwrite").option("header", False).option("escape", '"').csv(path)


def markdown_row(columns: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))


def exported_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """A JSON document for each session, its messages in order."""
    said = messages.groupBy(F.col("session_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("messages"))
    return sessions.join(said, "id", "left").select("id", F.to_json(F.struct("*")).alias("json"))


def upsert(old: DataFrame, new: DataFrame, key: str, kept: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Field by field the new value if there is one; fields in ``kept`` keep the old one."""
    fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    a = old.select(key, *[F.col(c).alias(f"_a_{c}") for c in old.columns if c != key])
    b = new.select(key, *[F.col(c).alias(f"_b_{c}") for c in new.columns if c != key])
    have = lambda side, c, df: [F.col(f"_{side}_{c}")] if c in df.columns else []
    pick = lambda c: have("a", c, old) + have("b", c, new) if c in kept else have("b", c, new) + have("a", c, old)
    return a.join(b, key, "full").select(key, *[F.coalesce(*pick(c)).alias(c) for c in fields])


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` whose key is in neither ``old`` nor twice in ``new``."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
