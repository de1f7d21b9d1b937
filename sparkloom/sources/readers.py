"""Readers: each gives a DataFrame and leaves the scan to Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import with_ordinal

#: Files that a crawl leaves out by their extension, and the largest it reads.
SKIPPED = (
    ".exe", ".dll", ".so", ".dylib", ".bin", ".dat", ".db", ".sqlite", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".ico", ".svg",
    ".mp3", ".mp4", ".avi", ".mkv", ".mov", ".zip", ".tar", ".gz", ".7z", ".rar", ".xlsx", ".pptx", ".pyc", ".pyo", ".ttf", ".otf", ".woff", ".woff2",
)
MAX_BYTES = 50 * 1024 * 1024
MAX_CHARS = 100_000


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a line; blank lines are skipped, broken ones are kept in ``_corrupt``."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return (reader.schema(schema) if schema else reader).json(path)


def conversations(rows: DataFrame) -> DataFrame:
    """Rows that have ``conversations`` or ``messages`` under one name."""
    names = [c for c in ("conversations", "messages") if c in rows.columns]
    return rows.withColumn("conversations", F.coalesce(*map(F.col, names))) if names else rows.withColumn("conversations", F.lit(None))


def csv(spark: SparkSession, path: str, required: list[str] | None = None, ordinal: str | None = None) -> DataFrame:
    """A CSV with a header; a missing required column is an error. The ordinal is a row's number in its file."""
    rows = spark.read.option("header", True).csv(path)
    if missing := [c for c in required or [] if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return with_ordinal(rows, ordinal) if ordinal else rows


def headless_csv(spark: SparkSession, path: str, columns: list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """A CSV without a header: short rows are filled up, long ones cut."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.option("mode", "PERMISSIVE").option("encoding", encoding).schema(schema).csv(path).na.fill("")


def crawl(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Files below a folder with their size, time and content, but for skipped ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    extension = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    kept = files.withColumn("extension", extension).where(~F.col("extension").isin(*SKIPPED) & (F.col("length") <= MAX_BYTES))
    return kept.where(~path_has_segment(F.col("path"), excluded)) if excluded else kept


def path_has_segment(path: Column, segments: tuple[str, ...]) -> Column:
    """Whether a whole segment of the path, with either slash, is one of these."""
    return F.arrays_overlap(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.array(*map(F.lit, segments)))


def texts(files: DataFrame) -> DataFrame:
    """Text of crawled files: UTF-8, else Latin-1; its first characters and its words."""
    latin = F.decode("content", "ISO-8859-1")
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = files.withColumn("text", F.substring(F.coalesce(utf8, latin), 1, MAX_CHARS))
    return rows.withColumn("word_count", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))


def notebook_text(content: Column) -> Column:
    """Source of the cells of a notebook."""
    cells = F.from_json(content, "struct<cells:array<struct<cell_type:string,source:array<string>>>>")["cells"]
    return F.array_join(F.transform(cells, lambda c: F.array_join(c["source"], "")), "\n")


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of an RSS feed: guid, else link; items without an id are left out."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("guid string, link string, title string, description string").load(path)
    return rows.select(F.coalesce("guid", "link").alias("id"), "title", F.col("link").alias("url"), F.col("description").alias("summary")).where("id IS NOT NULL")


def dig(json: Column, path: str) -> Column:
    """The value at a dotted path."""
    return F.get_json_object(json, "$." + path)


def parallel_arrays(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Arrays side by side as rows; shorter ones are filled with nulls."""
    zipped = rows.select(*[c for c in rows.columns if c not in columns], F.explode(F.arrays_zip(*columns)).alias("_z"))
    return zipped.select(*[c for c in rows.columns if c not in columns], *[F.col(f"_z.{c}").alias(c) for c in columns])


LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def log_fields(lines: DataFrame) -> DataFrame:
    """ts, level, session, logger and message of log lines; null where a line hasn't one."""
    pattern = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)?\S*\s*([A-Z]+)?\s*(?:\[([^\]]+)\])?\s*([\w.]+)?:?\s*(.*)$"
    part = lambda k: F.nullif(F.regexp_extract("value", pattern, k), F.lit(""))
    return lines.select("value", F.try_to_timestamp(part(1)).alias("ts"), part(2).alias("level"), part(3).alias("session"), part(4).alias("logger"), part(5).alias("message"))


def log_filter(lines: DataFrame, since: str | None = None, level: str | None = None, session: str | None = None, component: str | None = None) -> DataFrame:
    """Lines without a time or level pass those filters; lines without a logger fail theirs."""
    rows = log_fields(lines)
    rank = F.coalesce(*[F.when(F.col("level") == name, F.lit(n)) for name, n in LEVELS.items()])
    if since:
        rows = rows.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(since).cast("timestamp")))
    if level:
        rows = rows.where(rank.isNull() | (rank >= LEVELS[level]))
    if session:
        rows = rows.where(F.coalesce(F.col("value").contains(session), F.lit(False)))
    if component:
        rows = rows.where(F.coalesce(F.col("logger").startswith(component), F.lit(False)))
    return rows
