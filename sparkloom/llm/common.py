"""What the operators of this package share: table access, lineage cuts, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters with the Unicode property White_Space, as a regex class body.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The ASCII white space that separates words in the word-based operators, for Java and Python.
WORD = "[^\\x20\\x09-\\x0D]+"
LETTER = "\\p{L}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A temporary one stands in only where all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Shuffle files of a finished write are of no more use; they go at once, not with the driver's garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an id table that are broadcast, at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of one key that go to a part of a shuffled join with a lookup, about.
HOT_ROWS = 1000


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*settled: DataFrame) -> None:
    """Delete tables that ``settle`` wrote and no plan reads any more."""
    for df in settled:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, lookup: DataFrame, on: list[str], n: int | None, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with a ``lookup`` of ``n`` rows by keys that may hold a large share of ``rows``.

    A small lookup is broadcast, but not where ``n`` is None. For others the rows of a key that has many are dealt
    by all their columns to parts of ``HOT_ROWS``, and the key's lookup rows go to each of them. ``counts`` holds
    ``_n``, the rows of each key of the lookup, where the caller has counted them.
    """
    if n is not None and n <= BROADCAST_IDS:
        return rows.join(F.broadcast(lookup), on, how)
    hot = (rows.groupBy(*on).agg(F.count("*").alias("_n")) if counts is None else counts).where(F.col("_n") > HOT_ROWS)
    hot = settle(hot.select(*on, F.ceil(F.col("_n") / HOT_ROWS).alias("_parts")), "hot")
    known = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    part = F.coalesce(F.pmod(F.xxhash64(*rows.columns), "_parts"), F.lit(0).cast("long"))
    dealt = rows.join(known, on, "left").withColumn("_part", part).drop("_parts")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts") - 1, F.lit(0).cast("long"))))
    copies = lookup.join(known, on, "left").withColumn("_part", parts).drop("_parts")
    return dealt.join(copies, [*on, "_part"], how).drop("_part")


#: Rows of an Arrow batch: with whole texts in them, the default of 10,000 would be tens of MB on both sides.
BATCH_ROWS = 1000


def short_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose session sends batches of texts to Python that are short."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs


def keyed_text(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators read; columns beside them can't clash."""
    short_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Rows that no model of this package learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow, after which its worker, which stays for other tasks, gives back what it held."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            pass

    return wrapped


def text_slices(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) slices of about ``chars`` characters; a null text is empty."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for key, value in zip(batch.column(0), batch.column(1), strict=True):
            text = value.as_py() or ""
            ids.append(key.as_py())
            texts.append(text)
            size += len(text) + 64
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, parts: int, part: int) -> DataFrame:
    """doc_id, text and y of about ``bound`` labelled documents at most, none of them held out.

    Of a doc_id labelled twice the highest label counts. The sample is chosen by a hash of
    doc_id, so it is the same every time; being bounded, its ids are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), parts, part))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, bound / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < int(share * 1_000_000))
    return keyed_text(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")
