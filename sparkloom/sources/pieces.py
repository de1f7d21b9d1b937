"""Data sources that read parts of files: the last lines of logs from their ends, members of ZIP archives."""

from __future__ import annotations

import csv
import fnmatch
import io
import zipfile
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.stages import written

BLOCK = 1 << 16


def opened(path: str):
    """A file of any store that Arrow knows, with random access."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


@dataclass
class Piece(InputPartition):
    path: str
    member: str = ""


def last_lines(file, n: int, block: int = BLOCK) -> list[bytes]:
    """The last n lines of a file, read backwards by blocks; a last line needs no line break."""
    end = file.size()
    held, at = b"", end
    while at > 0 and held.removesuffix(b"\n").count(b"\n") < n:
        size = min(block, at)
        at -= size
        file.seek(at)
        held = file.read(size) + held
    return held.removesuffix(b"\n").split(b"\n")[-n:] if held and n > 0 else []


class TailReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.lines, self.block = int(options.get("lines", "50")), int(options.get("block", str(BLOCK)))

    def partitions(self):
        return [Piece(p) for p in self.paths]

    def read(self, partition):
        with opened(partition.path) as file:
            lines = last_lines(file, self.lines, self.block)
        for k, line in enumerate(lines):
            yield partition.path, len(lines) - k, line.decode("utf-8", "replace").rstrip("\r")


class TailSource(DataSource):
    """path, from_end (1 is the last) and value of the last ``lines`` lines of each of ``paths``, one on a line."""

    @classmethod
    def name(cls):
        return "tail"

    def schema(self):
        return "path string, from_end int, value string"

    def reader(self, schema):
        return TailReader(self.options)


class ZipCsvReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        self.paths, self.member = [p for p in options["paths"].split("\n") if p], options.get("member", "*.csv")
        self.limit, self.holds = int(options.get("limit", "-1")), options.get("holds", "").lower()

    def partitions(self):
        found = []
        for path in self.paths:
            with opened(path) as file, zipfile.ZipFile(file) as archive:
                found += [Piece(path, m) for m in archive.namelist() if fnmatch.fnmatch(m, self.member)]
        return found

    def read(self, partition):
        given = 0
        with opened(partition.path) as file, zipfile.ZipFile(file) as archive, archive.open(partition.member) as member:
            for row in csv.DictReader(io.TextIOWrapper(member, "utf-8-sig", "replace", newline="")):
                if self.limit >= 0 and given >= self.limit:
                    return  # what follows isn't unpacked
                if not self.holds or any(self.holds in (v or "").lower() for v in row.values() if not isinstance(v, list)):
                    given += 1
                    yield tuple(row.get(c) for c in self.columns)


class ZipCsvSource(DataSource):
    """Rows of the CSV members of ZIP archives, a task a member: columns by name, a missing one null.

    ``member`` is a pattern of names, ``holds`` a text that a row must hold somewhere, ``limit`` the rows of a member at most.
    """

    @classmethod
    def name(cls):
        return "zip_csv"

    def schema(self):
        return ", ".join(f"`{c}` string" for c in self.options["columns"].split(","))

    def reader(self, schema):
        return ZipCsvReader(schema, self.options)


def tail(spark: SparkSession, paths: list[str], lines: int = 50, block: int = BLOCK) -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.read.format("tail").option("paths", "\n".join(paths)).option("lines", lines).option("block", block).load()


def zip_csv(spark: SparkSession, paths: list[str], columns: list[str], member: str = "*.csv", holds: str = "", limit: int = -1) -> DataFrame:
    spark.dataSource.register(ZipCsvSource)
    return spark.read.format("zip_csv").option("paths", "\n".join(paths)).option("columns", ",".join(columns)).option("member", member).option("holds", holds).option("limit", limit).load()


def with_ordinal(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a file source with their number in their file, from 0: places in a split, after the rows of earlier splits.

    The rows are written once, so that splits and places are those of one scan.
    """
    placed = written(rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id")), "ordinal")
    splits = placed.groupBy("_file", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(splits, ["_file", "_split"]).withColumn(name, F.col("_start") + F.col("_id") - F.col("_first")).select(*rows.columns, name)
