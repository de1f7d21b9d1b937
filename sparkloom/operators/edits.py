"""Lines through edits of many files: edit scripts by longest matching blocks, lines joined with them by bins."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a bin: a line meets the few opcodes of its bin, and an opcode goes to the bins that it spans.
BIN = 256
OPCODES = "file string, tag string, i1 long, i2 long, j1 long, j2 long, lines long, same boolean"


def opcodes(files: DataFrame) -> DataFrame:
    """The edit script of each file (file, before, after): its opcodes, the number of lines after, and whether nothing changed.

    A null text is empty. An edit script needs both texts of a file together, one file at a time. Inserts cover no line before.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, before, after in frame.itertuples(index=False):
                a, b = (before or "").splitlines(), (after or "").splitlines()
                script = [("equal", 0, len(a), 0, len(b))] if a == b else difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()
                out += [(name, *op, len(b), a == b) for op in script or [("equal", 0, 0, 0, 0)]]
            yield pd.DataFrame(out, columns=["file", "tag", "i1", "i2", "j1", "j2", "lines", "same"])

    rows = files.select(F.col("file").cast("string"), F.col("before").cast("string"), F.col("after").cast("string")).where("file is not null")
    return rows.mapInPandas(run, OPCODES)


def remapped(lines: DataFrame, script: DataFrame) -> DataFrame:
    """``lines`` (file, line and others) with ``moved``, where each line is after the edits.

    Kept lines shift; deleted and replaced ones have no place, nor has any line of a file that is empty after; what is past
    the end goes to the last line. Lines of a file that wasn't edited, or not at all, stay where they are.
    """
    facts = script.groupBy("file").agg(F.max("lines").alias("_lines"), F.max("i2").alias("_end"), F.first("same").alias("_same"))
    spans = script.where("i2 > i1").select("file", "tag", "i1", "i2", "j1", F.explode(F.sequence(F.expr(f"i1 div {BIN}"), F.expr(f"(i2 - 1) div {BIN}"))).alias("_bin"))
    rows = lines.withColumn("_bin", F.expr(f"line div {BIN}"))
    inside = (rows["file"] == spans["file"]) & (rows["_bin"] == spans["_bin"]) & (rows["line"] >= spans["i1"]) & (rows["line"] < spans["i2"])
    met = rows.join(spans, inside, "left").select(*[rows[c] for c in lines.columns], "tag", "i1", "j1")
    met = met.join(facts, "file", "left")
    last = F.when(F.col("_lines") > 0, F.col("_lines") - 1)
    moved = F.when(F.col("_same").isNull() | F.col("_same"), F.col("line")).when(F.col("tag") == "equal", F.col("line") - F.col("i1") + F.col("j1")).when(F.col("tag").isNotNull(), None).when(F.col("line") >= F.col("_end"), last)
    return met.select(*lines.columns, moved.cast("long").alias("moved"))


def remapped_ranges(marks: DataFrame, script: DataFrame) -> DataFrame:
    """Marks (file, mark, start, stop) after the edits: gone with their first line, cut to it where only their last is gone."""
    ends = marks.select("file", "mark", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("start").alias("line")), F.struct(F.lit(1).alias("which"), F.col("stop").alias("line")))).alias("e")).select("file", "mark", "e.which", "e.line")
    moved = remapped(ends, script).groupBy("file", "mark").agg(F.max(F.when(F.col("which") == 0, F.col("moved"))).alias("start"), F.max(F.when(F.col("which") == 1, F.col("moved"))).alias("stop"))
    return moved.where("start is not null").select("file", "mark", "start", F.coalesce("stop", "start").alias("stop"))
