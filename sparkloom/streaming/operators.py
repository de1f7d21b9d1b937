"""Operators for batches and streams alike, and the stateful ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_batches(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Events of a key merged until it is quiet for ``gap``; in their order."""
    found = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("parts"))
    return found.select(key, F.col("w.start").alias("start"), "n", F.array_join(F.transform("parts", lambda x: x["event_type"]), ",").alias("merged"))


def quiet_gap(size: Column, cap: float, tiers: tuple[tuple[int, float], ...], split_at: int, split_gap: float) -> Column:
    """How long to wait for more after a text, as an interval: short texts (``tiers`` of length and seconds, shortest
    first) wait less, never longer than ``cap``; one near the length at which texts are split waits for its rest."""
    gap = F.when(size >= split_at, F.lit(float(split_gap)))
    for most, seconds in tiers:
        gap = gap.when(size <= most, F.lit(float(min(cap, seconds))))
    return F.make_interval(secs=gap.otherwise(F.lit(float(cap))).cast("decimal(18,6)"))


def text_batches(messages: DataFrame, key: str, gap: Column) -> DataFrame:
    """(key, start, n, merged): texts (ts, id, text) of a key joined until it has been quiet for the longest wait of any of
    them; each message brings its own. Null texts count as empty. The same on a stream with a watermark."""
    parts = F.array_sort(F.collect_list(F.struct("ts", "id", F.coalesce("text", F.lit("")).alias("text"))))
    found = messages.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), parts.alias("parts"))
    return found.select(key, F.col("w.start").alias("start"), "n", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("merged"))


def windowed(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def timed(events: DataFrame, late: str) -> DataFrame:
    """Event time with a watermark, for streams."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return timed(events, late).dropDuplicatesWithinWatermark(keys)


def token_bucket(events: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """event_id, passed and the wait in seconds of those that must wait; state is a key's own."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        tokens, last, out = capacity, None, []
        for key, ts in zip(pdf["event_id"], pdf["ts"], strict=True):
            if last is not None:
                tokens = min(capacity, tokens + (ts - last).total_seconds() * per_second)
            last = ts
            passed = tokens >= 1
            out.append((key, passed, 0.0 if passed else (1 - tokens) / per_second))
            tokens -= passed
        return pd.DataFrame(out, columns=["event_id", "passed", "wait_s"])

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandas(fold, "event_id long, passed boolean, wait_s double")
