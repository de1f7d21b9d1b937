"""Plans of stream operators as batches; the same operators run on streams in ``streaming``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import operators as ops
from .base import query

TEN = 600


@query(f"""SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY ts, event_id) AS merged FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {TEN} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
FROM (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s""")
def session_gap_batches(t):
    return ops.session_batches(t.events, "user_id", "10 minutes").select("user_id", "n", "merged")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id < 200)")
def watermark_new(t):
    """What is unseen, duplicates of one batch included."""
    seen = t.events.where("event_id < 200").select("user_id")
    return t.events.join(seen, "user_id", "left_anti").select("event_id")


@query("SELECT event_id, user_id FROM events WHERE event_id > 7500 AND user_id % 10 = 3")
def unseen_events(t):
    return t.events.where("event_id > 7500 AND user_id % 10 = 3").select("event_id", "user_id")


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def consecutive_dedup(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("before", F.lag("event_type").over(w)).where(~F.col("before").eqNullSafe(F.col("event_type"))).select("event_id", "event_type")


@query("""SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.h = b.h THEN 'skipped' ELSE 'changed' END AS change
FROM (SELECT doc_id AS id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0) a FULL OUTER JOIN (SELECT doc_id AS id, md5(CASE WHEN doc_id % 6 = 0 THEN concat(text, '+') ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0) b ON a.id = b.id""")
def incremental_scan(t):
    """Change data by digest: only digests are compared, texts don't move."""
    old = t.documents.where("doc_id % 5 != 0").select(F.col("doc_id").alias("id"), F.md5("text").alias("old"))
    new = t.documents.where("doc_id % 7 != 0").select(F.col("doc_id").alias("id"), F.md5(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text"))).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "skipped").otherwise("changed")
    return old.join(new, "id", "full").select("id", change.alias("change"))


@query("SELECT event_type, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_events(t):
    return ops.windowed(t.events, "1 hour").select("event_type", F.unix_timestamp(F.col("start").cast("timestamp")).alias("start"), "n", "total")


@query("""SELECT event_type, start, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT event_type, value, CAST(floor(epoch(ts)) AS BIGINT) // 1800 * 1800 - 1800 * k AS start FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY 1, 2""")
def sliding_events(t):
    return ops.windowed(t.events, "1 hour", "30 minutes").select("event_type", F.unix_timestamp(F.col("start").cast("timestamp")).alias("start"), "n", "total")


@query()
def token_bucket(t):
    """A fold over each user's events: what the bucket lets through and how long the rest waits."""
    return ops.token_bucket(t.events, capacity=2.0, per_second=1 / 3600)
