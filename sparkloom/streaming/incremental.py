"""Totals kept up to date: each batch of a stream takes back what its entities gave before and adds what they give now.

A batch writes two folders under its number: what each of its entities contributes from now on, and by how much totals
change. It reads only folders of lesser numbers, so a batch that is run again, with the same rows or others, writes the
same folders anew and totals are those of a full recompute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN, CHANGED = "contributions", "changes"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema + ", batch long").option("basePath", folder).parquet(folder)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema + ", batch long")


def apply_batch(rows: DataFrame, batch: int, folder: str) -> None:
    """Put the entities of ``rows`` (entity, group, amount) in the place of what they were.

    An entity's rows are all it contributes; one with a null group contributes nothing any more. Rows without an entity are
    left out, a null amount is none.
    """
    spark = rows.sparkSession
    kind = rows.schema["entity"].dataType.simpleString(), rows.schema["group"].dataType.simpleString()
    schema = f"entity {kind[0]}, `group` {kind[1]}, n long, total double"
    now = rows.where("entity is not null").groupBy("entity", "group").agg(F.count(F.when(F.col("group").isNotNull(), 1)).alias("n"), F.coalesce(F.sum(F.col("amount").cast("double")), F.lit(0.0)).alias("total"))
    now.write.mode("overwrite").parquet(f"{folder}/{GIVEN}/batch={batch}")
    now = spark.read.schema(schema).parquet(f"{folder}/{GIVEN}/batch={batch}")
    past = _read(spark, f"{folder}/{GIVEN}", schema).where(F.col("batch") < batch)
    past = past.join(now.select("entity").distinct(), "entity", "left_semi")
    last = past.groupBy("entity").agg(F.max("batch").alias("batch"))
    before = past.join(last, ["entity", "batch"])
    change = now.select("group", "n", "total").unionByName(before.select("group", (-F.col("n")).alias("n"), (-F.col("total")).alias("total")))
    change.where("`group` is not null").groupBy("group").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).write.mode("overwrite").parquet(f"{folder}/{CHANGED}/batch={batch}")


def totals(spark: SparkSession, folder: str, group_type: str = "string") -> DataFrame:
    """group, n and total of what all entities contribute now."""
    changes = _read(spark, f"{folder}/{CHANGED}", f"`group` {group_type}, n long, total double")
    return changes.groupBy("group").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")


def maintained(stream: DataFrame, folder: str, checkpoint: str, **trigger):
    """The running query that keeps the totals in ``folder`` up to date with a stream of (entity, group, amount)."""
    return stream.writeStream.foreachBatch(lambda rows, batch: apply_batch(rows, batch, folder)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
