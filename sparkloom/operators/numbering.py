"""Numbers in order within groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import written


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place in their group, from 1: places within ranges of the order, after the rows of earlier ranges."""
    placed = written(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = placed.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    met = own.join(starts, own[group].eqNullSafe(starts["_group"]) & (own["_part"] == starts["_at"]))
    return met.withColumn(name, F.col("_start") + F.col("_place")).select(*rows.columns, name)
