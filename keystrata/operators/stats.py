"""Measures of a run: sizes, positional quantiles, reports by class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def scan(files: DataFrame, *by: str) -> DataFrame:
    """Files and bytes."""
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def quantiles(rows: DataFrame, by: str, value: str, at: dict[str, float]) -> DataFrame:
    """Per class, the values at position floor(n * q) of the sorted values (the last at most), and the maximum.

    A distributed prefix sum: distinct values with their counts are range-partitioned,
    counted up inside each partition, and shifted by the totals of the partitions
    before it, so no task holds a class, however large.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = cut(counts.repartitionByRange(by, value).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(by, "_part").agg(F.sum("_c").alias("_t"))  # one row for each class and partition
    w = Window.partitionBy(by).orderBy("_part")
    parts = parts.withColumn("_before", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).withColumn("_n", F.sum("_t").over(Window.partitionBy(by))).drop("_t")
    inside = F.sum("_c").over(Window.partitionBy(by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("_upto", inside).join(parts, [by, "_part"]).withColumn("_upto", F.col("_upto") + F.col("_before"))
    found = [F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_n") * q), F.col("_n") - 1), F.col(value))).alias(name) for name, q in at.items()]
    return ranked.groupBy(by).agg(*found, F.max(value).alias("max"))
