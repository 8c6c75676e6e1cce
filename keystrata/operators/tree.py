"""Directories as entries(dir, name, ...): lookup, paths, pages, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_entry(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(dir, name) rows with their entry."""
    return asked.join(entries, ["dir", "name"])


def separator_lookup(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """``asked`` (dir, name) with the child of the first separator not below the name.

    Both sides are put in one order per directory and the next separator is
    looked up from there, so no row meets more than one pair.
    """
    a = asked.select("dir", "name", F.lit(None).cast("string").alias("child"), F.lit(1).alias("_asked"))
    p = pairs.select("dir", F.col("sep").alias("name"), F.col("child").cast("string").alias("child"), F.lit(0).alias("_asked"))
    w = Window.partitionBy("dir").orderBy(F.col("name").desc(), F.col("_asked")).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(p).withColumn("child", F.last("child", ignorenulls=True).over(w)).filter("_asked = 1").drop("_asked")


def path_parts(path: Column) -> Column:
    """Components of a path; empty ones and dots are skipped."""
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def path_error(path: Column) -> Column:
    return F.when(F.exists(F.split(path, "/"), lambda p: p == ".."), "parent component")


def resolve_path(asked: DataFrame, entries: DataFrame, most_depth: int) -> DataFrame:
    """``asked`` (id, root, path) with the directory or file it leads to (null: no such path).

    One join for each component, up to ``most_depth`` components.
    """
    at = asked.filter(path_error(F.col("path")).isNull()).withColumn("_parts", path_parts(F.col("path"))).withColumn("target", F.col("root"))
    steps = entries.select(F.col("dir").alias("_dir"), F.col("name").alias("_name"), F.col("child").alias("_child"))
    for k in range(most_depth):
        part = F.get("_parts", F.lit(k))
        at = at.withColumn("_part", part).join(steps, (F.col("target") == F.col("_dir")) & (F.col("_part") == F.col("_name")), "left")
        at = at.withColumn("target", F.when(F.col("_part").isNull(), F.col("target")).otherwise(F.col("_child"))).drop("_dir", "_name", "_child", "_part")
    return at.withColumn("target", F.when(F.size("_parts") <= most_depth, F.col("target"))).drop("_parts")


def list_entries(entries: DataFrame, after: Column, limit: int) -> DataFrame:
    """For each directory the first ``limit`` names beyond ``after``, with ``more`` where the page is full and something follows."""
    if limit < 1:
        raise ValueError("limit must be positive")
    w = Window.partitionBy("dir").orderBy("name")
    ranked = entries.filter(F.col("name") > after).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit + 1)
    full = F.max("rank").over(Window.partitionBy("dir")) > limit
    return ranked.withColumn("more", full).filter(F.col("rank") <= limit)


def order_faults(entries: DataFrame) -> DataFrame:
    """Entries whose name does not exceed the one before it in recorded order."""
    w = Window.partitionBy("dir").orderBy("pos")
    return entries.withColumn("_before", F.lag("name").over(w)).filter(F.col("name") <= F.col("_before")).drop("_before")


def disk_usage(entries: DataFrame) -> DataFrame:
    """Entries and bytes per top directory, per directory and in all."""
    return entries.rollup("top", "dir").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("size").cast("long").alias("bytes"))


def aligned(rows: DataFrame, column: str, by: str) -> DataFrame:
    """``column`` right-aligned to the widest of its group."""
    width = F.max(F.length(column)).over(Window.partitionBy(by))
    return rows.withColumn(column, F.lpad(F.col(column), width, F.lit(" ")))
