"""The object store as relations: objects(key, data, seg_id), pack_index(seg_id, key, off, slen, sealed_at).

Joins on keys only; payloads are never selected unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD_HEADER = 46


def first_of_batch(batch: DataFrame, order: str = "pos") -> DataFrame:
    """``batch`` (key, pos, size) with ``fresh``: whether the row is the first of its key in the batch."""
    first = batch.groupBy("key").agg(F.min(order).alias("_first"))
    return batch.join(first, "key").withColumn("fresh", F.col(order) == F.col("_first")).drop("_first")


def classify_batch(batch: DataFrame, stored: DataFrame, order: str = "pos") -> DataFrame:
    """Each row of the batch with ``is_new``: first of its key and not yet in the store."""
    known = stored.select("key").distinct().withColumn("_known", F.lit(True))
    return first_of_batch(batch, order).join(known, "key", "left").withColumn("is_new", F.col("fresh") & F.col("_known").isNull()).drop("_known", "fresh")


def write_stats(classified: DataFrame, *by: str) -> DataFrame:
    """stored, deduped, bytes_stored (uncompressed bytes of new objects)."""
    return classified.groupBy(*by).agg(
        F.count_if("is_new").cast("long").alias("stored"), F.count_if(~F.col("is_new")).cast("long").alias("deduped"),
        F.coalesce(F.sum(F.when(F.col("is_new"), F.col("size"))), F.lit(0)).cast("long").alias("bytes_stored"),
    )


def write_batch(batch: DataFrame, path: str, seg_id: int, stored: DataFrame | None = None) -> DataFrame:
    """Append the batch's new objects to the Parquet store as one segment; returns the write's statistics."""
    spark = batch.sparkSession
    known = stored if stored is not None else spark.createDataFrame([], "key binary")
    rows = classify_batch(batch, known)
    rows.filter("is_new").select("key", "data", F.lit(seg_id).cast("long").alias("seg_id")).write.mode("append").partitionBy("seg_id").parquet(path)
    return write_stats(rows)


def has(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``keys`` that the store has."""
    return keys.join(index.select("key"), "key", "left_semi")


def missing(keys: DataFrame, index: DataFrame, order: str = "pos") -> DataFrame:
    """Rows of ``keys`` that the store lacks: order and repeats stay."""
    return keys.join(index.select("key"), "key", "left_anti").orderBy(order)


def newest(index: DataFrame) -> DataFrame:
    """One row for each key: that of its newest segment."""
    columns = [c for c in index.columns if c != "key"]
    return index.groupBy("key").agg(F.max_by(F.struct(*columns), F.struct("seg_id", "off")).alias("_n")).select("key", "_n.*")


def get(keys: DataFrame, objects: DataFrame) -> DataFrame:
    """``keys`` joined to their newest copy; unknown keys are left out."""
    return keys.join(newest(objects), "key")


def get_verified(keys: DataFrame, objects: DataFrame, good: Column) -> DataFrame:
    """``get`` with ``verified``; a bad newest copy is shown as such, never replaced by an older one."""
    return get(keys, objects).withColumn("verified", F.coalesce(good, F.lit(False)))


def stored_size(keys: DataFrame, index: DataFrame) -> DataFrame:
    """``keys`` with the stored length from the index alone, null where absent."""
    return keys.join(newest(index).select("key", F.col("slen").alias("stored_size")), "key", "left")


def has_outside(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (seg_id, key) whose key is also in another segment.

    More than one distinct segment per key says it: no self-join on hot keys.
    """
    spread = index.groupBy("key").agg(F.min("seg_id").alias("_a"), F.max("seg_id").alias("_b"))
    return rows.join(spread, "key").filter((F.col("_a") != F.col("seg_id")) | (F.col("_b") != F.col("seg_id"))).drop("_a", "_b")


def has_durably(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``keys`` with a durable copy."""
    return keys.join(index.filter("durable").select("key"), "key", "left_semi")


def good_survivors(rows: DataFrame, index: DataFrame, victims: DataFrame, good: Column) -> DataFrame:
    """Rows of ``rows`` whose key has a verifying copy outside the victim segments."""
    outside = index.join(victims.select("seg_id"), "seg_id", "left_anti").filter(good)
    return rows.join(outside.select("key"), "key", "left_semi")


def sort_by_location(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Keys in order of segment and offset, absent ones last."""
    placed = keys.join(newest(index).select("key", "seg_id", "off"), "key", "left")
    return placed.orderBy(F.col("seg_id").asc_nulls_last(), F.col("off").asc_nulls_last(), "pos")


def segments(index: DataFrame) -> DataFrame:
    """Per segment: sealing time, body bytes, keys."""
    return index.groupBy("seg_id").agg(F.max("sealed_at").alias("sealed_at"), F.sum(F.lit(RECORD_HEADER) + F.col("slen")).cast("long").alias("body_bytes"), F.count(F.lit(1)).alias("n_keys"))


def index_section(index: DataFrame) -> DataFrame:
    """Per segment and first key byte: entries, and the running count up to and with that byte."""
    per = index.groupBy("seg_id", F.substring("key", 1, 2).alias("first_byte")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("seg_id").orderBy("first_byte").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("upto", F.sum("n").over(w).cast("long"))


def verify(records: DataFrame, good: Column) -> DataFrame:
    """Per segment, records and those that fail."""
    return records.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(~F.coalesce(good, F.lit(False))).cast("long").alias("n_bad"))


def index_faults(index: DataFrame, records: DataFrame) -> DataFrame:
    """Index rows without their record, and records without their index row."""
    columns = ["seg_id", "key", "off"]
    a, b = index.select(*columns), records.select(*columns)
    return a.exceptAll(b).withColumn("fault", F.lit("no record")).unionByName(b.exceptAll(a).withColumn("fault", F.lit("not indexed")))


def chunk_dedup(chunks: DataFrame, *by: str) -> DataFrame:
    """Per group: chunks, distinct chunks, bytes and bytes of the distinct ones."""
    per = chunks.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("_n"), F.max("size").alias("_size"))
    return per.groupBy(*by).agg(
        F.sum("_n").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), F.sum(F.col("_n") * F.col("_size")).cast("long").alias("logical_bytes"), F.sum("_size").cast("long").alias("unique_bytes")
    )


def grey_set(touched: DataFrame, since: Column) -> DataFrame:
    """Keys written or met again since a cycle began: they count as live."""
    return touched.filter(F.col("epoch") >= since).select("key").distinct()
