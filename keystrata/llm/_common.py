"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import json
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A value counts as a heavy hitter from this share of the rows on; at most
#: ``1 / HOT_SHARE`` values can, which bounds the broadcast side of a join.
HOT_SHARE = 0.01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; in local mode a folder of our own if it is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="keystrata-checkpoint-")
    sc.setCheckpointDir(configured)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 1000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` on pieces of at most ``rows`` rows; the worker gives its free memory back at the end of the task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    yield b.slice(at, rows)

        try:
            yield from run(pieces())
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # not glibc: nothing to do
                pass

    return wrapped


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def literal_table(spark: SparkSession, rows: Iterable[dict], ddl: str) -> DataFrame:
    """A small driver-side table as a JVM expression (no Python on the executors)."""
    text = json.dumps(list(rows))
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{ddl}>>")))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def safe_text(column: str | Column = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def skew_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join on ``key`` (null-safe) to one row per key, whatever the skew of ``left``.

    ``right`` has a count of left rows per key in ``weight``. Keys of at least
    ``HOT_SHARE`` of ``total`` rows number at most ``1 / HOT_SHARE``, so they are
    broadcast; the rest meet in a shuffled join with no key above that share.
    """
    least = max(1, int(total * HOT_SHARE))
    cold, hot = right.filter(F.col(weight) < least), right.filter(F.col(weight) >= least)
    rest = [c for c in right.columns if c != key]
    marked = left.alias("l").join(
        F.broadcast(hot.select(F.col(key).alias("_hk"), F.struct(*rest).alias("_hot"))), F.col(f"l.{key}").eqNullSafe(F.col("_hk")), "left"
    )
    # hot rows get a null join key: a left join drops none of them and spreads them by a salt
    marked = marked.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.xxhash64(*[f"l.{c}" for c in left.columns]))).withColumn(
        "_ck", F.when(F.col("_hot").isNull(), F.xxhash64(F.lit(1), F.coalesce(F.col(f"l.{key}").cast("string"), F.lit("\x00null")))).otherwise(F.col("_salt"))
    )
    cold = cold.select(
        F.xxhash64(F.lit(1), F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))).alias("_rk"), F.col(key).alias("_rkey"), F.struct(*rest).alias("_cold")
    )
    joined = marked.join(cold, (F.col("_ck") == F.col("_rk")) & F.col(f"l.{key}").eqNullSafe(F.col("_rkey")) & F.col("_hot").isNull(), "left")
    return joined.select(*[F.col(f"l.{c}") for c in left.columns], *[F.coalesce(F.col("_hot"), F.col("_cold"))[c].alias(c) for c in rest])
