"""References: name to key, with upserts, compare-and-swap and checked batches.

The pure functions take and return relations. ``RefTable`` keeps them as Parquet
folders, each under a name of its own, on any file system that Spark reaches. A
version is written whole, then published by the exclusive creation of its
pointer, a small file that holds the folder's name; so a reader sees one version,
and of two writers from the same version one gets a conflict and changes nothing.
"""

from __future__ import annotations

import os
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, key string, user string, created_at_ns long"


class NotFound(KeyError):
    pass


class Conflict(RuntimeError):
    pass


def last_wins(updates: DataFrame, order: str = "pos") -> DataFrame:
    """The last record of each name."""
    columns = [c for c in updates.columns if c not in ("name", order)]
    return updates.groupBy("name").agg(F.max_by(F.struct(*columns), order).alias("_u")).select("name", "_u.*")


def upsert(refs: DataFrame, updates: DataFrame) -> DataFrame:
    """``refs`` with the (unique) names of ``updates`` put or replaced."""
    return refs.join(updates.select("name"), "name", "left_anti").unionByName(updates.select(*refs.columns))


def check(refs: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected`` (name, old; null: absent) with ``ok`` and what is there now."""
    now = refs.select("name", F.col("key").alias("now"))
    return expected.join(now, "name", "left").withColumn("ok", F.col("old").eqNullSafe(F.col("now")))


def update_batch(refs: DataFrame, records: DataFrame, withdrawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All checks first: records (name, key, old, ...) and withdrawals (name, old; gone already is fine).

    Returns the references after it and the failed checks; if any failed, the references are as they were.
    """
    bad = check(refs, records.select("name", "old")).filter(~F.col("ok")).select("name", "old", "now")
    gone = check(refs, withdrawn.select("name", "old")).filter(~F.col("ok") & F.col("now").isNotNull()).select("name", "old", "now")
    faults = bad.unionByName(gone)
    good = faults.agg((F.count(F.lit(1)) == 0).alias("_good"))
    after = upsert(refs.join(withdrawn.select("name"), "name", "left_anti"), records.drop("old"))
    flagged = after.withColumn("_when", F.lit(True)).unionByName(refs.withColumn("_when", F.lit(False)))
    return flagged.join(F.broadcast(good), F.col("_when") == F.col("_good"), "left_semi").drop("_when"), faults


class RefTable:
    """References in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        given = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = given.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self._fs.makeQualified(given).toString()
        self._local = self._fs.getUri().getScheme() == "file"
        self._fs.mkdirs(self._at(""))

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        found = (re.fullmatch(r"v(\d+)", s.getPath().getName()) for s in self._fs.listStatus(self._at("")))
        return max((int(m[1]) for m in found if m), default=0)

    def _folder(self, version: int) -> str:
        """The name in a pointer; outside the local file system one may be seen before its content is."""
        for _ in range(100):
            stream = self._fs.open(self._at(f"v{version}"))
            try:
                if name := self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"):
                    return name
            finally:
                stream.close()
            time.sleep(0.1)
        raise RuntimeError(f"version {version} was never finished")

    def _at_version(self, version: int) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{self._folder(version)}") if version else self.spark.createDataFrame([], SCHEMA)

    def all(self) -> DataFrame:
        return self._at_version(self.version())

    def _point(self, version: int, name: str) -> bool:
        """Create the pointer of a version; false if there is one."""
        if self._local:  # a link is made whole or not at all
            pointer, own = (self._fs.makeQualified(self._at(n)).toUri().getPath() for n in (f"v{version}", f".{name}"))
            with open(own, "w") as f:
                f.write(name)
            try:
                os.link(own, pointer)
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
            return True
        try:
            stream = self._fs.create(self._at(f"v{version}"), False)
        except Py4JJavaError as e:
            if self._fs.exists(self._at(f"v{version}")):
                return False
            raise e
        stream.write(bytearray(name.encode()))
        stream.close()
        return True

    def _publish(self, rows: DataFrame, after: int) -> None:
        name = f"rows-{uuid.uuid4().hex}"
        rows.select("name", "key", "user", "created_at_ns").write.parquet(f"{self.path}/{name}")
        if not self._point(after + 1, name):
            self._fs.delete(self._at(name), True)
            raise Conflict("another writer published this version")

    def _row(self, name: str, key: str, user: str, at: int) -> DataFrame:
        return self.spark.createDataFrame([(name, key, user, at)], SCHEMA)

    def _key(self, name: str, version: int) -> str:
        row = self._at_version(version).filter(F.col("name") == name).first()
        if row is None:
            raise NotFound(name)
        return row.key

    def get(self, name: str) -> str:
        return self._key(name, self.version())

    def put(self, name: str, key: str, user: str = "", at: int = 0) -> None:
        v = self.version()
        self._publish(upsert(self._at_version(v), self._row(name, key, user, at)), v)

    put_volatile = put

    def put_batch(self, updates: DataFrame) -> None:
        v = self.version()
        self._publish(upsert(self._at_version(v), last_wins(updates)), v)

    def create(self, name: str, key: str, user: str = "", at: int = 0) -> None:
        v = self.version()
        rows = self._at_version(v)
        if not rows.filter(F.col("name") == name).isEmpty():
            raise Conflict(name)
        self._publish(rows.unionByName(self._row(name, key, user, at)), v)

    def compare_and_swap(self, name: str, old: str, key: str, user: str = "", at: int = 0) -> None:
        v = self.version()
        if self._key(name, v) != old:
            raise Conflict(name)
        self._publish(upsert(self._at_version(v), self._row(name, key, user, at)), v)

    def delete(self, name: str, old: str | None = None) -> None:
        v = self.version()
        now = self._key(name, v)
        if old is not None and now != old:
            raise Conflict(name)
        self._publish(self._at_version(v).filter(F.col("name") != name), v)

    delete_volatile = delete

    def compare_and_delete(self, name: str, old: str) -> None:
        self.delete(name, old)

    def update_batch(self, records: DataFrame, withdrawn: DataFrame) -> int:
        """Checked batch; returns how many rows were withdrawn."""
        v = self.version()
        rows = self._at_version(v)
        after, faults = update_batch(rows, records, withdrawn)
        if (fault := faults.first()) is not None:
            raise Conflict(fault.name)
        removed = rows.join(withdrawn.select("name"), "name", "left_semi").count()
        self._publish(after, v)
        return removed

    def wipe(self) -> None:
        self._publish(self.spark.createDataFrame([], SCHEMA), self.version())
