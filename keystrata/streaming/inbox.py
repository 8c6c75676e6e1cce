"""The inbox: packs land as files, a stream takes each body in once, bad ones go to quarantine.

Landing is write, then rename to the body's hash, so an identical body is known
at once. The stream reads landed files, verifies every object, appends the new
ones to the object table and records what was accepted per root; its checkpoint
makes restarts go on where they stopped.
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blake3 import digest
from ..functions.records import decode_payload, read_pack, verify_object
from ..session import cut
from ..operators.store import missing

ROWS = "body string, root string, n int, key binary, data binary, error string"


class Inbox:
    """Folders under ``path``: tmp, landed, objects, accepted, failed, checkpoint."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        for d in ("tmp", "landed", "accepted", "failed", "objects"):
            os.makedirs(f"{path}/{d}", exist_ok=True)
        for name in os.listdir(f"{path}/tmp"):  # left by a crash
            os.remove(f"{path}/tmp/{name}")

    def stage(self, root: str, body: bytes) -> tuple[str, str]:
        """(temporary file, body hash) of a pack tagged with its root."""
        tmp = f"{self.path}/tmp/{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            f.write(len(root.encode()).to_bytes(4, "big") + root.encode() + body)
            f.flush()
            os.fsync(f.fileno())
        return tmp, digest(body).hex()

    def commit(self, tmp: str, body_hash: str) -> bool:
        """Land a staged file; false if this body was landed before."""
        try:
            os.link(tmp, f"{self.path}/landed/{body_hash}.pack")
        except FileExistsError:
            return False
        finally:
            os.remove(tmp)
        return True

    def discard(self, tmp: str) -> None:
        os.remove(tmp)

    def _objects(self) -> DataFrame:
        return self.spark.read.schema("key binary, data binary, batch long").parquet(f"{self.path}/objects")

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        rows = cut(batch.mapInPandas(unpack, ROWS))
        bad = rows.filter("error is not null").select("body", "root", "error").distinct()
        good = rows.join(bad.select("body"), "body", "left_anti")
        known = self._objects().filter(F.coalesce("batch", F.lit(-1)) != batch_id)
        fresh = missing(good.filter("key is not null").select("key", "data").dropDuplicates(["key"]), known, "key")
        # a batch that is tried again overwrites its own folder
        fresh.write.mode("overwrite").parquet(f"{self.path}/objects/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{self.path}/failed/batch={batch_id}")
        good.groupBy("body", "root").agg(F.count("key").alias("n")).write.mode("overwrite").parquet(f"{self.path}/accepted/batch={batch_id}")

    def start(self, **trigger):
        """The running query; ``trigger`` as for ``DataStreamWriter.trigger`` (by default: what is there, then stop)."""
        stream = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pack").load(f"{self.path}/landed")
        return stream.writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    def process(self) -> None:
        """Take in all that has landed (the barrier: after it, no landed entry is pending)."""
        self.start().awaitTermination()

    def accepted(self) -> DataFrame:
        return self.spark.read.schema("body string, root string, n long").parquet(f"{self.path}/accepted")

    def failed(self) -> DataFrame:
        return self.spark.read.schema("body string, root string, error string").parquet(f"{self.path}/failed")

    def pending(self, root: str) -> int:
        """Landed entries of a root not yet taken in or refused."""
        landed = self.spark.createDataFrame([(n[:-5],) for n in os.listdir(f"{self.path}/landed")], "body string")
        done = self.accepted().select("body").union(self.failed().select("body"))
        left = [r.body for r in landed.join(done, "body", "left_anti").collect()]
        return sum(self._root(b) == root for b in left)

    def _root(self, body: str) -> str:
        with open(f"{self.path}/landed/{body}.pack", "rb") as f:
            return f.read(int.from_bytes(f.read(4), "big")).decode()


def unpack(batches):
    """Entries to one row for each object, or one row with the entry's fault."""
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            body, content = os.path.basename(path)[:-5], bytes(content)
            n = int.from_bytes(content[:4], "big")
            root, found, fault = content[4 : 4 + n].decode("utf-8", "replace"), [], None
            for r in read_pack(content[4 + n :]):
                fault = r["error"]
                if fault is None:
                    try:
                        data = decode_payload(r["flags"], r["ulen"], r["payload"])
                        fault = verify_object(r["key"], data)
                    except Exception as e:  # any decoder's fault sends the entry to quarantine
                        fault = str(e)
                if fault is not None:
                    break
                found.append((body, root, len(found), r["key"], data, None))
            rows += [(body, root, 0, None, None, fault)] if fault is not None else found or [(body, root, 0, None, None, None)]
        yield pd.DataFrame(rows, columns=["body", "root", "n", "key", "data", "error"])
