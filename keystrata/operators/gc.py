"""Garbage collection: liveness, scores, victims, compaction, one whole cycle."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import decode_payload, parse_record, verify_object
from ..session import cut
from . import graph
from .store import RECORD_HEADER, index_faults

DEFAULT_GRACE_S = 3600
DEFAULT_GARBAGE, TIGHT_GARBAGE, LEAST_FREE = 0.5, 0.1, 0.05


def liveness(index: DataFrame, live: DataFrame) -> DataFrame:
    """Per segment: live and dead keys and bytes (46 + slen each)."""
    marks = live.select("key").distinct().withColumn("_live", F.lit(True))
    rows = index.join(marks, "key", "left").withColumn("_live", F.coalesce("_live", F.lit(False))).withColumn("_bytes", F.col("slen") + RECORD_HEADER)
    return rows.groupBy("seg_id").agg(
        F.count_if("_live").cast("long").alias("live_keys"), F.count_if(~F.col("_live")).cast("long").alias("dead_keys"),
        F.coalesce(F.sum(F.when(F.col("_live"), F.col("_bytes"))), F.lit(0)).cast("long").alias("live_bytes"),
        F.coalesce(F.sum(F.when(~F.col("_live"), F.col("_bytes"))), F.lit(0)).cast("long").alias("dead_bytes"),
        F.max("sealed_at").alias("sealed_at"),
    )


def status(index: DataFrame, live: DataFrame, horizon: Column) -> DataFrame:
    """Per pack and in total (seg_id null): body, keys, garbage fraction; eligible packs were sealed before ``horizon``."""
    per = liveness(index, live).withColumn("eligible", F.col("sealed_at") < horizon)
    total = per.rollup("seg_id").agg(
        F.sum(F.col("live_bytes") + F.col("dead_bytes")).cast("long").alias("body_bytes"), F.sum(F.col("live_keys") + F.col("dead_keys")).cast("long").alias("n_keys"),
        F.sum("live_keys").cast("long").alias("live_keys"), F.sum("dead_bytes").cast("long").alias("dead_bytes"), F.count_if("eligible").cast("long").alias("eligible"),
    )
    return total.withColumn("garbage", F.when(F.col("body_bytes") == 0, 0.0).otherwise(F.col("dead_bytes") / F.col("body_bytes"))).drop("dead_bytes")


def garbage_line(garbage: float, path: str, floor: int = 0) -> float:
    """The ratio from which a pack is worth copying; negative asks for the default, a tighter one when space is short."""
    if garbage >= 0:
        return garbage
    return TIGHT_GARBAGE if free_below(path, floor) else DEFAULT_GARBAGE


def free_below(path: str, least: int) -> bool:
    s = os.statvfs(path)
    return s.f_bavail * s.f_frsize < (least or int(s.f_blocks * s.f_frsize * LEAST_FREE))


def candidates(scores: DataFrame, horizon: Column | None, ratio: float) -> DataFrame:
    """Packs with a dead key and a dead share of at least ``ratio``, sealed before the horizon."""
    total = F.col("live_bytes") + F.col("dead_bytes")
    rows = scores.filter((F.col("dead_keys") > 0) & (F.col("dead_bytes") >= ratio * total))
    return rows if horizon is None else rows.filter(F.col("sealed_at") < horizon)


def select_victims(scores: DataFrame, horizon: Column | None, ratio: float, budget: int | None, skipped: DataFrame | None = None) -> DataFrame:
    """(seg_id, live_bytes, taken): greedy under a copy budget; too large a pack is passed over, later smaller ones still fit.

    Packs skipped last time come last. The order matters, so one task folds the
    sorted packs: one row a pack (400,000 for 100 TB in packs of 256 MiB), read
    as a stream.
    """
    rows = candidates(scores, horizon, ratio)
    if skipped is not None:
        rows = rows.join(skipped.select("seg_id", F.lit(1).alias("again")), "seg_id", "left").withColumn("again", F.coalesce("again", F.lit(0)))
    else:
        rows = rows.withColumn("again", F.lit(0))
    if budget is None:
        return rows.select("seg_id", "live_bytes", F.lit(True).alias("taken"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = budget
        for b in batches:
            taken = []
            for n in b.column("live_bytes").to_pylist():
                taken.append(n <= left)
                left -= n if taken[-1] else 0
            yield pa.RecordBatch.from_arrays([b.column("seg_id"), b.column("live_bytes"), pa.array(taken, pa.bool_())], ["seg_id", "live_bytes", "taken"])

    packs = rows.select("again", F.col("seg_id").cast("long").alias("seg_id"), F.col("live_bytes").cast("long").alias("live_bytes"))
    return packs.repartition(1).sortWithinPartitions("again", "seg_id").mapInArrow(fold, "seg_id long, live_bytes long, taken boolean")


def _needed(index: DataFrame, live: DataFrame, ids: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows outside the segments ``ids``, and the live rows inside whose key has no verifying copy outside; ``_good`` tells which verify."""
    rows = index.withColumn("_good", F.coalesce(good, F.lit(False)))
    stay = rows.join(ids, "seg_id", "left_anti")
    inside = rows.join(ids, "seg_id", "left_semi").join(live.select("key"), "key", "left_semi")
    return stay, inside.join(stay.filter("_good").select("key"), "key", "left_anti")


def left_in_place(index: DataFrame, live: DataFrame, victims: DataFrame, good: Column) -> DataFrame:
    """(seg_id) of the victims that can't go: a live record that has to be copied doesn't verify."""
    return _needed(index, live, victims.filter("taken").select("seg_id"), good)[1].filter("NOT _good").select("seg_id").distinct()


def compact(index: DataFrame, live: DataFrame, victims: DataFrame, new_seg: int, good: Column | None = None) -> DataFrame:
    """The index after compaction: victims go, their live keys without a verifying copy elsewhere move to a new segment, once each.

    ``good`` tells which index rows have a record that verifies (none given: all).
    A victim with a bad record that would have to be copied stays, with all it
    holds, and is no survivor: a good copy in another victim is copied.
    """
    ids = victims.filter("taken").select("seg_id")
    stay, needed = _needed(index, live, ids, F.lit(True) if good is None else good)
    if good is not None:
        kept = left_in_place(index, live, victims, good)
        stay, needed = stay.unionByName(index.withColumn("_good", F.coalesce(good, F.lit(False))).join(ids, "seg_id", "left_semi").join(kept, "seg_id", "left_semi").select(stay.columns)), needed.join(kept, "seg_id", "left_anti")
    fresh = needed.groupBy("key").agg(F.min("slen").alias("slen"), F.max("sealed_at").alias("sealed_at"))
    copied = fresh.select(F.lit(new_seg).cast("long").alias("seg_id"), "key", "slen", "sealed_at")
    return stay.select(F.col("seg_id").cast("long").alias("seg_id"), "key", "slen", "sealed_at").unionByName(copied)


def _faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (whole.slice(at, 100) for whole in batches for at in range(0, whole.num_rows, 100)):
        keys, faults = [], []
        for record in b.column("record").to_pylist():
            key = fault = None
            try:
                found = parse_record(record or b"")
                key = found["key"]
                fault = verify_object(key, decode_payload(found["flags"], found["ulen"], found["payload"]))
            except Exception as e:  # a payload may fail in any of the decoders
                fault = str(e) or type(e).__name__
            keys.append(key)
            faults.append(fault)
        yield pa.RecordBatch.from_arrays([b.column("seg_id"), b.column("off"), pa.array(keys, pa.binary()), pa.array(faults, pa.string())], ["seg_id", "off", "key", "fault"])


def checked_records(records: DataFrame) -> DataFrame:
    """(seg_id, off, key, fault) for every row of ``records`` (seg_id, off, record): fault is null where the record parses, its checksum fits and its payload hashes to its key."""
    return records.select(F.col("seg_id").cast("long"), F.col("off").cast("long"), "record").mapInArrow(_faults, "seg_id long, off long, key binary, fault string")


def scrub(records: DataFrame, index: DataFrame) -> DataFrame:
    """(seg_id, off, key, fault): faulty records of whole segments, and where they and the index (seg_id, key, off) differ."""
    checked = cut(checked_records(records))
    placed = index.select(F.col("seg_id").cast("long"), "key", F.col("off").cast("long"))
    differ = index_faults(placed, checked.filter("key is not null"))
    return checked.filter("fault is not null").unionByName(differ.select("seg_id", "off", "key", "fault"))


@dataclass
class CycleStats:
    marked: int
    packs: int
    reaped: int
    copied_bytes: int
    freed_bytes: int


def cycle(index: DataFrame, edges: DataFrame, refs: DataFrame, horizon: Column | None, ratio: float = DEFAULT_GARBAGE, budget: int | None = None, grey: DataFrame | None = None, new_seg: int = 1 << 40, good: Column | None = None) -> tuple[DataFrame, CycleStats]:
    """Mark, score, pick, compact: the new index and what was done. ``grey`` keys count as live; ``good`` as in ``compact``."""
    live = graph.mark_live(edges, refs)
    if grey is not None:
        live = live.unionByName(grey.select("key")).distinct()
    live = cut(live)
    scores = cut(liveness(index, live))
    chosen = cut(select_victims(scores, horizon, ratio, budget))
    if good is not None:
        chosen = cut(chosen.join(left_in_place(index, live, chosen, good), "seg_id", "left_anti"))
    taken = scores.join(chosen.filter("taken").select("seg_id"), "seg_id", "left_semi")
    n, alive, dead = taken.agg(F.count(F.lit(1)), F.coalesce(F.sum("live_bytes"), F.lit(0)), F.coalesce(F.sum("dead_bytes"), F.lit(0))).first()
    return compact(index, live, chosen, new_seg, good), CycleStats(live.count(), scores.count(), n, alive, dead)
