"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Native: DataFrame functions only. A row's place on the ring is a 63-bit hash of
(doc_id, size, crc32 of the text). Each shard has ``vnodes`` points on the ring
and a capacity; a row goes to the shard of the next point clockwise and, where
that shard is full, on to the next shard clockwise that is not. Capacities are
``n // shards``, one more for the first ``n % shards``: they sum up to the row
count, so row counts are at most one apart (law ``rows``) and every row finds
a place within one turn.

The ring is cut into units (between virtual nodes and fixed cell borders), in
which all rows see the same shards in the same order. Only the row count per
unit goes to the driver; the walk over full shards runs on those counts and
tells which ranks of each unit go to which shard, with their first slot there.
Cells grow in number with the rows, so a unit stays near ``UNIT_ROWS`` rows.

Edge cases: a null text has size 1 and the crc of no bytes (0); a null doc_id
is hashed as such; equal rows count as one key with a multiplicity and are
spread over consecutive ranks (equal texts may part); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, literal_table

RING_BITS = 63
UNIT_ROWS = 1 << 20
LEAST_CELL_BITS = 12


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted (position, shard) of all virtual nodes."""
    return sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") >> 1, s) for s in range(shards) for v in range(vnodes))


def preference(points: list[tuple[int, int]], at: int, shards: int) -> list[int]:
    """The shards in the order in which they are met clockwise from point number ``at``."""
    seen: list[int] = []
    for k in range(len(points)):
        s = points[(at + k) % len(points)][1]
        if s not in seen:
            seen.append(s)
            if len(seen) == shards:
                break
    return seen


def cut_ring(points: list[tuple[int, int]], cell_bits: int) -> tuple[list[dict], list[int]]:
    """Cells with the virtual nodes inside; per unit in ring order, the number of its next point clockwise."""
    places = [p for p, _ in points]
    shift, cells, owner = RING_BITS - cell_bits, [], []
    for c in range(1 << cell_bits):
        low = bisect_left(places, c << shift)
        high = bisect_left(places, (c + 1) << shift)
        cells.append({"cell": c, "first": len(owner), "inner": places[low:high]})
        owner += [k % len(points) for k in range(low, high + 1)]
    return cells, owner


def bounded_walk(counts: dict[int, int], owner: list[int], points: list[tuple[int, int]], shards: int) -> list[dict]:
    """Give each unit's ranks to shards: in rounds, what found no room asks the next shard clockwise.

    Units ask in ring order, so a full shard turns away those furthest round.
    Returns rows of unit and segments (upto rank, shard, first slot).
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot = [0] * shards
    wants = {u: preference(points, owner[u], shards) for u in counts}
    left, given = dict(counts), {u: [] for u in counts}
    for turn in range(shards):
        for u in sorted(left):
            s = wants[u][turn]
            if n := min(left[u], room[s]):
                given[u].append((n, s, slot[s]))
                room[s] -= n
                slot[s] += n
                left[u] -= n
        left = {u: n for u, n in left.items() if n}
    rows = []
    for u, parts in given.items():
        upto, segments = 0, []
        for n, s, first in parts:
            segments.append({"start": upto, "upto": upto + n, "shard": s, "slot": first})
            upto += n
        rows.append({"unit": u, "segments": segments})
    return rows


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, copies): equal rows are merged before any shuffle."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return (
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def shard_documents(docs: DataFrame, shards: int = 8, vnodes: int = 256) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot), one for each row of ``docs``."""
    spark = docs.sparkSession
    keys = cut(digest(docs))
    total = keys.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    bits = max(LEAST_CELL_BITS, (total // UNIT_ROWS).bit_length())
    points = ring_points(shards, vnodes)
    cells, owner = cut_ring(points, bits)
    ring = literal_table(spark, cells, "cell long, first long, inner array<long>")
    placed = (
        keys.withColumn("pos", F.shiftrightunsigned(F.xxhash64("doc_id", "size", "text_crc32"), 1))
        .withColumn("cell", F.shiftrightunsigned("pos", RING_BITS - bits))
        .join(F.broadcast(ring), "cell")  # 2^bits rows: one for each UNIT_ROWS rows of input, 4096 at least
        .withColumn("unit", F.col("first") + F.size(F.filter("inner", lambda p: p < F.col("pos"))))
        .drop("cell", "first", "inner")
    )
    counts = {r.unit: r.n for r in placed.groupBy("unit").agg(F.sum("copies").alias("n")).collect()}  # as many rows as units
    plan = literal_table(
        spark, bounded_walk(counts, owner, points, shards), "unit long, segments array<struct<start: long, upto: long, shard: int, slot: long>>"
    )
    upto = F.sum("copies").over(Window.partitionBy("unit").orderBy("pos", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0))
    return (
        placed.withColumn("upto", upto)
        .select("doc_id", "size", "text_crc32", "unit", F.explode(F.sequence(F.col("upto") - F.col("copies"), F.col("upto") - 1)).alias("rank"))
        .join(F.broadcast(plan), "unit")
        .withColumn("seg", F.filter("segments", lambda s: (s.start <= F.col("rank")) & (F.col("rank") < s.upto))[0])
        .select("doc_id", "size", "text_crc32", F.col("seg.shard").alias("shard"), (F.col("seg.slot") + F.col("rank") - F.col("seg.start")).alias("slot"))
    )
