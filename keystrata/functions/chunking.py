"""Content-defined chunking: bytes by Hamming distance to a fixed pattern, items by their hash."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blake3 import digest

MIN_SIZE, NORMAL_SIZE, MAX_SIZE = 32 << 10, 512 << 10, 1 << 20
_DISTANCE = np.array([(b ^ 0xAA).bit_count() for b in range(256)], dtype=np.int64)
_NEAR, _FAR = 0x2F, 0x2C
_RUNS = 64


def check_sizes(least: int = 0, normal: int = 0, most: int = 0) -> tuple[int, int, int]:
    """Sizes with zeros replaced by the defaults; raises on bounds, normal first, then least, then most."""
    least, normal, most = least or MIN_SIZE, normal or NORMAL_SIZE, most or MAX_SIZE
    for ok, what in ((64 <= normal <= 1 << 30, "normal size"), (64 <= least <= 1 << 30 and least < normal, "least size"), (64 <= most <= 1 << 30 and most > normal, "most size")):
        if not ok:
            raise ValueError(f"bad {what}")
    return least, normal, most


def cut_point(data: np.ndarray, least: int, normal: int, most: int) -> int:
    """Where the first chunk of ``data`` ends.

    Windows of eight bytes are read in turn. The sliding distance inside a
    window comes from prefix sums; runs of equal windows leave it as it is.
    """
    n = min(len(data), most)
    if len(data) <= least or n < least + 8:
        return min(len(data), n) if len(data) > least else len(data)
    if len(data) < most and n <= normal:
        normal = n
    sums = np.concatenate([[0], np.cumsum(_DISTANCE[data[least:n]])])
    at = lambda i: int(sums[i - least])
    equal, window, dist = 0, least, at(least + 8) - at(least)
    i, stop = least + 8, n - 8
    steps = (stop - i) // 8 + 1 if stop >= i else 0
    if steps <= 0:
        return n
    # the usual case, no two equal windows in a row: all distances at once
    words = data[least : least + 8 * (steps + 1)].view("<u8") if (least % 8 == 0 and data.flags.c_contiguous and data.ctypes.data % 8 == 0) else np.frombuffer(data[least : least + 8 * (steps + 1)].tobytes(), dtype="<u8")
    same = words[1:] == words[:-1]
    end = int(np.flatnonzero(same)[0]) if same.any() else steps
    slide = sums[8 : 8 + 8 * end] - sums[: 8 * end] if end else np.zeros(0, dtype=np.int64)
    where = np.arange(least + 8, least + 8 + 8 * end)
    step_start = least + 8 + (where - least - 8) // 8 * 8
    hit = (slide & np.where(step_start >= normal, _FAR, _NEAR)) == 0
    if hit.any():
        return int(where[np.flatnonzero(hit)[0]])
    # from the first equal pair on, window by window
    i += 8 * end
    window = i - 8
    dist = at(window + 8) - at(window)
    while i <= stop:
        mask = _FAR if i >= normal else _NEAR
        if words[(i - least) // 8] == words[(window - least) // 8]:
            equal += 1
            if equal >= _RUNS:
                return i + 8
            i += 8
            continue
        equal = 0
        for j in range(8):
            if dist & mask == 0:
                return i + j
            dist += int(_DISTANCE[data[i + j]]) - int(_DISTANCE[data[i + j - 8]])
        window = i
        i += 8
    return n


def split_bytes(data: bytes, least: int = 0, normal: int = 0, most: int = 0) -> list[int]:
    """The sizes of the chunks; none for no bytes."""
    sizes = check_sizes(least, normal, most)
    whole, at, out = np.frombuffer(data, dtype=np.uint8), 0, []
    while at < len(whole):
        n = cut_point(whole[at : at + sizes[2]], *sizes)
        out.append(n)
        at += n
    return out


class ItemRuns:
    """Ends runs of items where the low ``bits`` bits of an item's hash are zero, within bounds."""

    def __init__(self, bits: int = 7) -> None:
        self.least, self.most, self.mask = max((1 << bits) // 4, 2), 4 << bits, (1 << bits) - 1

    def ends(self, item: bytes, run: int) -> bool:
        if run >= self.most:
            return True
        return run >= self.least and int.from_bytes(digest(item)[:8], "little") & self.mask == 0


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where they come in fewer partitions than those (one input file, say); else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if rows.rdd.getNumPartitions() < cores else rows


def cut_batches(least: int = 0, normal: int = 0, most: int = 0, block: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (file_id, data) to batches of chunks with little more than ``block`` bytes each, files read in place;
    the worker gives its free memory back at the end of the task."""

    def rows(b: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, bytes]]:
        for i in range(b.num_rows):
            data = b.column(1)[i].as_buffer()
            at = 0
            for k, n in enumerate(split_bytes(data, least, normal, most) if data else ()):
                yield i, k, at, n, data[at : at + n].to_pybytes()
                at += n

    def made(b: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        of, pos, offset, length, chunk = zip(*held)
        columns = [b.column(0).take(pa.array(of)), *(pa.array(c, pa.int64()) for c in (pos, offset, length)), pa.array(chunk, b.column(1).type)]
        return pa.RecordBatch.from_arrays(columns, ["file_id", "pos", "offset", "length", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                held, n = [], 0
                for row in rows(b):
                    held.append(row)
                    n += row[3]
                    if n >= block:
                        yield made(b, held)
                        held, n = [], 0
                if held:
                    yield made(b, held)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # not glibc: nothing to do
                pass

    return run


def chunks(files: DataFrame, least: int = 0, normal: int = 0, most: int = 0) -> DataFrame:
    """(file_id, pos, offset, length, chunk) rows of files (file_id, data): a file is cut inside one task, files in parallel."""
    kind = files.schema["file_id"].dataType.simpleString()
    return spread(files.select("file_id", "data")).mapInArrow(cut_batches(least, normal, most), f"file_id {kind}, pos long, offset long, length long, chunk binary")
