"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens. Tasks gather documents into blocks and keep the
pre-tokens' order as positions in the block's list of distinct words; the words
go to the word shuffle, packed by hash bucket, so that each distinct word is in
one task and is encoded there once. Their ids travel back by block, are joined
to the positions and put together. A word that is everywhere, even one with a
third of all pre-tokens, is sent once for each block, so no group grows with
the tokens. Decoding joins ids to the token-byte table, which has one row for
each vocabulary entry and is broadcast (its size is checked).

Edge cases: a null text is the empty text (no tokens); a very long text is a
block of its own; repeated rows stay; other columns are ignored; an empty table
gives an empty result; a null doc_id stays null.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean

BLOCK_CHARS = 7 << 20
MOST_KNOWN = 2_000_000
MOST_VOCABULARY_BYTES = 64 << 20

HEAD = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token, blank, rank per line. Its size is checked, as it is broadcast."""
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def pack(numbers: np.ndarray) -> bytes:
    """uint32 numbers as four byte planes, compressed: small numbers leave the upper planes empty."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the pieces ``order`` of ``flat``; also where each ends."""
    lengths = sizes[order]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(starts[order] - (ends - lengths), lengths)
    return flat[at], ends


def hide_singles(ranks: np.ndarray, often: int) -> np.ndarray:
    """Words that occur once have the ranks from ``often`` on, in order of occurrence: a zero says enough."""
    return np.where(ranks >= often, 0, ranks + 1).astype(np.uint32)


def show_singles(numbers: np.ndarray, words: int) -> np.ndarray:
    single = np.flatnonzero(numbers == 0)
    ranks = numbers.astype(np.int64) - 1
    ranks[single] = np.arange(words - len(single), words)
    return ranks


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(data)


def _rows(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("ids", pa.list_(kind))])


def _blocks(pattern: str, kind: pa.DataType, buckets: int, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        part, made = TaskContext.get().partitionId() << 32, 0
        ids, counts, tokens, number, chars = [], [], [], {}, 0

        def block() -> pa.RecordBatch:
            first = np.array(tokens, dtype=np.uint32)
            often = np.bincount(first, minlength=len(number))
            by_use = np.argsort(-often, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(number), dtype=np.uint32)
            rank[by_use] = np.arange(len(number), dtype=np.uint32)
            words = [w.encode("utf-8", "surrogatepass") for w in number]
            words = [words[k] for k in by_use.tolist()]
            where = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % buckets
            rows = [(part | made, HEAD, pack(hide_singles(rank[first], int((often > 1).sum()))), pack(np.array(counts, dtype=np.uint32)), b"", ids)]
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(buckets + 1))
            for k in range(buckets):
                ranks = order[edges[k] : edges[k + 1]]
                if len(ranks):
                    some = [words[r] for r in ranks.tolist()]
                    sizes = np.fromiter(map(len, some), dtype=np.uint32, count=len(some))
                    rows.append((part | made, k, pack(np.diff(ranks, prepend=0).astype(np.uint32)), pack(sizes), squeeze(b"".join(some)), None))
            schema = _rows(kind)
            return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = find(t or "")
                ids.append(i)
                counts.append(len(found))
                tokens += [number.setdefault(w, len(number)) for w in found]
                chars += len(t or "") + 100
                if chars >= block_chars:
                    out = block()
                    made += 1
                    ids, counts, tokens, number, chars = [], [], [], {}, 0  # freed before the rows are sent
                    yield out
        if ids:
            yield block()

    return run


def _encode_words(ranks, pattern: str):
    """Words of each row to their ids; a word is in one bucket, so in one task, and is encoded there once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})._core_bpe.encode_single_piece
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            sizes, codes = [], []
            for bucket, b, c in zip(*(batch.column(n).to_pylist() for n in ("bucket", "b", "c"))):
                if bucket == HEAD:
                    sizes.append(b)
                    codes.append(c)
                    continue
                if len(known) > MOST_KNOWN:  # bounds the memory; a word met again is encoded again
                    known.clear()
                data, at, flat, lengths = zstandard.ZstdDecompressor().decompress(c), 0, [], []
                for n in unpack(b).tolist():
                    w = data[at : at + n]
                    at += n
                    code = known.get(w)
                    if code is None:
                        code = known[w] = encode(w)
                    flat += code
                    lengths.append(len(code))
                sizes.append(pack(np.array(lengths, dtype=np.uint32)))
                codes.append(pack(np.array(flat, dtype=np.uint32)))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.binary()) if n == "b" else pa.array(codes, pa.binary()) if n == "c" else batch.column(n) for n in names], names)

    return run


def _assemble(kind: pa.DataType):
    schema = pa.schema([("doc_id", kind), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, found = None, []

        def docs() -> Iterator[pa.RecordBatch]:
            counts, ids = unpack(head[1]), head[2]
            ranks = np.concatenate([np.cumsum(unpack(a), dtype=np.int64) for a, _, _ in found]) if found else np.zeros(0, dtype=np.int64)
            order = show_singles(unpack(head[0]), len(ranks))
            sizes = np.concatenate([unpack(b) for _, b, _ in found]).astype(np.int64) if found else ranks
            flat = np.concatenate([unpack(c) for _, _, c in found]) if found else np.zeros(0, dtype="<u4")
            by_rank, by_size = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
            by_rank[ranks], by_size[ranks] = np.cumsum(sizes) - sizes, sizes
            token_ends = np.cumsum(counts, dtype=np.int64)
            for at in range(0, len(ids), 200):
                low = int(token_ends[at - 1]) if at else 0
                some = token_ends[at : at + 200]
                data, ends = gather(flat, by_rank, by_size, order[low : int(some[-1])])
                last = np.concatenate([[0], ends])[some - low].tolist()
                spans = list(zip([0, *last[:-1]], last))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 200], kind), pa.array([z - a for a, z in spans], pa.int64()), pa.array([data[a:z].tobytes() for a, z in spans], pa.binary())], schema=schema)

        for batch in batches:
            for k, (bucket, a, b, c) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("bucket", "a", "b", "c")))):
                if bucket == HEAD:
                    if head is not None:
                        yield from docs()
                    head, found = (a, b, batch.column("ids")[k].as_py()), []
                else:
                    found.append((a, b, c))
        if head is not None:
            yield from docs()

    return run


def bucket_count(docs: DataFrame) -> int:
    """One word bucket for each 8 MB of estimated input, 16 at least.

    Beyond 4096 (32 GB) they grow with the fourth root of the input, so that a
    bucket of a block still holds several words: about 30,000 at 100 TB. Their
    tasks stream, so a larger bucket takes longer but no more memory.
    """
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = max(16, size >> 23)
    return wanted if wanted <= 4096 else int(4096 * (wanted / 4096) ** 0.25)


def _coded(docs: DataFrame, known, pattern: str, block_chars: int) -> tuple[DataFrame, pa.DataType, str]:
    """Rows of blocks with coded words, whole and in order; also the type of doc_id."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()
    rows = f"block long, bucket int, a binary, b binary, c binary, ids array<{name}>"
    blocks = docs.select("doc_id", "text").mapInArrow(lean(_blocks(pattern, kind, bucket_count(docs), block_chars)), rows)
    # words meet by bucket; the heads of the blocks travel along, spread by block
    met = blocks.repartition(F.when(F.col("bucket") == HEAD, F.xxhash64("block")).otherwise(F.col("bucket").cast("long")))
    coded = met.mapInArrow(lean(_encode_words(known, pattern), 100), rows)
    return coded.repartition("block").sortWithinPartitions("block", "bucket"), kind, name


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row; ids are little-endian unsigned 32-bit integers."""
    ordered, kind, name = _coded(docs, docs.sparkSession.sparkContext.broadcast(ranks), pattern, block_chars)
    return ordered.mapInArrow(lean(_assemble(kind), 100), f"doc_id {name}, n_tokens long, ids binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ``decode(encode(...))`` by one Python worker a task instead of two; smaller blocks take less memory and more shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(ranks)
    ordered, kind, name = _coded(docs, known, pattern, block_chars)
    assemble, back = _assemble(kind), _decode(known)
    return ordered.mapInArrow(lean(lambda batches: back(assemble(batches)), 100), f"doc_id {name}, n_tokens long, ids binary, decoded binary")


def _decode(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        sizes = np.zeros(max(known.values(), default=-1) + 1, dtype=np.int64)
        by_id = sorted((i, token) for token, i in known.items())
        for i, token in by_id:
            sizes[i] = len(token)
        flat, starts = np.frombuffer(b"".join(t for _, t in by_id), dtype=np.uint8), np.cumsum(sizes) - sizes
        for b in batches:
            out = []
            for data in b.column("ids").to_pylist():
                ids = np.frombuffer(data or b"", dtype="<u4")
                if len(ids) and (ids.max() >= len(sizes) or not sizes[ids].all()):
                    raise ValueError("an id is not in the token-byte table")
                out.append(gather(flat, starts, sizes, ids)[0].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(n) for n in b.schema.names] + [pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with its ``ids`` joined to the token-byte table and put together as ``decoded``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(lean(_decode(encoded.sparkSession.sparkContext.broadcast(ranks))), f"{schema}, decoded binary")
