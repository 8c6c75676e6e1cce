"""Benchmark decontamination: size-partitioned MinHash containment, completed and verified exactly.

Items fall into size partitions by the power of two L that bounds their number of
5-word shingles. For each partition in use, a document is covered by windows of
2L shingles, L apart, so any L shingles in a row lie in one window and a short
item is compared with a stretch of its own size however long the document is.
For an item of more than L/2 shingles at containment t the Jaccard similarity to
that window is at least 0.5 t / (2 + 0.5 (1 - t)), which sets the number of hash
functions (one row per band): such an item is missed with a chance below 10^-5.

That leaves items whose shingles are scattered over a document or repeated, and
items of at most ``SHORT`` shingles, which have no partition. So of each item's n
shingles, any n - ceil(t n) + 1 are keys of their own, and every shingle of every
document is asked for: a text with a share t of the item has one of them. With
these the candidates are complete, and the windows are the faster of two ways to
most of them.

Keys of the items make a Bloom filter of a fixed maximal size (the only thing
broadcast), so only window keys that may meet an item leave their task. They are
joined to the items' keys; each candidate pair of a distinct text and an item is
then verified by exact containment over all shingles of the whole text.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.
A text with fewer than five words is one shingle. Edge cases: a null or wordless
text or item matches nothing; equal (doc_id, text) rows give one result row per
item, equal texts under other ids one each; a null doc_id is kept as null;
items repeated under one item_id count by their own text, the best counts;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, lean, skew_join, unused

WORDS = 5
SHARE = 0.8
MISS = 1e-5
SHORT = 4
EXACT = np.uint64(0xA0761D6478BD642F)
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 26
ROWS_AT_ONCE = 1 << 18
#: Hashes of texts to leave out are broadcast up to this number (16 bytes each), beyond it joined by a shuffle.
MOST_BROADCAST = 1_000_000

_CLEAN = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def shingles(words: list[bytes]) -> set[bytes]:
    """The distinct 5-word shingles (fewer words: the whole sequence)."""
    if not words:
        return set()
    if len(words) < WORDS:
        return {b" ".join(words)}
    return {b" ".join(words[k : k + WORDS]) for k in range(len(words) - WORDS + 1)}


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: list[bytes], known: _WordHashes) -> np.ndarray:
    """One 64-bit hash for each shingle, in order."""
    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - WORDS + 1) if len(w) else 0
    h = np.full(n, len(w) if len(w) < WORDS else WORDS, dtype=np.uint64)
    for k in range(min(WORDS, len(w))):
        h = (h ^ w[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mix(h)


def functions_needed(share: float = SHARE, miss: float = MISS) -> int:
    """Hash functions for a chance below ``miss`` to lose an item at ``share`` containment in its window."""
    jaccard = 0.5 * share / (2 + 0.5 * (1 - share))
    return math.ceil(math.log(miss) / math.log(1 - jaccard))


def multipliers(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"f{k}") | 1 for k in range(n)], dtype=np.uint64)


def size_class(n: int) -> int:
    """The power of two that bounds ``n``; 0 for items that have only exact keys."""
    return 0 if n <= SHORT else (n - 1).bit_length()


def exact_keys(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ EXACT)


def window_keys(parts: list[np.ndarray], classes: list[int], factors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the hashes of several texts: (text number, key) arrays of all windows of all size classes."""
    base = 1 << classes[0]
    sizes = np.array([len(p) for p in parts])
    flat = np.concatenate(parts)
    blocks = -(-sizes // base)
    offsets = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(parts)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = offsets[owner] + number * base
    grids = []
    for c in classes:
        step = 1 << (c - classes[0])
        heads = np.flatnonzero(number % step == 0)  # first block of each stretch of L shingles
        text = owner[heads]
        more = np.append(text[1:] == text[:-1], False)  # the next stretch belongs to the same text
        grids.append((c, heads, text, np.flatnonzero(more), np.append(text[1:] != text[:-1], True) & (number[heads] > 0)))
    for f, a in enumerate(factors):
        least = np.minimum.reduceat(flat * a, starts)
        for c, heads, text, more, extra in grids:
            low = np.minimum.reduceat(least, heads)
            low[more] = np.minimum(low[more], low[more + 1])
            # the last stretch alone is inside the window before it, unless it is the only one
            yield text[~extra], mix(low[~extra] ^ np.uint64((c << 32 | f) * 0x9E3779B9 % (1 << 64)))


def item_keys(hashes: np.ndarray, factors: np.ndarray, share: float = SHARE) -> np.ndarray:
    """The keys of one item: as many shingles as leave too few others for a match, and those of its size class."""
    own = np.unique(hashes)
    c = size_class(len(own))
    exact = exact_keys(own[: len(own) - math.ceil(share * len(own)) + 1])
    if not c:
        return exact
    least = np.array([(hashes * a).min() for a in factors], dtype=np.uint64)
    return np.concatenate([exact, mix(least ^ (np.uint64(c << 32) | np.arange(len(factors), dtype=np.uint64)) * np.uint64(0x9E3779B9))])


def _item_rows(factors: np.ndarray, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in batches:
            n, keys = [], []
            for t in b.column("item_text").to_pylist():
                h = shingle_hashes(words_of(t), known)
                n.append(size_class(len(np.unique(h))) if len(h) else None)
                keys.append(item_keys(h, factors, share).view(np.int64) if len(h) else [])
            yield pa.RecordBatch.from_arrays([b.column("item_h"), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["item_h", "class", "keys"])

    return run


def _hits(bloom, bits: int, classes: list[int], factors: np.ndarray):
    def probe(table: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1

    longer = [c for c in classes if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, top = np.frombuffer(bloom.value, dtype=np.uint8), _WordHashes(), np.uint64(bits - 1)

        def all_keys(parts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield np.repeat(np.arange(len(parts)), [len(p) for p in parts]), exact_keys(np.concatenate(parts))
            if longer:
                yield from window_keys(parts, longer, factors)

        def search(parts: list[np.ndarray]) -> dict[int, set[int]]:
            found: dict[int, set[int]] = {}
            for text, keys in all_keys(parts):
                k = np.flatnonzero(probe(table, keys & top))
                k = k[probe(table, (keys[k] >> np.uint64(32)) & top)]
                for t, key in zip(text[k].tolist(), keys[k].view(np.int64).tolist()):
                    found.setdefault(t, set()).add(key)
            return found

        for b in batches:
            texts = b.column("text").to_pylist()
            keys: dict[int, list[int]] = {}
            at, rows, parts, size = 0, [], [], 0
            for k, t in enumerate(texts):
                if len(h := shingle_hashes(words_of(t), known)):
                    rows.append(k)
                    parts.append(h)
                    size += len(h)
                if parts and (size >= ROWS_AT_ONCE or k == len(texts) - 1):
                    keys |= {rows[i]: sorted(s) for i, s in search(parts).items()}
                    rows, parts, size = [], [], 0
            if keys:
                at = pa.array(sorted(keys), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("th").take(at), b.column("text").take(at), pa.array([keys[k] for k in sorted(keys)], pa.list_(pa.int64()))], ["doc_id", "th", "text", "keys"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text, own = None, set()
    for b in batches:
        shared, total = [], []
        for t, i in zip(b.column("text").to_pylist(), b.column("item_text").to_pylist()):
            if t != text:
                text, own = t, shingles(words_of(t))
            item = shingles(words_of(i))
            shared.append(len(item & own))
            total.append(len(item))
        yield pa.RecordBatch.from_arrays([b.column("th"), b.column("item_id"), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], ["th", "item_id", "n_shared", "n_shingles"])


def contaminated_texts(docs: DataFrame, items: DataFrame, share: float = SHARE) -> tuple[DataFrame, DataFrame] | None:
    """Rows (doc_id, th) that may match, and per text hash th the verified items; None if no item has a word."""
    spark = docs.sparkSession
    factors = multipliers(functions_needed(share))
    asked = items.select("item_id", F.col("text").alias("item_text")).withColumn("item_h", F.xxhash64("item_text"))
    per_item = cut(asked.select("item_h", "item_text").distinct().mapInArrow(lean(_item_rows(factors, share)), "item_h long, class int, keys array<long>"))
    classes = sorted(r[0] for r in per_item.select("class").filter("class is not null").distinct().collect())  # at most 32 powers of two
    if not classes:
        return None
    keys = per_item.select("item_h", F.explode("keys").alias("key"))
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 32 * keys.count():
        bits *= 2
    probes = keys.select(F.explode(F.array(F.col("key").bitwiseAND(bits - 1), F.shiftrightunsigned("key", 32).bitwiseAND(bits - 1))).alias("at"))
    words = probes.groupBy(F.shiftright("at", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("v")).toArrow()  # at most bits / 32 rows
    table = np.zeros(bits // 32, dtype="<u4")
    table[words["w"].to_numpy()] = words["v"].to_numpy().astype("<u4")
    kind = docs.schema["doc_id"].dataType.simpleString()
    hits = cut(
        docs.select("doc_id", F.xxhash64("text").alias("th"), "text").filter("text is not null")
        .mapInArrow(lean(_hits(spark.sparkContext.broadcast(table.tobytes()), bits, classes, factors)), f"doc_id {kind}, th long, text string, keys array<long>")
    )
    texts = hits.dropDuplicates(["th"])
    pairs = texts.select("th", F.explode("keys").alias("key")).join(keys, "key").select("th", "item_h").distinct()
    ready = pairs.join(asked, "item_h").join(texts.select("th", "text"), "th").select("th", "text", "item_id", "item_text")
    kind = items.schema["item_id"].dataType.simpleString()
    verified = ready.mapInArrow(lean(_verify), f"th long, item_id {kind}, n_shared long, n_shingles long").filter(F.col("n_shared") >= share * F.col("n_shingles"))
    best = verified.groupBy("th", "item_id").agg(F.max_by(F.struct("n_shared", "n_shingles"), F.struct(F.col("n_shared") / F.col("n_shingles"), "n_shingles")).alias("m"))
    return hits.select("doc_id", "th").distinct(), best.select("th", "item_id", "m.*")


def contamination(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) for each document text that holds an item."""
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id"))]
    found = contaminated_texts(docs, items, share)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shared long, n_shingles long, containment double")
    rows, matches = found
    rows = cut(rows)
    per_text = matches.groupBy("th").agg(F.collect_list(F.struct("item_id", "n_shared", "n_shingles")).alias("items"))
    weighted = rows.groupBy("th").agg(F.count(F.lit(1)).alias("n")).join(per_text, "th")
    joined = skew_join(rows, weighted, "th", "n", rows.count()).filter("items is not null")
    return joined.select("doc_id", F.inline("items")).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    found = contaminated_texts(docs, items, share)
    if found is None:
        return docs
    th = unused(docs, "th")
    bad = cut(found[1].select(F.col("th").alias(th)).distinct())
    bad = F.broadcast(bad) if bad.count() <= MOST_BROADCAST else bad
    return docs.withColumn(th, F.xxhash64("text")).join(bad, th, "left_anti").drop(th)


ORACLE = """
with w as (select doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {docs}),
v as (select item_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {items}),
d as (select distinct doc_id, text, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] end) as s from w where len(w) > 0),
q as (select distinct item_id, text, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] end) as s from v where len(w) > 0),
n as (select item_id, text, count(*) as n_shingles from q group by all),
m as (select d.doc_id, d.text as dt, q.item_id, q.text as qt, count(*) as n_shared from d join q using (s) group by all),
r as (select doc_id, dt, m.item_id, n_shared, n_shingles, row_number() over (partition by doc_id, dt, m.item_id order by n_shared / n_shingles desc, n_shingles desc) as k
      from m join n on m.item_id = n.item_id and m.qt = n.text where n_shared >= 0.8 * n_shingles)
select doc_id, item_id, n_shared::bigint as n_shared, n_shingles::bigint as n_shingles, (n_shared / n_shingles)::double as containment from r where k = 1
"""
