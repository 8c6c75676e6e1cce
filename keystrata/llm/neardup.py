"""Near-duplicates at Jaccard 0.8 or more of 5-word shingles: BK-trees of SimHashes first, then an exact prefix filter.

Words are runs between ASCII whitespace, ASCII-lower-cased; a text with fewer
than five words is one shingle. Texts with the same words are merged first, so
a group of copies, whatever its size, is one entry.

A 64-bit SimHash can't see all of Jaccard 0.8 within a radius that a tree can
search: such pairs lie 4 to 16 bits apart. So links come in two rounds.

1. Cheap links: the BK-tree forest of the SimHashes (radius 3), and of each list
   of texts with a common prefix shingle each text with the one before it. They
   join most groups, and there are never more than entries of the lists.
2. What is left: all pairs of a list whose texts are still in different
   components. Copies of one another are no longer among them.

The lists are exact: all shingles have one order, and two sets of n and m
shingles with Jaccard at least 0.8 share at least 0.8 n and 0.8 m of them, so
they share one among the first ``n - ceil(0.8 n) + 1`` of each. Only these leave
their task. A pair must also be within the size ratio and have enough shingles
left; then it must pass its parity sketches (the parities of the shingles by
hash bucket: two sets differ in at least as many shingles as parities, so no
similar pair fails); then its texts are compared exactly. Links are neither
missed nor wrong; components are joined on the cluster.

Shingles that are frequent in a bounded sample come last in the order. That only
saves candidates; any order finds the same links. A list longer than ``TILE`` is
cut into tiles, so no task holds more than two tiles of it.

Edge cases: null and wordless texts are copies of each other and of nothing
else; a null doc_id stays only where its component has no other; equal rows
leave one; an empty table gives an empty result; other columns, whatever their
names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import cut, lean, unused
from .components import connected_components
from .decontam import _WordHashes, shingle_hashes, shingles

NUM, DEN = 4, 5  # the least similarity, as a fraction
SAMPLE, LEAST_COUNT, MOST_FREQUENT = 10_000, 3, 100_000
TILE = 2048
#: Key tables of up to this many rows (16 bytes each) are broadcast; larger ones are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: List entries that one task sorts; there are never more tasks than the session's shuffle partitions.
SORTED_AT_ONCE = 400_000


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return DEN * both >= NUM * (len(a) + len(b) - both)


def prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set that no similar set can do without, and the size of the set."""
    own = np.unique(hashes)
    n = len(own)
    rank = np.zeros(n, dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        rank = np.where(frequent[at] == own, counts[at], 0)
    return own[np.lexsort((own, rank))][: n + -NUM * n // DEN + 1], n


def sketch(own: np.ndarray) -> bytes:
    """Parities of the numbers of shingles by hash bucket; at least four buckets a shingle, a power of two of them."""
    bits = max(64, 1 << (4 * len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(data: bytes, size: int) -> np.ndarray:
    """The sketch with fewer buckets."""
    return np.bitwise_xor.reduce(np.frombuffer(data, dtype=np.uint8).reshape(-1, size), axis=0)


def may_be_similar(a: bytes, b: bytes, n: int, m: int) -> bool:
    """False only for sets of n and m shingles whose sketches differ too much for the least similarity."""
    size = min(len(a), len(b))
    return (NUM + DEN) * int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum()) <= (DEN - NUM) * (n + m)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << simhash.ONES[ones * 2 > len(hashes)]).sum(dtype=np.uint64))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHashes()
    for b in batches:
        found = [np.unique(shingle_hashes((t or "").encode("utf-8", "surrogatepass").lower().split(), known)) for t in b.column("text").to_pylist()]
        tokens, n = np.unique(np.concatenate([*found, np.zeros(0, dtype=np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "c"])


def frequent_shingles(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found often in about SAMPLE texts, in order, and their counts."""
    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(max(1, total // SAMPLE))) == 0).distinct()
    counted = sample.mapInArrow(lean(_counts), "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).filter(F.col("c") >= LEAST_COUNT)
    found = counted.orderBy(F.desc("c"), "token").limit(MOST_FREQUENT).toArrow()
    tokens = found["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["c"].to_numpy()[order]


def _describe(known_frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (frequent, counts) = _WordHashes(), known_frequent.value
        for b in batches:
            s, n, tokens, prints, sketches = [], [], [], [], []
            for t in b.column("text").to_pylist():
                words = (t or "").encode("utf-8", "surrogatepass").lower().split()
                hashes = shingle_hashes(words, known)
                first, size = prefix(hashes, frequent, counts)
                s.append(xxhash.xxh64_intdigest(b" ".join(words)))
                n.append(size)
                tokens.append(first if size else np.zeros(0, dtype=np.uint64))
                prints.append(majority(hashes))
                sketches.append(sketch(np.unique(hashes)) if size else b"")
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*tokens, np.zeros(0, dtype=np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), signed(s), pa.array(n, pa.int32()), lists, signed(prints), pa.array(sketches, pa.binary())], ["doc_id", "h", "s", "n", "tokens", "fp", "sketch"]
            )

    return run


def fits(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """May sets of these sizes be similar, if their first common shingle has these positions?"""
    left = np.minimum(na - pa_, nb - pb)
    return (NUM * np.maximum(na, nb) <= DEN * np.minimum(na, nb)) & (left * (NUM + DEN) >= NUM * (na + nb))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by token, n and s those whose token has another text, each with the text before it if they may be similar."""
    names = ("token", "s", "n", "pos")
    held, matched = None, False  # the last row, and whether the one before it has its token

    def one(row: list, before: int | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.int32()), pa.array([row[3]], pa.int32()), pa.array([before], pa.int64())], [*names, "before"])

    before_held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(c).to_numpy() for c in names]
        if held is not None:
            rows = [np.concatenate([[h], r]).astype(r.dtype) for h, r in zip(held, rows)]
        new = np.ones(len(rows[0]), dtype=bool)  # a text may be there twice
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        token, s, n, pos = (r[new] for r in rows)
        same = token[1:] == token[:-1]
        ok = same & fits(n[:-1].astype(np.int64), pos[:-1], n[1:].astype(np.int64), pos[1:])
        before = pa.array([before_held if held is not None else None, *np.where(ok, s[:-1], 0)], pa.int64(), mask=np.concatenate([[held is None or before_held is None], ~ok]))
        stays = np.concatenate([[matched], same]) | np.concatenate([same, [False]])
        stays[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(s), pa.array(n, pa.int32()), pa.array(pos, pa.int32()), before], [*names, "before"]).filter(pa.array(stays))
        held, before_held = [token[-1], s[-1], n[-1], pos[-1]], before[-1].as_py()
        matched = bool(same[-1]) if len(same) else matched
    if held is not None and matched:
        yield one(held, before_held)


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates between different components, from rows ordered by token and tile."""
    names = ("token", "i", "j", "asked", "s", "n", "pos", "label")
    held: list[list[np.ndarray]] = []

    def pairs(token, i, j, asked, s, n, pos, label) -> Iterator[pa.RecordBatch]:
        at, d, n = np.arange(len(token)), 0, n.astype(np.int64)
        while len(at):
            d += 1
            at = at[at + d < len(token)]
            at = at[(token[at] == token[at + d]) & (i[at] == i[at + d]) & (j[at] == j[at + d])]
            to = at + d
            ok = (label[at] != label[to]) & ((i[at] == j[at]) | (asked[at] != asked[to])) & fits(n[at], pos[at], n[to], pos[to])
            if ok.any():
                a, b = s[at[ok]], s[to[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def start(rows: list[np.ndarray]) -> int:
        """Where the last tile of these rows begins."""
        other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
        return int(other[-1]) + 1 if len(other) else 0

    for b in batches:
        if not b.num_rows:
            continue
        rows = [np.asarray(b.column(c).to_numpy(zero_copy_only=False)) for c in names]
        last = start(rows)
        if last or held and any(held[-1][k][-1] != rows[k][0] for k in range(3)):
            yield from pairs(*(np.concatenate(c) for c in zip(*held, [r[:last] for r in rows])))
            held = []
        held.append([r[last:] for r in rows])
    if held:
        yield from pairs(*(np.concatenate(c) for c in zip(*held)))


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = [may_be_similar(x, y, n, m) for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("ka", "kb", "na", "nb")))]
        yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def own(t: str | None) -> set[bytes]:
        return shingles((t or "").encode("utf-8", "surrogatepass").lower().split())

    text, mine = None, set()
    for b in batches:
        good = []
        for t, u in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist()):
            if t != text:
                text, mine = t, own(t)
            good.append(similar(mine, own(u)))
        yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _row_key(doc_id: Column, h: Column) -> Column:
    return F.xxhash64(doc_id.isNull(), doc_id, h)


def _small(keys: DataFrame) -> DataFrame:
    """``keys``, broadcast if their count allows it."""
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys


def verified(pairs: DataFrame, entries: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose texts are similar; only texts in pairs that pass their sketches are moved."""
    of = lambda x: entries.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    screened = cut(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(lean(_screen, 10_000), "a long, b long"))
    needed = screened.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    keys = cut(entries.join(needed, "s").select("s", _row_key(F.col("first.doc_id"), F.col("first.h")).alias("key")))
    texts = docs.select(_row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), "text").join(_small(keys), "key").select("s", "text").dropDuplicates(["s"])
    ready = screened.join(texts.select(F.col("s").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("s").alias("b"), F.col("text").alias("tb")), "b")
    return ready.select("a", "b", "ta", "tb").mapInArrow(lean(_verify), "a long, b long")


def cheap_pairs(entries: DataFrame, met: DataFrame) -> DataFrame:
    """Pairs of neighbours in the lists and of the BK-trees' forest; as many as list entries at most."""
    prints = entries.filter("n > 0").groupBy("fp").agg(F.min("s").alias("rep"))
    of = lambda x: prints.select(F.col("fp").alias(x), F.col("rep").alias(f"r{x}"))
    near = simhash.links(prints.select("fp"), radius=3).join(of("a"), "a").join(of("b"), "b").select("ra", "rb")
    equal = entries.filter("n > 0").select("fp", "s").join(prints, "fp").select("s", "rep")
    found = met.filter("before is not null").select("s", "before").union(near).union(equal).toDF("x", "y")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()


def other_pairs(met: DataFrame, roots: DataFrame, tile: int = TILE) -> DataFrame:
    """Candidates of the lists between different components."""
    named = met.join(roots, F.col("s") == F.col("node"), "left").select("token", "s", "n", "pos", F.coalesce("root", "s").alias("label"))
    mixed = named.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token", "size")
    cuts = F.ceil(F.col("size") / tile).cast("int")
    own = named.join(mixed, "token").withColumn("cuts", cuts).withColumn("own", F.pmod(F.xxhash64("s"), F.col("cuts")).cast("int"))
    # a tile meets itself (i = j) and every other one
    sent = own.select("token", "s", "n", "pos", "label", "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("k")).select(
        "token", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") > F.col("k")).alias("asked"), "s", "n", "pos", "label"
    )
    return sent.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "asked", "s").mapInArrow(lean(_cross, 10_000), "a long, b long").distinct()


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, h, s, n, tokens, fp, sketch): what the search needs of each row, without its text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, docs.count()))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(lean(_describe(frequent)), f"doc_id {kind}, h long, s long, n int, tokens array<long>, fp long, sketch binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the one with the smallest doc_id stays.

    Of several rows with that doc_id the one with the smallest text hash stays,
    of equal rows one; where every doc_id of a component is null, one row stays.
    """
    prints = cut(described(docs))
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")
    rest = ("n", "tokens", "fp", "sketch")
    entries = cut(prints.groupBy("s").agg(F.min(order).alias("first"), *[F.first(c).alias(c) for c in rest]))
    lists = entries.select("s", "n", F.posexplode("tokens").alias("pos", "token")).select("token", "s", "n", "pos")
    size = entries.agg(F.sum(F.size("tokens"))).first()[0] or 0
    tasks = min(size // SORTED_AT_ONCE + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = cut(lists.repartition(tasks, "token").sortWithinPartitions("token", "n", "s").mapInArrow(lean(_met, 10_000), "token long, s long, n int, pos int, before long"))
    slim = entries.select("s", "first", "n", "sketch")
    tried = cut(cheap_pairs(entries.select("s", "n", "fp"), met))
    links = cut(verified(tried, slim, docs))
    roots = cut(connected_components(links))
    more = cut(other_pairs(met, roots).join(tried, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        roots = connected_components(links.union(verified(more, slim, docs)))
    rooted = entries.select("s", "first").join(roots, F.col("s") == F.col("node"), "left").select("first", F.coalesce("root", "s").alias("root"))
    keep = rooted.groupBy("root").agg(F.min("first").alias("first")).select(_row_key(F.col("first.doc_id"), F.col("first.h")).alias("key"))
    return _only(docs, prints, cut(keep))


def _only(docs: DataFrame, prints: DataFrame, keep: DataFrame) -> DataFrame:
    """One row for each key of ``keep``; keys not in it, and those of equal rows, are the few to look for."""
    counted = prints.groupBy(_row_key(F.col("doc_id"), F.col("h")).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    key = unused(docs, "key")
    marked = counted.join(keep.withColumn("stays", F.lit(True)), "key", "left").filter("stays is null or rows > 1").select(F.col("key").alias(key), F.coalesce("stays", F.lit(False)).alias("stays"))
    marked = cut(marked)
    rows = docs.withColumn(key, _row_key(F.col("doc_id"), F.xxhash64("text")))
    alone = rows.join(_small(marked.select(key)), key, "left_anti")
    equal = marked.filter("stays").select(key)
    if equal.isEmpty():
        return alone.drop(key)
    return alone.unionByName(rows.join(_small(equal), key, "left_semi").dropDuplicates([key])).drop(key)
