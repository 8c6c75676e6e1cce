"""SimHash near-duplicates: fingerprints, BK-tree search, components.

Fingerprints come from 3-word shingles of the ASCII-lower-cased text. Equal
fingerprints are merged before any search, so a group of copies, whatever its
size, is one entry. Two fingerprints that differ in at most ``radius`` bits
agree on at least ``keep`` of ``radius + keep`` bit blocks; each choice of
``keep`` blocks names a shard, and entries meet only in shards of two or more.
A shard of up to ``tree_size`` entries is one BK-tree; a larger one is cut into
several, and each tree is met by the entries of the trees after it, so memory
stays bounded and no link is lost. (A tree is built where its entries meet, in a
shuffled group, rather than broadcast: all trees together grow with the corpus.) The search follows only edges whose integer
distance lies within the radius. A shard returns a spanning forest of its links
(never all pairs); components are joined on the cluster.

Edge cases: a null or wordless text has fingerprint zero and links like any
other; a null doc_id stays a row of its own and never names a component unless
nothing else is in it (then null); repeated rows stay repeated; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, lean, skew_join
from .components import connected_components

SEED = 42
UNSIGNED = (1 << 64) - 1
ONES = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, dtype=np.int64)
    n = len(words) - 2
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = words[at : at + (1 << 16) + 2]
        hashes = np.fromiter((digest(join(t), SEED) for t in zip(part, part[1:], part[2:])), dtype=np.uint64, count=min(n - at, 1 << 16))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << ONES[ones * 2 > n]).sum(dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(c) if c != "text" else pa.array(prints.view(np.int64)) for c in b.schema.names], [c if c != "text" else "fp" for c in b.schema.names])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    return docs.select("doc_id", "text").mapInArrow(lean(_fingerprints), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(radius: int, keep: int) -> list[int]:
    """One mask for each choice of ``keep`` of ``radius + keep`` nearly equal bit blocks."""
    n = radius + keep
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(n)]
    return [sum(c) for c in combinations(blocks, keep)]


class BKTree:
    """Fingerprints by Hamming distance: a child's key is its distance to its parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return
            step = self.children[at].get(d)
            if step is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            at = step

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the entries at most ``radius`` away."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for k, child in self.children[at].items():
                if d - radius <= k <= d + radius:
                    stack.append(child)
        return found


class _Forest:
    """Union-find over the values of one shard; ``join`` is true for a link that is new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def shard_links(tree_of: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``tree_of`` and ``queries``, or among ``tree_of`` if there are none."""
    tree, forest, links = BKTree(), _Forest(), []
    for v in tree_of:
        for at in tree.within(v, radius) if not queries else ():
            if forest.join(v, tree.values[at]):
                links.append((v, tree.values[at]))
        tree.add(v)
    for v in queries:
        for at in tree.within(v, radius):
            if forest.join(v, tree.values[at]):
                links.append((v, tree.values[at]))
    return links


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, asks = None, [], []

        def done() -> pa.RecordBatch:
            links = np.array(shard_links(tree, asks, radius), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

        for b in batches:
            for *k, asked, fp in zip(*(b.column(c).to_pylist() for c in ("mask", "part", "i", "j", "asked", "fp"))):
                if k != key:
                    if key is not None:
                        yield done()
                    key, tree, asks = k, [], []
                (asks if asked else tree).append(fp & UNSIGNED)
        if key is not None:
            yield done()

    return run


def links(entries: DataFrame, radius: int = 3, keep: int = 2, tree_size: int = 4096) -> DataFrame:
    """(a, b): links between the distinct ``fp`` of ``entries`` that keep every component whole."""
    masks = block_masks(radius, keep)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    parts = entries.select("fp", F.inline(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part")) for k, m in enumerate(signed)])))
    sizes = parts.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cuts = F.ceil(F.col("n") / tree_size).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    met = parts.join(sizes, ["mask", "part"]).withColumn("cuts", cuts).withColumn("own", own)
    # part `own` is a tree whose entries look for each other once (i = j), and asks every tree before it
    sent = met.select("mask", "part", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("k")).select(
        "mask", "part", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") > F.col("k")).alias("asked"), "fp"
    )
    ordered = sent.repartition("mask", "part", "i", "j").sortWithinPartitions("mask", "part", "i", "j", "asked", "fp")
    return ordered.mapInArrow(lean(_search(radius), 10_000), "a long, b long")


def components(docs: DataFrame, radius: int = 3, keep: int = 2, tree_size: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = cut(fingerprints(docs))
    entries = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    total = prints.count()
    roots = connected_components(links(entries.select("fp"), radius, keep, tree_size))
    rooted = entries.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "n", "component_id")
    return skew_join(prints, named, "fp", "n", total).drop("n")
