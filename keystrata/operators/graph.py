"""Reachability over edges(parent, child, leaf): frontier rounds, cut by checkpoints.

``leaf`` says that the child has no edges of its own; edges without that column may lead anywhere. No walk goes on from
a leaf, so edges to leaves are used once, after a walk down or before a walk up, and never kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import cut


def closure(edges: DataFrame, roots: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(key, depth): everything reachable from ``roots`` (key), each once, with its least depth.

    Each round expands only what was new in the round before. A deep chain
    (rounds beyond ``most_rounds``) is finished by pointer doubling.
    """
    inner, last = _split(edges)
    parts = _rounds(inner, roots, None, most_rounds)
    return _union([p.rows for p in (parts if last is None else _to_leaves(last, parts))])


def closure_up(edges: DataFrame, keys: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(key, depth): ``keys`` and everything that reaches them, each once, with its least distance."""
    inner, last = _split(edges)
    return _union([p.rows for p in _rounds(_turned(inner), keys, None if last is None else _turned(last), most_rounds)])


def _split(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges between inner keys, and those to leaves."""
    if "leaf" not in edges.columns:
        return edges.select("parent", "child"), None
    leaf = F.coalesce("leaf", F.lit(False))
    return edges.filter(~leaf).select("parent", "child"), edges.filter(leaf).select("parent", "child")


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))


def by_parent(edges: DataFrame) -> DataFrame:
    """(parent, child) shuffled and sorted by parent once and kept on the executors' disks, so that no round shuffles or
    sorts an edge again; lost parts are made anew from ``edges``. Repeated edges stay, as rounds merge what they find."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.select("parent", "child").repartition(n, "parent").sortWithinPartitions("parent").persist(StorageLevel.DISK_ONLY)


@dataclass(frozen=True)
class _Found:
    """Rows (key, depth), their number and size, and bounds of their keys: strings as bytes, None if there is none or
    (``ordered`` unset) their order is not known. Strings are kept as ``words`` (see ``_packed``), ``rows`` are made of them."""

    rows: DataFrame
    n: int
    size: int
    ordered: bool
    least: Any = None
    most: Any = None
    words: DataFrame | None = None

    def meets(self, other: _Found) -> bool:
        """May both have a key in common? (null joins nothing)"""
        if not (self.ordered and other.ordered):
            return True
        return None not in (self.least, other.least) and self.least <= other.most and other.least <= self.most

    def prefixes(self) -> set[str | None]:
        """What stands before the numbers that its least and greatest key end in, None if one of them ends in none."""
        ends = [_NUMBERED.fullmatch(x) if isinstance(x, (bytes, bytearray)) else None for x in (self.least, self.most)]
        return {None if x is None else bytes(x[1] or b"").decode() for x in ends}


_NUMBERED = re.compile(rb"([ -~]*[ -/:-~])?(0|[1-9][0-9]{0,17})")

#: Types whose values order in Python as in Spark (a string by its bytes, valid UTF-8 or not).
_ORDERED = ("string", "binary", "tinyint", "smallint", "int", "bigint")


def _found(rows: DataFrame) -> _Found:
    kind = dict(rows.dtypes)["key"]
    if kind == "string":
        return _found_words(_packed(rows))
    rows = cut(rows)
    if kind not in _ORDERED:
        return _Found(rows, rows.count(), 1 << 62, False)
    size = F.octet_length("key") if kind == "binary" else F.lit(8)
    n, size, *ends = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size + F.lit(64)), F.lit(0)), F.min("key"), F.max("key")).first()
    return _Found(rows, n, size, True, *ends)


def _packed(rows: DataFrame) -> DataFrame:
    """String keys as (depth, head, at, word), repeats merged: a key that is ``head`` (printable ASCII without digits) and a
    number in plain digits is bit number % 64 of ``word``, ``at`` being number // 64; any other key is a head of its
    own, ``at`` and ``word`` null. Nothing is cast that is no number, as a cast that fails takes many times as long."""
    split = rows.select("depth", "key", F.regexp_extract("key", r"^[ -/:-~]*+(0|[1-9][0-9]{0,17}+)\z", 1).alias("tail"))
    split = split.select("depth", F.expr("if(tail <> '', substring(key, 1, length(key) - length(tail)), key)").alias("head"), F.expr("if(tail <> '', cast(tail as bigint), null)").alias("n"))
    words = split.select("depth", "head", F.shiftright("n", 6).alias("at"), F.expr("shiftleft(1L, cast(n & 63 as int))").alias("word"))
    return words.groupBy("depth", "head", "at").agg(F.bit_or("word").alias("word"))


def _found_words(words: DataFrame) -> _Found:
    words = cut(words)
    n = F.when(F.col("at").isNull(), 1).otherwise(F.bit_count("word")).cast("long")
    ends = words.select("head", "at", n.alias("n"), F.expr("cast(at * 64 + length(bin(word)) - length(rtrim('0', bin(word))) as string)").alias("lo"), F.expr("cast(at * 64 + length(bin(word)) - 1 as string)").alias("hi"))
    # numbers of equal length are ordered as their digits
    least, most = (F.when(F.col("at").isNull(), F.col("head")).when(F.length("lo") == F.length("hi"), F.concat("head", x)).otherwise(F.concat("head", F.lit(y))) for x, y in (("lo", "0"), ("hi", "9" * 18)))
    size = F.col("n") * (F.coalesce(F.octet_length("head"), F.lit(0)) + F.coalesce(F.length("hi"), F.lit(0)) + 64)
    n, size, rows, *ends = ends.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1)), F.min(least).cast("binary"), F.max(most).cast("binary")).first()
    return _Found(_unpacked(words, n, rows), n, size, True, *ends, words)


def _unpacked(words: DataFrame, n: int, rows: int) -> DataFrame:
    """(key, depth) of so many ``rows`` of words that hold ``n`` keys; a task makes about 500,000 of them, if they are dense."""
    tasks = min(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 500_000))
    if n > 8 * rows and words.rdd.getNumPartitions() < tasks:
        words = words.repartition(tasks)
    bits = words.select("*", F.explode(F.expr("sequence(0, 63)")).alias("bit")).filter("if(at is null, bit = 0, shiftright(word, bit) & 1 = 1)")
    return bits.select(F.expr("if(at is null, head, concat(head, cast(at * 64 + bit as string)))").alias("key"), "depth")


def _not_in(found: DataFrame, parts: list[_Found]) -> DataFrame:
    """``found`` (words) without the keys of ``parts``."""
    known = _union([p.words for p in parts]).groupBy(F.col("head").alias("head_"), F.col("at").alias("at_")).agg(F.bit_or("word").alias("known"), F.lit(True).alias("is"))
    both = found.join(known, F.col("head").eqNullSafe(F.col("head_")) & F.col("at").eqNullSafe(F.col("at_")), "left")
    left = both.withColumn("word", F.expr("word & ~coalesce(known, 0L)")).filter("if(at is null, is is null, word <> 0)")
    return left.select("depth", "head", "at", "word")


def _first_of(words: DataFrame) -> DataFrame:
    """``words`` of which each key is kept at its least depth only."""
    before = Window.partitionBy("head", "at").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    left = words.withColumns({"known": F.bit_or("word").over(before), "is": F.max(F.lit(True)).over(before)}).withColumn("word", F.expr("word & ~coalesce(known, 0L)"))
    return left.filter("if(at is null, is is null, word <> 0)").select("depth", "head", "at", "word")


def _leave(parts: list[_Found], edges: DataFrame, broadcast: int = 8 << 20, hashed: int = 64 << 20, bitmaps: int = 32 << 20) -> DataFrame:
    """(parent, depth, child): edges, read once, that leave any of ``parts``. These are broadcast up to so many bytes, or
    as bitmaps of at most so many where their keys are numbered; else they become hash tables up to so many in a partition."""
    leaving = _leave_unshuffled(parts, edges, broadcast, bitmaps)
    if leaving is not None:
        return leaving
    rows, size = _union([p.rows for p in parts]).select(F.col("key").alias("parent"), "depth"), sum(p.size for p in parts)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.hint("shuffle_hash") if size <= hashed * n else rows).join(edges.repartition(n, "parent"), "parent")


def _leave_unshuffled(parts: list[_Found], edges: DataFrame, broadcast: int = 8 << 20, bitmaps: int = 32 << 20) -> DataFrame | None:
    """As ``_leave``, None if the edges would have to be shuffled."""
    if sum(p.size for p in parts) <= broadcast:
        return F.broadcast(_union([p.rows for p in parts]).select(F.col("key").alias("parent"), "depth")).join(edges, "parent")
    if any(p.words is None for p in parts) or dict(edges.dtypes)["parent"] != "string":
        return None
    words = _union([p.words for p in parts]).filter("head is not null")
    heads = words.select(F.when(F.col("at").isNotNull(), F.col("head")).alias("head")).distinct().limit(17).collect()
    heads = {x["head"] for x in heads}
    if None in heads or len(heads) > 16 or any(x[-1:].isdigit() for x in heads):
        return None
    return _leave_words(words, edges, heads, bitmaps)


def _longest_first(prefixes: set[str]) -> list[str]:
    return sorted(prefixes, key=lambda x: (-len(x), x))


def _numbered(rows: DataFrame, prefixes: set[str]) -> DataFrame:
    """``rows`` (parent, ...) with ``k``, ``tail``, ``n``, ``plain``: whether parent is the k-th prefix and n in plain decimal
    digits. Generators keep the optimizer from copying the parsing into each place that uses it."""
    known = _longest_first(prefixes)
    begins = [F.col("parent").startswith(p) for p in known]
    k, skip = (F.coalesce(*[F.when(b, x) for b, x in zip(begins, xs)]) for xs in (range(len(known)), [len(p) + 1 for p in known]))
    tails = rows.select("*", F.inline(F.array(F.struct(k.alias("k"), F.substring("parent", skip, F.lit(19)).alias("tail"), (F.length("parent") < skip + 19).alias("whole")))))
    return tails.select("*", F.explode(F.array(F.col("tail").try_cast("long"))).alias("n")).withColumn("plain", F.expr("whole and n >= 0 and cast(n as string) = tail"))


def _leave_numbered(rows: DataFrame, edges: DataFrame, prefixes: set[str], most: int) -> DataFrame | None:
    """As ``_leave``, but no edge is shuffled: the keys of ``rows`` are broadcast as bitmaps, one bit a number, exact. None
    if any key is not one of at most 16 ``prefixes`` and a number, or the bitmaps would take over ``most`` bytes."""
    keys = _numbered(rows.filter("parent is not null"), prefixes).selectExpr("depth", "n", "if(plain, shiftright(n, 6) * 16 + k, null) as at")
    words = cut(keys.groupBy("depth", "at").agg(F.expr("bit_or(shiftleft(1L, cast(n & 63 as int))) as word")))
    return _leave_lines(words.selectExpr("depth", "shiftright(at, 10) * 16 + (at & 15) as place", "cast(shiftright(at, 4) & 63 as int) as slot", "word"), edges, prefixes, most)


def _leave_words(words: DataFrame, edges: DataFrame, heads: set[str], most: int) -> DataFrame | None:
    """As ``_leave_numbered``, of words (see ``_packed``) all with numbers and one of at most 16 ``heads`` that end in no digit."""
    k = F.coalesce(*[F.when(F.col("head") == x, n) for n, x in enumerate(_longest_first(heads))])
    return _leave_lines(words.select("depth", (F.shiftright("at", 6) * 16 + k).alias("place"), F.expr("cast(at & 63 as int)").alias("slot"), "word"), edges, heads, most)


def _leave_lines(words: DataFrame, edges: DataFrame, prefixes: set[str], most: int) -> DataFrame | None:
    lines = words.groupBy("depth", "place").agg(F.map_from_entries(F.collect_list(F.struct("slot", "word"))).alias("words"))
    n, odd = words.select("depth", "place").distinct().agg(F.count(F.lit(1)), F.count_if(F.col("place").isNull())).first()
    if odd or 600 * n > most:  # a line: 64 words and its place in the table
        return None
    lines = lines.selectExpr("depth", "place", "transform(sequence(0, 63), x -> coalesce(element_at(words, x), 0L)) as words")
    asked = _numbered(edges.select("parent", "child"), prefixes).filter("plain").withColumn("at", F.expr("shiftright(n, 12) * 16 + k"))
    marked = F.expr("shiftright(words[cast(shiftright(n, 6) & 63 as int)], cast(n & 63 as int)) & 1 = 1")
    return asked.join(F.broadcast(lines), (F.col("at") == F.col("place")) & marked).select("parent", "depth", "child")


def _to_leaves(last: DataFrame, parts: list[_Found]) -> list[_Found]:
    """``parts`` and the leaves behind them; keys found on both ways keep their lesser depth."""
    leaves = _leave(parts, last).select(F.col("child").alias("key"), (F.col("depth") + 1).alias("depth"))
    if dict(leaves.dtypes)["key"] == "string" and all(p.words is not None for p in parts):
        found = _found_words(_packed(leaves))
        met = [p for p in parts if p.meets(found)]
        if met or found.words.select("depth").distinct().count() > 1:
            found = _found_words(_first_of(_union([p.words for p in [*met, found]])))
        return [*(p for p in parts if p not in met), found]
    found = _found(leaves.groupBy("key").agg(F.min("depth").alias("depth")))
    met = [p for p in parts if p.meets(found)]
    if met:
        found = _found(_union([p.rows for p in [*met, found]]).groupBy("key").agg(F.min("depth").alias("depth")))
    return [*(p for p in parts if p not in met), found]


def _rounds(edges: DataFrame, roots: DataFrame, first: DataFrame | None, most_rounds: int) -> list[_Found]:
    """Disjoint parts of all that ``edges`` reach from ``roots``, the first step by edges of ``first`` too."""
    read = edges.select("parent", "child").persist(StorageLevel.DISK_ONLY)
    links = by_parent(read)
    try:
        return _walk(read, links, roots, first, most_rounds)
    finally:
        links.unpersist()
        read.unpersist()


def _heads(links: DataFrame) -> list[bytes]:
    """First bytes of the parents: a frontier that lies apart from all of them leads nowhere, and is not shuffled to see it."""
    return [bytes(x.head) for x in links.select(F.substring(F.col("parent").cast("binary"), 1, 1).alias("head")).filter("head is not null").distinct().collect()]


def _walk(read: DataFrame, links: DataFrame, roots: DataFrame, first: DataFrame | None, most_rounds: int, unsorted: int = 6) -> list[_Found]:
    """Keys of a round often lie apart from earlier ones (another kind, a later number). A round then reads only the edges
    between its least and greatest parent, and only earlier rounds whose keys its own may repeat are compared with it.
    So many rounds take the edges as ``read``, if their frontier can be broadcast; the others take sorted ``links``, which are
    made when first used."""
    frontier = _found(roots.select("key").distinct().withColumn("depth", F.lit(0).cast("long")))
    kinds = {dict(roots.dtypes)["key"], *dict(links.dtypes).values()}
    ordered = len(kinds) == 1 and frontier.ordered
    heads = _heads(read) if ordered and kinds == {"string"} else None
    parts, mixed, depth = [frontier], not ordered, 0
    while depth < most_rounds:
        if heads is not None and frontier.least is not None and (depth or first is None) and not any(frontier.least[:1] <= x <= frontier.most[:1] for x in heads):
            return parts
        near = [x.filter(F.col("parent").between(*[F.lit(x).cast(*kinds) for x in (frontier.least, frontier.most)])) if ordered else x for x in (read, links)]
        step = _leave_unshuffled([frontier], near[0]) if depth < unsorted else None
        if step is None:
            step = frontier.rows.select(F.col("key").alias("parent")).join(near[1], "parent")
        step = step.select(F.col("child").alias("key"))
        if depth == 0 and first is not None:
            step = step.unionByName(_leave([frontier], first).select(F.col("child").alias("key")))
        depth += 1
        at, met = F.lit(depth).cast("long").alias("depth"), parts
        words = _packed(step.select("key", at)) if dict(step.dtypes)["key"] == "string" and all(p.words is not None for p in parts) else None
        rows = step.distinct().select("key", at) if words is None else None
        if not mixed:
            frontier = _found(rows) if words is None else _found_words(words)
            rows, words, met = frontier.rows, frontier.words, [p for p in parts if p.meets(frontier)]
            mixed = 2 * sum(p.n for p in met) > sum(p.n for p in parts)  # then later rounds are compared with all at once
        if met:
            frontier = _found(rows.join(_union([p.rows for p in met]).select("key"), "key", "left_anti")) if words is None else _found_words(_not_in(words, met))
        if frontier.n == 0:
            return parts
        parts.append(frontier)
        if len(parts) > 9:  # keep the anti-join's plan short
            parts = [_found(_union([p.rows for p in parts])) if any(p.words is None for p in parts) else _found_words(_union([p.words for p in parts]))]
    # what lies behind the frontier is done; jumps are made of the other edges only, each once
    seen = _union([p.rows for p in parts])
    behind = seen.filter(F.col("depth") < depth).select(F.col("key").alias("parent"))
    rest = links.join(behind, "parent", "left_anti").join(seen.select(F.col("key").alias("child")), "child", "left_anti").select("parent", "child").distinct()
    return [_found(_double(cut(rest), cut(seen)))]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _double(links: DataFrame, seen: DataFrame) -> DataFrame:
    """Reach the rest in log2 rounds: jumps of twice the length each round, every reached key jumping at once."""
    jumps, reached = cut(links.withColumn("far", F.lit(1).cast("long"))), seen
    while True:
        more = reached.select(F.col("key").alias("parent"), "depth").join(jumps, "parent").select(F.col("child").alias("key"), (F.col("depth") + F.col("far")).alias("depth"))
        after = cut(reached.unionByName(more).groupBy("key").agg(F.min("depth").alias("depth")))
        grown = after.count() > reached.count()
        reached = after
        if not grown:
            step = reached.select(F.col("key").alias("parent"), "depth").join(links, "parent").select(F.col("child").alias("key"))
            if step.join(reached, "key", "left_anti").isEmpty():
                return reached
        twice = jumps.alias("a").join(jumps.alias("b"), F.col("a.child") == F.col("b.parent")).select(F.col("a.parent").alias("parent"), F.col("b.child").alias("child"), (F.col("a.far") + F.col("b.far")).alias("far"))
        jumps = cut(twice.groupBy("parent", "child").agg(F.min("far").alias("far")))


def reachable_keys(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return closure(edges, roots).select("key")


def incomplete(edges: DataFrame, roots: DataFrame, objects: DataFrame) -> DataFrame:
    """Reachable keys that the store lacks (empty: complete), nearest first."""
    lacking = cut(closure(edges, roots).join(objects.select("key"), "key", "left_anti"))  # else the sort's sample would join again
    return lacking.orderBy("depth", "key")


def mark_live(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Keys reachable from any reference (name, key)."""
    return reachable_keys(edges, refs.select("key"))


def why(edges: DataFrame, refs: DataFrame, keys: DataFrame) -> DataFrame:
    """(name): references that reach any of ``keys``, sorted; walks edges backwards from the keys."""
    return refs.join(closure_up(edges, keys).select("key"), "key", "left_semi").select("name").distinct().orderBy("name")


def reaches(edges: DataFrame, roots: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``roots`` that reach any of ``keys``."""
    return roots.join(closure_up(edges, keys).select("key"), "key", "left_semi")


def unreachable_from(edges: DataFrame, roots: DataFrame, candidates: DataFrame, order: str = "pos") -> DataFrame:
    """Candidates not reachable from the roots, in their order, repeats kept."""
    return candidates.join(reachable_keys(edges, roots), "key", "left_anti").orderBy(order)


def mark_bitmap(index: DataFrame, live: DataFrame) -> DataFrame:
    """Per segment, marks by position as bitmaps: (seg_id, bucket, marked)."""
    placed = index.join(live.select("key").distinct(), "key", "left_semi")
    return placed.groupBy("seg_id", F.bitmap_bucket_number("off").alias("bucket")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("off"))).alias("marked"))
