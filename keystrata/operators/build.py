"""Trees from files: chunks, file index levels, directories; children before parents, one root key.

File levels and directories are built per group in Arrow workers; a driver loop
runs over levels only (logarithmic in the entries) and over directory depths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cbor
from ..functions.blake3 import digests, length_of, make_key, object_key
from ..functions.chunking import ItemRuns, split_bytes
from ..functions.keys import BLOB, DIR_LEAF, DIR_NODE, FILE_NODE, XATTR_SET

OBJECTS = "key binary, type int, data binary"
INLINE_XATTRS = 256
FILES_AT_ONCE = 256


def _index(items: list[tuple[bytes, bytes]], runs: ItemRuns, directory: bool) -> Iterator[tuple[bytes, int, bytes]]:
    """Levels over (separator, child key) until one key is left; a lone child is its own root."""
    while len(items) > 1:
        upper, run = [], []
        for k, (sep, child) in enumerate(items):
            run.append((sep, child))
            if runs.ends(cbor.dump([sep, child]) if directory else child, len(run)) or k == len(items) - 1:
                if directory:
                    data = cbor.encode_dir_node(run)
                    made = (object_key(DIR_NODE, (len(data) + sum(length_of(c) for _, c in run)) % (1 << 64), data), DIR_NODE, data)
                else:
                    data = cbor.encode_file_node([c for _, c in run])
                    made = (object_key(FILE_NODE, sum(length_of(c) for _, c in run) % (1 << 64), data), FILE_NODE, data)
                yield made
                upper.append((run[-1][0], made[0]))
                run = []
        items = upper


def cut_file(data: bytes, sizes: tuple[int, int, int]) -> list[bytes]:
    """The chunks of one file; an empty file is one empty chunk."""
    at, out = 0, []
    for n in split_bytes(data, *sizes) or [0]:
        out.append(data[at : at + n])
        at += n
    return out


def build_files(files: list[bytes], sizes: tuple[int, int, int] = (0, 0, 0), bits: int = 7) -> Iterator[list[tuple[bytes, int, bytes]]]:
    """For each file its objects, the root last; the chunks of all of them are hashed together."""
    cuts = [cut_file(data, sizes) for data in files]
    hashes = iter(digests([c for chunks in cuts for c in chunks]))
    for chunks in cuts:
        out = [(make_key(BLOB, len(c), next(hashes)), BLOB, c) for c in chunks]
        yield out + list(_index([(b"", k) for k, _, _ in out], ItemRuns(bits), False))


def build_file(data: bytes, sizes: tuple[int, int, int] = (0, 0, 0), bits: int = 7) -> list[tuple[bytes, int, bytes]]:
    """The objects of one file, its root last."""
    return next(build_files([data], sizes, bits))


def build_dir(entries: list[dict], bits: int = 7) -> list[tuple[bytes, int, bytes]]:
    """The objects of one directory from its entries in byte order of names, its root last; an empty one is one empty leaf."""
    runs, out, items, run = ItemRuns(bits), [], [], []

    def close() -> None:
        data = cbor.encode_dir_leaf(run)
        below = sum(length_of(e[f]) for e in run for f in ("content_key", "xattrs_key") if e.get(f))
        out.append((object_key(DIR_LEAF, (len(data) + below) % (1 << 64), data), DIR_LEAF, data))
        items.append((run[-1]["name"] if run else b"", out[-1][0]))
        run.clear()

    for e in entries:
        run.append(e)
        if runs.ends(cbor.encode_entry(e), len(run)):
            close()
    if run or not items:
        close()
    return out + list(_index(items, runs, True))


def spill_xattrs(entry: dict, limit: int = INLINE_XATTRS) -> tuple[dict, list[tuple[bytes, int, bytes]]]:
    """Large extended attributes become an object of their own."""
    if not entry.get("xattrs"):
        return entry, []
    data = cbor.dump(entry["xattrs"])
    if len(data) <= limit:
        return entry, []
    key = object_key(XATTR_SET, len(data), data)
    return {**entry, "xattrs": None, "xattrs_key": key}, [(key, XATTR_SET, data)]


def file_objects(files: DataFrame, sizes: tuple[int, int, int] = (0, 0, 0), bits: int = 7) -> DataFrame:
    """(path, key, type, data, is_root) of files (path, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), FILES_AT_ONCE):
                part = pdf.iloc[at : at + FILES_AT_ONCE]
                built = build_files([bytes(d or b"") for d in part["data"]], sizes, bits)
                rows = [(path, k, t, d, n == len(made) - 1) for path, made in zip(part["path"], built) for n, (k, t, d) in enumerate(made)]
                yield pd.DataFrame(rows, columns=["path", "key", "type", "data", "is_root"])

    return files.select("path", "data").mapInPandas(run, "path string, key binary, type int, data binary, is_root boolean")


_ENTRIES = "dir string, name binary, mode long, uid long, gid long, mtime_ns long, content_key binary, link_target binary, rdev array<long>, xattrs array<struct<name: binary, value: binary>>"


def dir_objects(entries: DataFrame, bits: int = 7) -> DataFrame:
    """(dir, key, type, data, is_root) for every directory of one depth; entries as in the canonical schema."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, extra = [], []
        for r in sorted(pdf.to_dict("records"), key=lambda r: bytes(r["name"])):
            plain = lambda v: None if v is None else bytes(v)
            xattrs = {bytes(x["name"]): bytes(x["value"]) for x in r["xattrs"]} if r["xattrs"] is not None else None
            rdev = [int(x) for x in r["rdev"]] if r["rdev"] is not None and len(r["rdev"]) else None
            e = {"name": bytes(r["name"]), **{f: int(r[f]) for f in ("mode", "uid", "gid", "mtime_ns")}, "content_key": plain(r["content_key"]), "link_target": plain(r["link_target"]), "rdev": rdev, "xattrs": xattrs}
            e, spilled = spill_xattrs(e)
            rows.append(e)
            extra += spilled
        made = extra + build_dir(rows, bits)
        return pd.DataFrame([(key[0], k, t, d, n == len(made) - 1) for n, (k, t, d) in enumerate(made)], columns=["dir", "key", "type", "data", "is_root"])

    return entries.groupBy("dir").applyInPandas(run, "dir string, key binary, type int, data binary, is_root boolean")


def tree_objects(files: DataFrame, bits: int = 7) -> tuple[DataFrame, DataFrame]:
    """Objects (key, type, data) of a whole tree of files (path, data, mode, mtime_ns), and its root key.

    Depth by depth from the deepest: each round builds all directories of one
    depth and hands their keys to the entries above.
    """
    from ..session import cut

    content = cut(file_objects(files, bits=bits))
    parts = F.split("path", "/")
    rows = files.join(content.filter("is_root").select("path", F.col("key").alias("content_key")), "path").select(
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), F.encode(F.element_at(parts, -1), "UTF-8").alias("name"),
        F.col("mode").cast("long").alias("mode"), F.lit(0).cast("long").alias("uid"), F.lit(0).cast("long").alias("gid"), F.col("mtime_ns").cast("long").alias("mtime_ns"), "content_key",
    )
    level = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, "/")))
    rows = cut(rows.withColumn("depth", level("dir")))
    deepest = rows.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    none = {"link_target": F.lit(None).cast("binary"), "rdev": F.lit(None).cast("array<long>"), "xattrs": F.lit(None).cast("array<struct<name: binary, value: binary>>")}
    objects, carried, root = content.select("key", "type", "data"), None, None
    for depth in range(deepest, -1, -1):
        here = rows.filter(F.col("depth") == depth).drop("depth")
        if carried is not None:
            here = here.unionByName(carried)
        made = cut(dir_objects(here.withColumns(none), bits))
        objects = objects.unionByName(made.select("key", "type", "data"))
        roots = made.filter("is_root").select("dir", F.col("key").alias("content_key"))
        up = F.split("dir", "/")
        carried = roots.select(
            F.array_join(F.slice(up, 1, F.greatest(F.size(up) - 1, F.lit(0))), "/").alias("dir"), F.encode(F.element_at(up, -1), "UTF-8").alias("name"),
            F.lit(0o040755).cast("long").alias("mode"), F.lit(0).cast("long").alias("uid"), F.lit(0).cast("long").alias("gid"), F.lit(0).cast("long").alias("mtime_ns"), "content_key",
        )
        root = roots.select(F.col("content_key").alias("key"))
    return objects.dropDuplicates(["key"]), root


def child_links(key: bytes, data: bytes) -> list[tuple[bytes, bool]]:
    """(child, leaf) of an object, in recorded order."""
    from ..functions.gitobj import links as git_links

    kind = key[31] >> 4
    leaf = lambda k: k[31] >> 4 in (BLOB, XATTR_SET)
    if kind in (BLOB, XATTR_SET):
        return []
    if kind == FILE_NODE:
        found = cbor.decode_file_node(data)
    elif kind == DIR_NODE:
        found = [c for _, c in cbor.decode_dir_node(data)]
    elif kind == DIR_LEAF:
        found = [e[f] for e in cbor.decode_dir_leaf(data) for f in ("content_key", "xattrs_key") if e.get(f)]
    elif kind == 5:
        c = cbor.load(data)
        found = [c[0], *c.get(8, []), *c.get(1, [])]
    else:
        return git_links(data)
    return [(bytes(k), leaf(k)) for k in found]


def edges(objects: DataFrame) -> DataFrame:
    """edges(parent, child, pos, leaf) decoded from objects (key, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, c, n, leaf) for k, d in zip(pdf["key"], pdf["data"]) for n, (c, leaf) in enumerate(child_links(bytes(k), bytes(d)))]
            yield pd.DataFrame(rows, columns=["parent", "child", "pos", "leaf"])

    return objects.select("key", "data").mapInPandas(run, "parent binary, child binary, pos int, leaf boolean")
