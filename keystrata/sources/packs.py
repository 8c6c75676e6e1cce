"""Pack streams and file trees as Spark data sources.

``spark.dataSource.register(PackSource)`` then ``spark.read.format("kpack").load(path)``;
``df.write.format("kpack")`` writes one pack for each task from (key, data).
"""

from __future__ import annotations

import glob
import os
import stat
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.records import decode_payload, encode_record, read_pack, write_pack


def _files(path: str) -> list[str]:
    return sorted(glob.glob(f"{path}/*.pack")) if os.path.isdir(path) else [path]


class PackSource(DataSource):
    """Rows (pack, offset, key, flags, ulen, slen, data, error); a fault ends its pack with an error row.

    Option ``decode`` = false leaves payloads as stored.
    """

    @classmethod
    def name(cls) -> str:
        return "kpack"

    def schema(self) -> str:
        return "pack string, offset long, key binary, flags int, ulen long, slen long, data binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _PackReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PackWriter(self.options, [f.name for f in schema.fields])


class _PackReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.decode = options["path"], str(options.get("decode", "true")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self.path)] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        with open(partition.value, "rb") as f:
            data = f.read()
        for r in read_pack(data):
            if r["error"] is None and self.decode:
                try:
                    r["payload"] = decode_payload(r["flags"], r["ulen"], r["payload"])
                except Exception as e:  # any decoder's fault is the row's error
                    r = {"error": f"payload: {e}"}
            if r["error"] is not None:
                yield (partition.value, None, None, None, None, None, None, r["error"])
                return
            yield (partition.value, r["offset"], r["key"], r["flags"], r["ulen"], r["slen"], r["payload"], None)


class _PackWriter(DataSourceWriter):
    def __init__(self, options, names: list[str]) -> None:
        self.path, self.codec, self.level = options["path"], options.get("compression", "none"), int(options.get("level", 3))
        self.at = (names.index("key"), names.index("data"))

    def write(self, rows) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name = f"{self.path}/{uuid.uuid4().hex}"
        k, d = self.at
        with open(name + ".tmp", "wb") as f:
            for part in write_pack(encode_record(bytes(r[k]), bytes(r[d]), self.codec, self.level) for r in rows):
                f.write(part)
            f.flush()
            os.fsync(f.fileno())
        message = WriterCommitMessage()
        message.name = name
        return message

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None:
                os.rename(m.name + ".tmp", m.name + ".pack")

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.name + ".tmp"):
                os.remove(m.name + ".tmp")


def read_xattrs(path: str) -> list[tuple[bytes, bytes]]:
    try:
        names = os.listxattr(path, follow_symlinks=False)
    except OSError:
        return []
    return sorted((n.encode("utf-8", "surrogateescape"), os.getxattr(path, n, follow_symlinks=False)) for n in names)


class TreeSource(DataSource):
    """The entries below a local directory: lstat rows with links, devices, xattrs, and file content.

    Options: ``exclude``, comma-separated names left out directly below the
    root; ``content`` = false leaves file content null (a sizing pass).
    Top-level directories are read in parallel.
    """

    @classmethod
    def name(cls) -> str:
        return "ktree"

    def schema(self) -> str:
        return (
            "path string, dir string, name binary, is_dir boolean, mode long, uid long, gid long, mtime_ns long, size long, link_target binary, rdev array<long>,"
            " xattrs array<struct<name: binary, value: binary>>, data binary"
        )

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["path"].rstrip("/")
        self.out = set(filter(None, options.get("exclude", "").split(",")))
        self.content = str(options.get("content", "true")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in sorted(os.listdir(self.root)) if n not in self.out] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            yield from self._walk(partition.value)

    def _walk(self, path: str) -> Iterator[tuple]:
        full = f"{self.root}/{path}"
        s = os.lstat(full)
        kind = stat.S_IFMT(s.st_mode)
        target = os.readlink(full.encode()) if kind == stat.S_IFLNK else None
        rdev = [os.major(s.st_rdev), os.minor(s.st_rdev)] if kind in (stat.S_IFCHR, stat.S_IFBLK) else None
        data = None
        if kind == stat.S_IFREG and self.content:
            with open(full, "rb") as f:
                data = f.read()
        parent, _, name = path.rpartition("/")
        xattrs = [{"name": n, "value": v} for n, v in read_xattrs(full)] or None
        yield (path, parent, name.encode("utf-8", "surrogateescape"), kind == stat.S_IFDIR, s.st_mode, s.st_uid, s.st_gid, s.st_mtime_ns, s.st_size if kind == stat.S_IFREG else 0, target, rdev, xattrs, data)
        if kind == stat.S_IFDIR:
            for n in sorted(os.listdir(full), key=os.fsencode):
                yield from self._walk(f"{path}/{n}")


def register(spark) -> None:
    spark.dataSource.register(PackSource)
    spark.dataSource.register(TreeSource)
