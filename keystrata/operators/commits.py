"""Commits as rows: encode, decode, history, and the directory a key stands for."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cbor
from ..functions.blake3 import make_key, digest
from ..functions.render import rfc3339_at

_WHO = "struct<name: string, email: string, when: bigint, tz_offset: int>"
COMMIT = (
    f"tree binary, parents array<binary>, author {_WHO}, committer {_WHO}, message string, signature binary, public_key binary, change_id binary,"
    " conflict_terms array<binary>, conflict_labels array<string>"
)


def commit_object(c: dict) -> tuple[bytes, bytes]:
    """(key, bytes) of a commit; its key's length is its footprint."""
    data = cbor.encode_commit(c)
    return make_key(5, cbor.footprint(len(data), cbor.commit_trees(c)), digest(data)), data


def decode_commits(objects: DataFrame) -> DataFrame:
    """(key, the commit's columns, error) from objects (key, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, data in zip(pdf["key"], pdf["data"]):
                try:
                    c, error = cbor.decode_commit(bytes(data)), None
                except (ValueError, TypeError, KeyError, AttributeError) as e:
                    c, error = {}, str(e) or type(e).__name__
                rows.append({"key": key, **{f: c.get(f) for f in cbor._COMMIT}, "error": error})
            yield pd.DataFrame(rows)

    return objects.select("key", "data").mapInPandas(run, f"key binary, {COMMIT}, error string")


def conflicted(terms: Column) -> Column:
    return F.coalesce(F.size(terms) > 0, F.lit(False))


def trees(tree: Column, terms: Column) -> Column:
    return F.concat(F.array(tree), F.coalesce(terms, F.array().cast("array<binary>")))


def directory_of(keys: DataFrame, commits: DataFrame) -> DataFrame:
    """``keys`` with ``directory``: a commit's tree, any other key itself."""
    return keys.join(commits.select("key", "tree"), "key", "left").withColumn("directory", F.coalesce("tree", "key")).drop("tree")


def render_commit(commits: DataFrame) -> DataFrame:
    """(key, text): one commit as lines."""
    who = lambda c: F.concat(F.col(f"{c}.name"), F.lit(" <"), F.col(f"{c}.email"), F.lit("> "), rfc3339_at(F.col(f"{c}.when"), F.col(f"{c}.tz_offset")))
    hexed = lambda c: F.lower(F.hex(c))
    lines = F.concat(
        F.array(F.concat(F.lit("commit "), hexed(F.col("key"))), F.concat(F.lit("tree "), hexed(F.col("tree")))),
        F.transform("parents", lambda p: F.concat(F.lit("parent "), hexed(p))),
        F.array(F.concat(F.lit("author "), who("author")), F.concat(F.lit("committer "), who("committer")), F.lit(""), F.col("message")),
    )
    return commits.select("key", F.array_join(lines, "\n").alias("text"))
