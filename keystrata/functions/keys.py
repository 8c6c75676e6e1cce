"""Content keys: 32 bytes, digest first, then the length in little-endian order, then the header byte.

The header's high nibble is the object type, its low three bits one less than
the length's size. All functions are built-in expressions over BINARY columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOB, FILE_NODE, DIR_LEAF, DIR_NODE, XATTR_SET, COMMIT, GIT_SHA1 = range(7)
TYPE_NAMES = ("blob", "filenode", "dirleaf", "dirnode", "xattrset", "commit", "gitsha1")
KEY_SIZE = 32
LEAF_TYPES = (BLOB, XATTR_SET)

_ZERO_TAIL = bytes(11) + b"\x60"


def _byte(key: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(key, at, 1)), 16, 10).cast("int")


def reversed_bytes(b: Column) -> Column:
    """Bytes in reverse order (``reverse`` takes binary for text, so this goes by hex pairs)."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(b), F.lit(".."), F.lit(0))), ""))


def header(key: Column) -> Column:
    return _byte(key, KEY_SIZE)


def key_type(key: Column) -> Column:
    return F.shiftright(header(key), 4)


def length_size(key: Column) -> Column:
    return header(key).bitwiseAND(7) + 1


def key_length(key: Column) -> Column:
    """The length field as DECIMAL(20,0): it may exceed a signed long."""
    n = length_size(key)
    return F.conv(F.hex(reversed_bytes(key.substr(F.lit(KEY_SIZE) - n, n))), 16, 10).cast("decimal(20,0)")


def key_hash(key: Column) -> Column:
    """The digest's leading bytes in digest order."""
    return F.when(key_type(key) == GIT_SHA1, F.substring(key, 1, 20)).otherwise(reversed_bytes(key.substr(F.lit(1), F.lit(KEY_SIZE - 1) - length_size(key))))


def git_sha1_sum(key: Column) -> Column:
    return F.when(key_type(key) == GIT_SHA1, F.substring(key, 1, 20))


def key_error(key: Column) -> Column:
    """Null for a canonical key, else the first fault in checking order."""
    top = _byte(key, KEY_SIZE - 1)
    return (
        F.when(key.isNull() | (F.octet_length(key) != KEY_SIZE), "bad key length")
        .when(header(key).bitwiseAND(8) != 0, "reserved bit set")
        .when(key_type(key) > GIT_SHA1, "reserved type")
        .when((top == 0) & ~((length_size(key) == 1) & (top == 0)), "non-canonical length")
        .when((key_type(key) == GIT_SHA1) & (F.substring(key, 21, 12) != F.lit(_ZERO_TAIL)), "non-canonical git key")
    )


def parse_key(key: Column) -> Column:
    """The key if it is canonical, else null."""
    return F.when(key_error(key).isNull(), key)


def key_from_hash(kind: int | Column, length: Column, digest: Column) -> Column:
    """Assemble a key of any type but git's from a 32-byte digest."""
    kind = F.lit(kind) if isinstance(kind, int) else kind
    length = length.cast("decimal(20,0)")
    digits = F.conv(length.cast("string"), 10, 16)
    even = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    size = (F.length(even) / 2).cast("int")
    tail = F.unhex(F.lpad(F.hex(kind * 16 + size - 1), 2, "0"))
    return F.concat(reversed_bytes(digest.substr(F.lit(1), F.lit(KEY_SIZE - 1) - size)), reversed_bytes(F.unhex(even)), tail)


def git_key(sha1: Column) -> Column:
    """The key of a git object from its 20-byte SHA-1."""
    return F.concat(sha1, F.lit(_ZERO_TAIL))


def git_frame(kind: str, content: Column) -> Column:
    """``<kind> <size>`` NUL content."""
    return F.concat(F.encode(F.concat(F.lit(f"{kind} "), F.octet_length(content).cast("string")), "UTF-8"), F.lit(b"\x00"), content)


def git_blob_key(text: Column) -> Column:
    """The key of a text as a git blob."""
    return git_key(F.unhex(F.sha1(git_frame("blob", F.encode(text, "UTF-8")))))


def hex_key(key: Column) -> Column:
    return F.lower(F.hex(key))


def is_leaf(key: Column) -> Column:
    return key_type(key).isin(*LEAF_TYPES)
