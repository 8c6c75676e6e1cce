"""Canonical CBOR for trees, commits and references: shortest heads, definite lengths, sorted keys.

Decoding for trees is lax about head forms, as the stored data may be; commits
and references must encode back to the same bytes.
"""

from __future__ import annotations

UINT, NEGINT, BYTES, TEXT, ARRAY, MAP = range(6)


def head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * size:
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise OverflowError(n)


def dump(v) -> bytes:
    """Ints, bytes, text, lists, and dicts (keys sorted by their encoding)."""
    if isinstance(v, bool):
        raise TypeError("no booleans here")
    if isinstance(v, int):
        return head(UINT, v) if v >= 0 else head(NEGINT, -1 - v)
    if isinstance(v, (bytes, bytearray, memoryview)):
        return head(BYTES, len(v)) + bytes(v)
    if isinstance(v, str):
        b = v.encode()
        return head(TEXT, len(b)) + b
    if isinstance(v, (list, tuple)):
        return head(ARRAY, len(v)) + b"".join(map(dump, v))
    if isinstance(v, dict):
        return head(MAP, len(v)) + b"".join(k + dump(x) for k, x in sorted((dump(k), x) for k, x in v.items()))
    raise TypeError(type(v))


def read_head(b: bytes, at: int = 0) -> tuple[int, int, int]:
    """(major, argument, next position); any head form but the reserved ones."""
    if at >= len(b):
        raise ValueError("unexpected end")
    major, info = b[at] >> 5, b[at] & 31
    if info < 24:
        return major, info, at + 1
    if info > 27:
        raise ValueError(f"unsupported additional info {info}")
    size = 1 << info - 24
    if at + 1 + size > len(b):
        raise ValueError("unexpected end")
    return major, int.from_bytes(b[at + 1 : at + 1 + size], "big"), at + 1 + size


def load_at(b: bytes, at: int, depth: int = 0):
    if depth > 64:
        raise ValueError("too deep")
    major, n, at = read_head(b, at)
    if major == UINT:
        return n, at
    if major == NEGINT:
        return -1 - n, at
    if major in (BYTES, TEXT):
        if at + n > len(b):
            raise ValueError("unexpected end")
        raw = bytes(b[at : at + n])
        return (raw if major == BYTES else raw.decode()), at + n
    if major in (ARRAY, MAP):
        if n > len(b) - at:
            raise ValueError("more items than bytes")
        out: list | dict = [] if major == ARRAY else {}
        for _ in range(n):
            x, at = load_at(b, at, depth + 1)
            if major == ARRAY:
                out.append(x)
            else:
                out[x], at = load_at(b, at, depth + 1)
        return out, at
    raise ValueError(f"unsupported major type {major}")


def load(b: bytes):
    v, at = load_at(b, 0)
    if at != len(b):
        raise ValueError("trailing bytes")
    return v


def load_strict(b: bytes):
    v = load(b)
    if dump(v) != bytes(b):
        raise ValueError("not canonical")
    return v


_ENTRY = ("name", "mode", "uid", "gid", "mtime_ns", "content_key", "link_target", "rdev", "xattrs", "xattrs_key")
_REF = ("name", "key", "user", "created_at_ns", "signature", "public_key")
_COMMIT = ("tree", "parents", "author", "committer", "message", "signature", "public_key", "change_id", "conflict_terms", "conflict_labels")
_IDENTITY = ("name", "email", "when", "tz_offset")


def _pack(record: dict, fields: tuple[str, ...], required: int) -> dict:
    return {k: record[f] for k, f in enumerate(fields) if k < required or record.get(f)}


def _unpack(v: dict, fields: tuple[str, ...], required: int) -> dict:
    if not isinstance(v, dict) or any(k not in v for k in range(required)):
        raise ValueError("a required field is missing")
    return {f: v.get(k) for k, f in enumerate(fields)}


def encode_entry(e: dict) -> bytes:
    return dump(_pack(e, _ENTRY, 5))


def encode_dir_leaf(entries: list[dict]) -> bytes:
    return head(ARRAY, len(entries)) + b"".join(map(encode_entry, entries))


def decode_dir_leaf(b: bytes) -> list[dict]:
    return [_unpack(v, _ENTRY, 1) for v in load(b)]


def encode_dir_node(pairs: list[tuple[bytes, bytes]]) -> bytes:
    return dump([[sep, child] for sep, child in pairs])


def decode_dir_node(b: bytes) -> list[tuple[bytes, bytes]]:
    return [(sep, child) for sep, child in load(b)]


def encode_file_node(children: list[bytes]) -> bytes:
    return dump(list(children))


def decode_file_node(b: bytes) -> list[bytes]:
    return load(b)


def encode_reference(r: dict) -> bytes:
    return dump(_pack(r, _REF, 4))


def decode_reference(b: bytes) -> dict:
    return _unpack(load_strict(b), _REF, 4)


def reference_payload(r: dict) -> bytes:
    """What a signer signs: the record without its signature."""
    return encode_reference({**r, "signature": None})


def validate_commit(c: dict) -> None:
    parents, terms, labels = c["parents"], c.get("conflict_terms") or [], c.get("conflict_labels") or []
    if len(parents) > 256 or len(set(parents)) != len(parents):
        raise ValueError("bad parents")
    if any(len(k) != 32 or k[31] >> 4 != 5 for k in parents) or any(len(k) != 32 or k[31] >> 4 not in (2, 3) for k in [c["tree"], *terms]):
        raise ValueError("a key of the wrong type")
    if len(terms) % 2 or len(terms) > 254:
        raise ValueError("bad conflict terms")
    if labels and (not terms or len(labels) != 1 + len(terms) or not any(labels)):
        raise ValueError("bad conflict labels")
    for who in (c["author"], c["committer"]):
        if abs(who["tz_offset"]) > 1439 or any(len(who[f].encode()) > 1024 or any(ord(x) < 32 or ord(x) == 127 for x in who[f]) for f in ("name", "email")):
            raise ValueError("bad identity")
    if len(c["message"].encode()) > 1 << 20:
        raise ValueError("message too long")


def encode_commit(c: dict) -> bytes:
    validate_commit(c)
    who = lambda w: {k: w[f] for k, f in enumerate(_IDENTITY)}
    return dump(_pack({**c, "author": who(c["author"]), "committer": who(c["committer"])}, _COMMIT, 5))


def decode_commit(b: bytes) -> dict:
    c = _unpack(load_strict(b), _COMMIT, 5)
    for f in ("author", "committer"):
        c[f] = _unpack(c[f], _IDENTITY, 4)
    validate_commit(c)
    return c


def commit_payload(c: dict) -> bytes:
    return encode_commit({**c, "signature": None})


def commit_trees(c: dict) -> list[bytes]:
    return [c["tree"], *(c.get("conflict_terms") or [])]


def footprint(own: int, trees: list[bytes]) -> int:
    """Own bytes and the lengths of the trees; parents don't count."""
    from .blake3 import length_of

    total = own + sum(map(length_of, trees))
    if total >= 1 << 64:
        raise OverflowError("footprint")
    return total
