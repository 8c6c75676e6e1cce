"""Git objects: frames, keys and links."""

from __future__ import annotations

import hashlib
import re

KINDS = (b"blob", b"tree", b"commit", b"tag")


def frame(kind: str, content: bytes) -> bytes:
    return f"{kind} {len(content)}".encode() + b"\0" + content


def parse_frame(data: bytes) -> tuple[bytes, bytes]:
    """(kind, content); the size must be written plainly and be right."""
    top, nul, content = data.partition(b"\0")
    m = re.fullmatch(rb"(blob|tree|commit|tag) (0|[1-9][0-9]*)", top)
    if not nul or not m or int(m[2]) != len(content):
        raise ValueError("malformed git frame")
    return m[1], content


def sha1_key(sha1: bytes) -> bytes:
    return sha1 + bytes(11) + b"\x60"


def git_key_of(data: bytes) -> bytes:
    """The key of a framed object. Collision attacks on SHA-1 are not detected."""
    return sha1_key(hashlib.sha1(data).digest())


def _named(content: bytes, word: bytes) -> tuple[bytes, bytes]:
    m = re.match(word + rb" ([0-9a-fA-F]{40})\n", content)
    if not m:
        raise ValueError(f"bad {word.decode()} line")
    return sha1_key(bytes.fromhex(m[1].decode())), content[m.end() :]


def links(data: bytes) -> list[tuple[bytes, bool]]:
    """(key, leaf) of each object referred to, in recorded order; submodule commits are no links."""
    kind, content = parse_frame(data)
    if kind == b"blob":
        return []
    if kind == b"commit":
        tree, rest = _named(content, b"tree")
        out = [(tree, False)]
        while rest.startswith(b"parent ") and len(rest) > 47:
            parent, rest = _named(rest, b"parent")
            out.append((parent, False))
        return out
    if kind == b"tag":
        target, rest = _named(content, b"object")
        m = re.match(rb"type ([^\n]*)\n", rest)
        what = m[1].split(b"\0")[0] if m else b""
        if what not in KINDS:
            raise ValueError("bad type line")
        return [(target, what == b"blob")]
    out, at = [], 0
    entry = re.compile(rb"([0-7]+) ([^\0]+)\0(.{20})", re.S)
    while at < len(content):
        m = entry.match(content, at)
        if not m:
            raise ValueError("malformed tree entry")
        form = int(m[1], 8) & 0o170000
        if form in (0o040000, 0o100000, 0o120000):
            out.append((sha1_key(m[3]), form != 0o040000))
        at = m.end()
    return out
