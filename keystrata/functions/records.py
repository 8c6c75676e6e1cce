"""Pack records: 46-byte header, checksum, payload raw, zstd or LZ4 block; and streams of them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import zstandard

from .gitobj import git_key_of, parse_frame
from .blake3 import object_key, type_of

TAG, END = 1, 0
RAW, ZSTD, LZ4 = range(3)
HEADER = 46
MOST_PAYLOAD = 256 << 20
#: Seven bytes of the writer's name and the version; readers go by the version.
MAGIC = b"KSTPACK\x04"
_NONE = {"none": RAW, "zstd": ZSTD}

_TABLE = []
for _b in range(256):
    for _ in range(8):
        _b = _b >> 1 ^ (0x82F63B78 if _b & 1 else 0)
    _TABLE.append(_b)


def crc32c(data: bytes, crc: int = 0) -> int:
    crc ^= 0xFFFFFFFF
    for b in data:
        crc = _TABLE[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def unpack_lz4(block: bytes, size: int) -> bytes:
    """One LZ4 block of known decoded size."""
    out, at = bytearray(), 0

    def more(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                n += block[at]
                at += 1
                if block[at - 1] != 255:
                    break
        return n

    while at < len(block):
        token = block[at]
        at += 1
        n = more(token >> 4)
        if at + n > len(block):
            raise ValueError("literals run past the block")
        out += block[at : at + n]
        at += n
        if at >= len(block):
            break
        back = block[at] | block[at + 1] << 8
        at += 2
        n = more(token & 15) + 4
        if not 0 < back <= len(out) or len(out) + n > size:
            raise ValueError("bad match")
        for _ in range(-(-n // back)):
            take = min(n, back)
            start = len(out) - back
            out += out[start : start + take]
            n -= take
            if n <= 0:
                break
    if len(out) != size:
        raise ValueError("decoded size differs")
    return bytes(out)


def check_codec(codec: str, level: int) -> None:
    if codec not in ("none", "zstd", "lz4") or not 0 <= level <= {"none": 0, "zstd": 22, "lz4": 12}[codec]:
        raise ValueError(f"bad codec {codec} at level {level}")


def encode_record(key: bytes, data: bytes, codec: str = "none", level: int = 3) -> bytes:
    """A record; a compressed payload is kept only if it is strictly smaller. LZ4 is read, not written."""
    if len(data) > MOST_PAYLOAD:
        raise ValueError("payload too large")
    flags, stored = RAW, data
    if codec == "zstd" and data:
        small = zstandard.ZstdCompressor(level=level).compress(data)
        if len(small) < len(data):
            flags, stored = ZSTD, small
    front = struct.pack(">B32sBII", TAG, key, flags, len(data), len(stored))
    return front + struct.pack(">I", crc32c(stored, crc32c(front + bytes(4)))) + stored


def parse_record(b: bytes) -> dict:
    """key, flags, ulen, slen, payload (stored form); raises ValueError at the first fault."""
    if len(b) < HEADER:
        raise ValueError("short record")
    tag, key, flags, ulen, slen, crc = struct.unpack(">B32sBIII", b[:HEADER])
    if tag != TAG:
        raise ValueError("bad tag")
    if flags > LZ4:
        raise ValueError("unknown codec")
    if slen != len(b) - HEADER:
        raise ValueError("bad stored length")
    if ulen > MOST_PAYLOAD:
        raise ValueError("payload too large")
    if slen != ulen if flags == RAW else slen >= ulen:
        raise ValueError("lengths don't fit the codec")
    if crc32c(b[HEADER:], crc32c(b[: HEADER - 4] + bytes(4))) != crc:
        raise ValueError("bad checksum")
    if (fault := key_fault(key)) is not None:
        raise ValueError(fault)
    return {"key": key, "flags": flags, "ulen": ulen, "slen": slen, "payload": b[HEADER:]}


def key_fault(key: bytes) -> str | None:
    """The Python twin of ``keys.key_error``."""
    if len(key) != 32:
        return "bad key length"
    if key[31] & 8:
        return "reserved bit set"
    if key[31] >> 4 > 6:
        return "reserved type"
    if key[30] == 0 and key[31] & 7:
        return "non-canonical length"
    if key[31] >> 4 == 6 and any(key[20:31]) or key[31] >> 4 == 6 and key[31] & 15:
        return "non-canonical git key"
    return None


def decode_payload(flags: int, ulen: int, stored: bytes) -> bytes:
    data = stored if flags == RAW else zstandard.ZstdDecompressor().decompress(stored, max_output_size=max(1, ulen)) if flags == ZSTD else unpack_lz4(stored, ulen)
    if len(data) != ulen:
        raise ValueError("decoded size differs")
    return data


def verify_object(key: bytes, data: bytes) -> str | None:
    """Null if the bytes are the key's object, else why not. Blobs and xattr sets also carry their own length."""
    from .blake3 import length_of
    from .cbor import commit_trees, decode_commit, footprint

    if (fault := key_fault(key)) is not None:
        return fault
    kind = type_of(key)
    if kind == 6:
        try:
            parse_frame(data)
        except ValueError as e:
            return str(e)
        return None if git_key_of(data) == key else "hash differs"
    length = length_of(key)
    if object_key(kind, length, data) != key:
        return "hash differs"
    if kind in (0, 4) and length != len(data):
        return "length differs"
    if kind == 5:
        try:
            if footprint(len(data), commit_trees(decode_commit(data))) != length:
                return "length differs"
        except (ValueError, OverflowError) as e:
            return str(e)
    return None


def write_pack(records: Iterator[bytes], magic: bytes = MAGIC) -> Iterator[bytes]:
    yield magic
    yield from records
    yield bytes([END])


def read_pack(b: bytes) -> Iterator[dict]:
    """Records of a pack stream in order; a fault is the last row, with ``error``."""
    if b[7:8] != MAGIC[7:]:
        yield {"error": "bad magic"}
        return
    at = len(MAGIC)
    while True:
        if at >= len(b):
            yield {"error": "no end marker"}
            return
        if b[at] == END:
            if at + 1 != len(b):
                yield {"error": "bytes after the end"}
            return
        size = HEADER + int.from_bytes(b[at + 38 : at + 42], "big") if at + HEADER <= len(b) else len(b) - at + 1
        try:
            if at + size > len(b):
                raise ValueError("short record")
            yield parse_record(b[at : at + size]) | {"offset": at, "error": None}
        except ValueError as e:
            yield {"error": str(e)}
            return
        at += size
