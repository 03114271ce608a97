"""CBOR (RFC 8949), flattened exactly as JSON."""

from __future__ import annotations

import struct

from factweave.functions.blake3 import blake3
from factweave.functions.formats import Fact, Unparseable, decode, scalar_text, walk

MAX_DEPTH = 64
SELF_DESCRIBE = b"\xd9\xd9\xf7"
_BREAK = 0xFF


class _Text(str):
    """Scalar already in canonical form."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.pos = data, 0

    def take(self, n: int) -> bytes:
        if self.pos + n > len(self.data):
            raise Unparseable("truncated")
        self.pos += n
        return self.data[self.pos - n : self.pos]

    def argument(self, info: int) -> int:
        if info < 24:
            return info
        if info > 27:
            raise Unparseable("reserved length")
        return int.from_bytes(self.take(1 << (info - 24)), "big")

    def stopped(self) -> bool:
        if self.pos < len(self.data) and self.data[self.pos] == _BREAK:
            self.pos += 1
            return True
        return False

    def string(self, info: int, major: int) -> bytes:
        if info != 31:
            return self.take(self.argument(info))
        parts = []
        while (head := self.take(1)[0]) != _BREAK:
            if head >> 5 != major:
                raise Unparseable("mixed chunks")
            parts.append(self.string(head & 31, major))
        return b"".join(parts)

    def items(self, info: int, each: int, depth: int):
        """Values of a definite or indefinite container, ``each`` per entry."""
        left = None if info == 31 else self.argument(info)
        if left is not None and left > len(self.data) - self.pos:
            raise Unparseable("length beyond data")
        while left is None or left > 0:
            if left is None and self.stopped():
                return
            yield [self.value(depth + 1) for _ in range(each)]
            left = None if left is None else left - 1

    def value(self, depth: int = 0) -> object:
        if depth > MAX_DEPTH:
            raise Unparseable("too deep")
        head = self.take(1)[0]
        major, info = head >> 5, head & 31
        if major == 0:
            return self.argument(info)
        if major == 1:
            return -1 - self.argument(info)
        if major == 2:
            return _Text("bytes#" + blake3(self.string(info, 2))[:6].hex())
        if major == 3:
            return decode(self.string(info, 3))
        if major == 4:
            return [v for (v,) in self.items(info, 1, depth)]
        if major == 5:
            return {key_text(k): v for k, v in self.items(info, 2, depth)}
        if major == 6:
            self.argument(info)
            return self.value(depth + 1)
        return self.simple(info)

    def simple(self, info: int) -> object:
        if info in (20, 21):
            return info == 21
        if info == 22:
            return None
        if info == 23:
            return _Text("undefined")
        if info in (25, 26, 27):
            code = {25: ">e", 26: ">f", 27: ">d"}[info]
            return float(struct.unpack(code, self.take(struct.calcsize(code)))[0])
        return _Text(f"simple({self.take(1)[0] if info == 24 else info})")


def key_text(key: object) -> str:
    """Map keys as text; keys that are neither text, integer, boolean nor bytes share one name."""
    if isinstance(key, str) and (not isinstance(key, _Text) or key.startswith("bytes#")):
        return key
    if isinstance(key, (bool, int)):
        return scalar_text(key)
    return "?"


def parse(data: bytes) -> list[Fact]:
    reader = _Reader(data)
    value = reader.value()
    if reader.pos != len(data):
        raise Unparseable("trailing bytes")
    out: list[Fact] = []
    walk(value, "", out)
    return out
